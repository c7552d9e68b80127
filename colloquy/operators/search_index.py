"""Substring search over an inverted index of three-letter grams, with the rows that a scan of all texts finds.

Each text is posted under every gram of its lower-case form. A query meets only the postings of its own grams; texts that
have all of them are then compared with the query itself.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.text import search

GRAM, BUCKETS = 3, 64


def grams_of(text: Column) -> Column:
    """The distinct grams of a text in lower case; none of a shorter one."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def query_grams(query: str, wildcards: bool = True) -> list[str]:
    """Grams that every text with the query has: those of its pieces between wildcards."""
    pieces = re.split("[%_]", query.lower()) if wildcards else [query.lower()]
    return sorted({p[k : k + GRAM] for p in pieces for k in range(len(p) - GRAM + 1)})


def bucket_of(gram: Column) -> Column:
    return F.pmod(F.crc32(F.encode(gram, "UTF-8")), F.lit(BUCKETS)).cast("int")


def postings_of(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, gram, bucket), sorted in partitions of a bounded size: what grows is their number, frequent grams' included."""
    posted = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.explode(grams_of(F.col(text))).alias("gram"))
    salted = posted.withColumns({"bucket": bucket_of(F.col("gram")), "salt": F.pmod(F.xxhash64("key"), F.lit(8))})
    return salted.hint("rebalance", "bucket", "salt").sortWithinPartitions("bucket", "gram", "key").drop("salt")


class Index:
    """Postings (gram, key) under a folder, in buckets by gram and sorted, so that a read skips files and row groups."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, rows: DataFrame, path: str, key: str = "id", text: str = "transcript") -> Index:
        """Posts (key, text); a key is a text of its own. Null texts and keys are found by no search."""
        postings_of(rows, key, text).write.partitionBy("bucket").parquet(path)
        return cls(rows.sparkSession, path)

    def postings(self, grams: list[str]) -> DataFrame:
        """The posting rows that a query with these grams reads."""
        buckets = sorted({zlib.crc32(g.encode()) % BUCKETS for g in grams})
        return self.spark.read.parquet(self.path).where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))

    def find(self, rows: DataFrame, query: str, key: str = "id", text: str = "transcript", wildcards: bool = True) -> DataFrame:
        """The rows whose text holds the query, as ``search`` finds them. A query without a gram has all texts scanned, a
        blank one finds nothing."""
        grams = query_grams(query, wildcards)
        if not query.strip() or not grams:
            return search(rows, text, query, wildcards)
        full = self.postings(grams).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select(F.col("key").alias("__key"))
        return search(rows.join(full, F.col(key) == F.col("__key"), "left_semi"), text, query, wildcards)
