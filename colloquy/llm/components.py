"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm._scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, component): for each node of ``edges`` (a, b), the smallest node that it reaches.

    Each round links every node's larger neighbours to its smallest one, and then its smaller neighbours too; the edges
    end as stars around the smallest nodes. A node's neighbours are never collected: its smallest one is an aggregate that
    is joined back. Each round is written to the shared folder.
    """
    now = scratch.save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), f"{name}-0")
    before = None
    for number in range(1, most_rounds):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a != b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("e")).select("e.a", "e.b").where("a != b").distinct()
        new = scratch.save(small, f"{name}-{number}")
        state = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        scratch.drop(f"{name}-{number - 1}")
        now = new
        if tuple(state) == before:
            return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        before = tuple(state)
    raise RuntimeError("the components did not settle")
