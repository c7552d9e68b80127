"""The index finds what a scan finds, and reads the postings of the query's grams alone."""

import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from colloquy.functions.text import search
from colloquy.operators.search_index import Index, grams_of, query_grams


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(1)
    rows = [(k, "".join(rng.choice("abAB é%_\n") for _ in range(rng.randint(0, 40)))) for k in range(400)]
    rows += [(400, None), (401, ""), (402, "ab"), (None, "aaab"), (403, "x" * 200_000 + "needle"), (404, "\U0001d400\U0001d400\U0001d400b"), (405, "İstanbul")]
    return spark.createDataFrame(rows, "id bigint, transcript string")


@pytest.fixture(scope="module")
def index(texts, tmp_path_factory):
    return Index.build(texts, str(tmp_path_factory.mktemp("grams") / "index"))


QUERIES = ["aba", "AB a", "a%b", "ab_ab", "é a", "a", "%", "", "  ", "needle", "xxx%needle", "\U0001d400\U0001d400b", "stan", "nothing here", "a_b%ba "]


@pytest.mark.parametrize("wildcards", [True, False])
def test_same_rows_as_a_scan(texts, index, wildcards):
    keyed = texts.where("id is not null")
    for queries in (QUERIES[:8], QUERIES[8:]):
        both = [reduce(lambda a, b: a.unionByName(b), [find(q).select(F.lit(q).alias("q"), "id") for q in queries]) for find in (lambda q: index.find(keyed, q, wildcards=wildcards), lambda q: search(keyed, "transcript", q, wildcards))]
        got, want = ([tuple(r) for r in x.orderBy("q", "id").collect()] for x in both)
        assert got == want


def test_reads_few_postings(texts, index, spark):
    assert query_grams("Need%le_bo") == ["eed", "nee"] and query_grams("a%b_c") == [] and query_grams("a%bc", wildcards=False) == ["%bc", "a%b"]
    all_rows = spark.read.parquet(index.path).count()
    assert index.postings(query_grams("needle")).count() == 4 and all_rows > 5000
    plan = index.postings(["nee"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(", "").replace("bucket#", "bucket") or "bucket#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "gram" in plan.split("PushedFilters")[1].split("]")[0]


def test_grams(spark):
    rows = spark.createDataFrame([("AbCabc",), ("ab",), ("",), (None,)], "t string").select(grams_of("t").alias("g")).collect()
    assert [r["g"] for r in rows] == [["abc", "bca", "cab"], [], [], None]
