"""Batches by count or time, jitter buffers and checkpoints by hand; batches as a stream too."""

import pytest
from pyspark.sql import functions as F

from colloquy.operators import buffers as B
from colloquy.streaming import jobs

ROWS = "k string, at bigint, tie bigint, v double"


def rows_of(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def test_batches_close_by_count_or_time(spark):
    rows = [("a", t, i, 1.0) for i, t in enumerate([0, 1, 2, 3, 4999, 9998, 9999, 15000])] + [("b", 7, 0, None), (None, 1, 0, 1.0), ("a", None, 9, 1.0)]
    out = B.batches(rows_of(spark, rows), "k", "at", "tie", "v", size=3).orderBy("k", "first_at").collect()
    assert [tuple(r) for r in out] == [
        ("a", 0, 2, 2, 3, 3.0, True),
        ("a", 3, 9998, 9998, 3, 3.0, True),  # 4999 ms of silence are not enough
        ("a", 9999, 9999, 14999, 1, 1.0, False),
        ("a", 15000, 15000, 20000, 1, 1.0, False),
        ("b", 7, 7, 5007, 1, 0.0, False),
    ]
    assert B.batches(rows_of(spark, []), "k", "at", "tie", "v").count() == 0


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def test_stream_goes_on_from_its_checkpoint(spark, rocks, tmp_path):
    rows = [(f"k{k}", 1000 + t, i, float(i % 5)) for k in range(3) for i, t in enumerate(range(0, 40_000, 150 + 37 * k)) if not 9_000 + 1000 * k < t < 15_000 + 1000 * k] + [("z", 900_000, 0, 1.0)]
    table = rows_of(spark, rows).withColumn("time", F.timestamp_millis("at"))
    folder, got = str(tmp_path / "in"), []
    for low, high in [(0, 9_000), (9_000, 30_000), (30_000, 1 << 40)]:
        table.where((F.col("at") >= low) & (F.col("at") < high)).coalesce(1).write.mode("append").parquet(folder)
        stream = B.batches_stream(jobs.source(spark, folder), "k", "at", "tie", "v", "time", size=40)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        got.append(spark.read.parquet(str(tmp_path / "out")).count())
    assert got == sorted(got) and 0 < got[0] < got[-1]
    plain = lambda df: sorted(str([r[c] for c in ("k", "first_at", "last_at", "closed_at", "n", "total", "full")]) for r in df.where("k != 'z'").collect())
    want = plain(B.batches(table, "k", "at", "tie", "v", size=40))
    assert plain(spark.read.parquet(str(tmp_path / "out"))) == want and any("False" in r for r in want)


def reads(spark, chunks, asks, timeout=100):
    table = lambda rows: spark.createDataFrame([("s", *r) for r in rows], "k string, at bigint, n bigint")
    return [tuple(r)[1:] for r in B.jitter_reads(table(chunks), table(asks), "k", timeout).collect()]


def test_reads_wait_and_are_filled_with_silence(spark):
    chunks = [(0, 10), (50, 10), (300, 4)]
    assert reads(spark, chunks, [(99, 5), (100, 15), (140, 5), (150, 8), (160, 1), (399, 1), (400, 2), (401, 9)]) == [
        (99, None, 0, 20),
        (100, 15, 0, 5),
        (140, None, 0, 5),  # the oldest chunk left came at 50
        (150, 5, 3, 0),
        (160, None, 0, 0),
        (399, None, 0, 4),
        (400, 2, 0, 2),
        (401, 2, 7, 0),
    ]
    assert reads(spark, [], [(5, 5)]) == [(5, None, 0, 0)] and reads(spark, chunks, []) == []


def saved(spark, log):
    rules = B.SaverRules(rate=1)
    rows = spark.createDataFrame([("s", i, *r) for i, r in enumerate(log)], "k string, i bigint, at bigint, n bigint, ok boolean")
    return [tuple(r)[1:] for r in B.checkpoints(rows, "k", ["at", "i"], rules).collect()]


def test_checkpoints_back_off_and_drop_the_oldest(spark):
    assert saved(spark, [(0, 29, True), (1, 3, True), (2, 5, None)]) == [(1, "written", 0, 32, 0, 0, None), (2, "rest", 1, 5, 0, 0, None)]
    tries, at = [], 0
    for _ in range(6):
        tries.append((at, 30, False))
        at += 60_000
    assert [r[6] - r[0] for r in saved(spark, tries)[:-1]] == [5_000, 10_000, 20_000, 40_000, 60_000, 60_000]
    out = saved(spark, [(0, 590, False), (4_999, 30, True), (5_000, 1, True), (5_001, 30, False)])
    assert out == [(0, "failed", None, 0, 590, 0, 5_000), (4_999, "waits", None, 0, 600, 20, 5_000), (5_000, "written", 0, 601, 0, 0, None), (5_001, "failed", None, 0, 30, 0, 10_001), (5_001, "rest", 1, 30, 0, 0, None)]
