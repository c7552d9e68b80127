"""Lives of capture streams by hand, and the same from a stream with timers."""

import pytest
from pyspark.sql import functions as F

from colloquy.operators import health as H
from colloquy.streaming import jobs


def life(*log, until=None):
    state, out = H.Health(), []
    for at, kind in log:
        out += state.take(at, kind, H.Rules())
    if until is not None:
        out += state.pass_time(until, H.Rules())
    return state, [(r[0], r[1], r[2]) for r in out], out


def test_stall_after_three_seconds():
    _, rows, _ = life((0, "installed"), (1000, "audio"), (3900, "audio"), (7000, "audio"))
    assert rows[2:] == [(3900, "audio", "Running"), (6901, "stall", "Dead"), (7000, "audio", "Dead")]
    assert life((0, "installed"), until=3000)[1] == [(0, "installed", "Running")]


def test_more_than_five_errors_in_two_seconds():
    state, _, _ = life((0, "installed"), *[(100 * k, "error") for k in range(1, 6)])
    assert state.status == "Running"
    assert state.take(600, "error", H.Rules())[-1][2] == "Dead"
    assert life((0, "installed"), *[(500 * k, "error") for k in range(1, 6)])[0].status == "Running"
    assert life((0, "installed"), (10, "disconnected"))[0].status == "Dead"


def test_recovers_after_three_seconds_of_audio():
    _, _, rows = life((0, "installed"), (100, "disconnected"), (200, "rebuilt"), (1000, "audio"), (3199, "audio"), (3200, "audio"), (3300, "audio"))
    assert [r[3] for r in rows] == [False, False, False, False, False, True, False] and [r[4] for r in rows][1]
    # a stream put in place of one that had no outage recovers silently
    assert not any(r[3] for r in life((0, "installed"), (100, "rebuilt"), (3100, "audio"))[2])


def test_given_up_after_three_short_lives():
    log = [(0, "installed"), (10, "disconnected")]
    for k in range(1, 4):
        log += [(1000 * k, "rebuilt"), (1000 * k + 10, "audio"), (1000 * k + 20, "disconnected")]
    state, rows, out = life(*log)
    assert state.status == "Failed" and rows[-1] == (3020, "disconnected", "Failed") and out[-1][5:] == (3, 60_000)
    # one that worked for three seconds starts the count anew
    log[-3:] = [(3000, "rebuilt"), (4000, "audio"), (6000, "audio"), (6020, "disconnected")]
    state, _, _ = life(*log)
    assert state.status == "Dead" and state.short_lived == 0


def test_retries_double_from_30_to_300_seconds():
    state, rows, _ = life((0, "installed"), (10, "disconnected"), (20, "failed"), until=30_020)
    assert rows[-1] == (30_020, "retry", "Failed")
    at, waits = 30_020, []
    for _ in range(6):
        state.take(at + 5, "failed", H.Rules())
        waits.append(state.retry)
        at = state.pass_time(at + 5 + state.retry, H.Rules())[-1][0]
    assert waits == [60_000, 120_000, 240_000, 300_000, 300_000, 300_000]
    state.take(at + 1, "rebuilt", H.Rules())
    state.take(at + 3001, "audio", H.Rules())
    state.take(at + 3002, "disconnected", H.Rules())
    state.take(at + 3003, "failed", H.Rules())
    assert state.retry == 30_000


def test_outages_are_told_once():
    _, _, rows = life((0, "installed"), (10, "disconnected"), (20, "rebuilt"), (30, "disconnected"), (40, "rebuilt"), (3100, "audio"), (3200, "disconnected"), (3300, "rebuilt"), (6400, "audio"), (10_500, "audio"))
    told = [(r[0], r[1]) for r in rows if r[4]]
    assert told[0] == (10, "disconnected") and len(told) == 1 or all(b[0] - a[0] >= 10_000 for a, b in zip(told, told[1:]))
    assert (30, "disconnected") not in told and (3200, "disconnected") not in told


def test_table(spark):
    rows = [("a", 0, "installed"), ("a", 10, "disconnected"), ("a", 10, "failed"), ("a", 95_000, "audio"), ("b", 5, "audio"), (None, 1, "audio"), ("b", None, "audio"), ("b", 6, "unknown")]
    got = sorted((r["s"], r["at"], r["kind"], r["status"]) for r in H.lifecycle(spark.createDataFrame(rows, "s string, at bigint, kind string"), "s").collect())
    assert got == [("a", 0, "installed", "Running"), ("a", 10, "disconnected", "Dead"), ("a", 10, "failed", "Failed"), ("a", 30_010, "retry", "Failed"), ("a", 60_010, "retry", "Failed"), ("a", 90_010, "retry", "Failed"), ("a", 95_000, "audio", "Failed"), ("b", 5, "audio", "Absent")]


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def test_timers_of_a_stream(spark, rocks, tmp_path):
    """Stream a stalls and fails while only stream b delivers; the query is started anew for every file."""
    log = [("a", 0, "installed"), ("a", 1000, "audio"), ("b", 0, "installed")] + [("b", 1000 * k, "audio") for k in range(1, 11)] + [("a", 12_000, "failed")] + [("b", 1000 * k, "audio") for k in range(11, 80)]
    day = 86_400_000  # a stream's watermark begins at time 0
    table = spark.createDataFrame([(s, at + day, kind) for s, at, kind in log], "s string, at bigint, kind string").withColumn("time", F.timestamp_millis("at"))
    for low, high in ((0, 2500), (2500, 11_500), (11_500, 40_000), (40_000, 10**6)):
        table.where(f"at >= {low + day} and at < {high + day}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = H.lifecycle_stream(jobs.source(spark, str(tmp_path / "in")), "s")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    got = sorted((r["at"] - day, r["kind"], r["status"]) for r in out.where("s = 'a'").collect())
    assert got == [(0, "installed", "Running"), (1000, "audio", "Running"), (4001, "stall", "Dead"), (12_000, "failed", "Failed"), (42_000, "retry", "Failed"), (72_000, "retry", "Failed")]
    assert {r["status"] for r in out.where("s = 'b'").collect()} == {"Running"} and out.where("s = 'b'").count() == 80
