"""Writes that stop at any step, writers that meet, and batches that come again."""

import itertools

import pytest

from colloquy.operators import merges
from colloquy.sources.versions import Conflict, Versions, save_meetings
from colloquy.streaming import jobs


class Stop(RuntimeError):
    pass


def stopping(monkeypatch, step):
    """A store whose step number ``step`` is not taken any more: its files and its rename are steps."""
    taken = itertools.count()

    def guarded(f):
        def run(self, *args, **options):
            if next(taken) == step:
                raise Stop
            return f(self, *args, **options)

        return run

    from pyspark.sql.readwriter import DataFrameWriter

    monkeypatch.setattr(DataFrameWriter, "parquet", guarded(DataFrameWriter.parquet))
    monkeypatch.setattr(Versions, "_publish", guarded(Versions._publish))
    monkeypatch.setattr(Versions, "_rename", guarded(Versions._rename))


def frames(spark, n):
    return spark.createDataFrame([(f"m{k}", f"t{k}") for k in range(n)], "id string, title string"), spark.createDataFrame([(f"s{k}-{j}", f"m{k}", j) for k in range(n) for j in range(2)], "id string, meeting_id string, n int")


def rows(store, name):
    return sorted(map(tuple, store.read(name).collect()))


@pytest.mark.parametrize("step", range(4))
def test_all_or_nothing(spark, tmp_path, step):
    store = Versions(spark, f"file://{tmp_path}/s")
    meetings, segments = frames(spark, 4)
    assert save_meetings(store, meetings.where("id < 'm2'"), segments.where("meeting_id < 'm2'")) == 1
    before = rows(store, "meetings"), rows(store, "segments")
    with pytest.MonkeyPatch.context() as m:
        stopping(m, step)
        with pytest.raises(Stop):
            save_meetings(store, meetings.where("id >= 'm2'"), segments.where("meeting_id >= 'm2'"))
    assert (rows(store, "meetings"), rows(store, "segments")) == before and store.version() == 1
    assert save_meetings(store, meetings.where("id >= 'm2'"), segments.where("meeting_id >= 'm2'")) == 2
    assert (len(rows(store, "meetings")), len(rows(store, "segments"))) == (4, 8)
    assert len(store.read("segments", version=1).collect()) == 4
    assert store.clean(keep=1) and (len(rows(store, "meetings")), len(rows(store, "segments"))) == (4, 8)
    assert store.clean(keep=1) == []


@pytest.mark.parametrize("bad", ["double", "there", "orphan", "null"])
def test_bad_rows_leave_no_trace(spark, tmp_path, bad):
    store = Versions(spark, f"file://{tmp_path}/s")
    meetings, segments = frames(spark, 2)
    save_meetings(store, meetings, segments)
    other = {"double": ([("x", "t"), ("x", "u")], [("n", "x", 1)]), "there": ([("x", "t")], [("s0-0", "x", 1)]), "orphan": ([("x", "t")], [("n", "m0", 1)]), "null": ([("x", "t"), (None, "t")], [("n", "x", 1)])}[bad]
    with pytest.raises(Exception, match="null, not new or without"):
        save_meetings(store, spark.createDataFrame(other[0], meetings.schema), spark.createDataFrame(other[1], segments.schema))
    assert store.version() == 1 and len(rows(store, "segments")) == 4


def test_writers_that_meet(spark, tmp_path):
    store = Versions(spark, f"file://{tmp_path}/s")
    one = spark.createDataFrame([(1,)], "n int")
    store.write({"a": one, "b": one})
    store.write({"a": one.selectExpr("n + 1 as n")}, since=1)
    with pytest.raises(Conflict):
        store.write({"a": one.selectExpr("n + 5 as n")}, since=1)
    assert rows(store, "a") == [(2,)] and rows(store, "b") == [(1,)]
    calls = []

    def add(a):
        calls.append(1)
        if len(calls) == 1:  # another writer comes first
            store.write({"a": a.selectExpr("n * 100 as n")})
        return {"a": a.selectExpr("n + 1 as n")}

    assert store.change("a", by=add) == 4 and rows(store, "a") == [(201,)]
    with pytest.raises(KeyError):
        store.read("c")


@pytest.mark.parametrize("step", [None, 0, 1, 2])
def test_last_write_wins_over_failures(spark, tmp_path, step):
    """The second of four files fails at some step; the query is started again from its checkpoint."""
    table = spark.createDataFrame([(k % 7, n, f"v{n}") for n, k in enumerate(range(60))], "k int, n int, v string")
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    store = Versions(spark, f"file://{tmp_path}/out")
    run = lambda: jobs.last_write_wins(jobs.source(spark, source), store, "t", ["k"], "n", check, buckets=4)
    for low in (0, 15, 30, 45):
        table.where(f"n >= {low} and n < {low + 15}").coalesce(1).write.mode("append").parquet(source)
        if low == 15 and step is not None:
            with pytest.MonkeyPatch.context() as m:
                stopping(m, step)
                with pytest.raises(Exception):
                    run()
            assert {r["n"] for r in store.read("t").collect()} == set(range(8, 15))
        run()
        assert sorted(r["n"] for r in store.read("t").collect()) == list(range(low + 8, low + 15))
    # a batch that comes again changes nothing
    version = store.version()
    assert store.merge("t", table.where("n < 3"), ["k"], "n", check, 3, 4) == version
    store.merge("t", table.where("n < 3"), ["k"], "n", "other", 0, 4)
    assert sorted(r["n"] for r in store.read("t").collect()) == list(range(53, 60))


def test_summary_states(spark):
    log = [("a", 1, "start", None, None), ("a", 2, "completed", 1, "one"), ("a", 3, "start", None, None), ("a", 4, "failed", 3, None), ("b", 1, "start", None, None), ("b", 2, "start", None, None), ("b", 3, "completed", 1, "late"), ("c", 1, "completed", 1, "none"), ("d", 1, "start", None, None), ("d", 2, "cancelled", 1, None), ("d", 3, "completed", 1, "too late"), ("e", 1, "start", None, None), ("e", 2, "completed", 1, "x"), ("e", 3, "start", None, None)]
    table = spark.createDataFrame(log, "m string, t bigint, kind string, run bigint, summary string")
    got = {r["m"]: tuple(r[1:]) for r in merges.summary_states(table, "m", "t", "t").collect()}
    assert got == {"a": ("failed", 3, "one", None), "b": ("pending", 2, None, None), "c": ("none", None, None, None), "d": ("cancelled", 1, None, None), "e": ("pending", 3, "x", "x")}
