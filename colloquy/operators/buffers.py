"""Buffers of the live path: batches by count or time, jitter buffers, checkpoints that back off and drop.

Times are milliseconds. Each keeps a few numbers of a key; a key is one task's sorted run of rows, never gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from colloquy.functions.arrow import fold_in_order

BATCH = "first_at bigint, last_at bigint, closed_at bigint, n bigint, total double, full boolean"


def batches(rows: DataFrame, key: str, at: str, tie: str, value: str, size: int = 50, wait: int = 5_000) -> DataFrame:
    """(key, first_at, last_at, closed_at, n, total, full): batches that close with their ``size``-th row, or once no row has
    come for ``wait``. A row that comes just then begins the next one. Time goes on behind a key's last row. Rows whose key
    or time is null are left out; a null value adds nothing."""
    rows = rows.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, F.col(at).cast("bigint").alias("at"), F.col(tie).alias("tie"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))
    order = Window.partitionBy(key).orderBy("at", "tie")
    idle = F.coalesce(F.col("at") - F.lag("at").over(order) >= wait, F.lit(False)).cast("bigint")
    bursts = rows.withColumn("idle", idle).withColumn("burst", F.sum("idle").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy(key, "burst").orderBy("at", "tie")) - 1
    dealt = bursts.withColumn("batch", F.floor(place / size)).groupBy(key, "burst", "batch")
    full = F.col("n") == size
    out = dealt.agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("n"), F.sum("v").alias("total"))
    return out.select(key, "first_at", "last_at", (F.col("last_at") + F.when(full, 0).otherwise(wait)).alias("closed_at"), "n", "total", full.alias("full"))


class Batcher(StatefulProcessor):
    """The open batch of a key in a value state, and a timer for when nobody adds to it."""

    def __init__(self, key: str, at: str, tie: str, value: str, size: int, wait: int):
        self.names, self.size, self.wait = (key, at, tie, value), size, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "n bigint, first_at bigint, last_at bigint, total double")

    def _rows(self, key, out):
        made = pd.DataFrame(out, columns=[f.split()[0] for f in BATCH.split(", ")])
        made.insert(0, self.names[0], pd.Series([key[0]] * len(out), dtype=object))
        return made

    def _closed(self, batch):
        n, first, last, total = batch
        return (first, last, last + (0 if n == self.size else self.wait), n, total, n == self.size)

    def handleInputRows(self, key, rows, timerValues):
        _, at, tie, value = self.names
        batch, out = self.state.get() if self.state.exists() else None, []
        if batch:
            self.handle.deleteTimer(batch[2] + self.wait)
        for t, v in pd.concat(list(rows), ignore_index=True).sort_values([at, tie])[[at, value]].itertuples(index=False):
            if batch and t - batch[2] >= self.wait:
                out.append(self._closed(batch))
                batch = None
            n, first, _, total = batch or (0, t, t, 0.0)
            batch = (n + 1, int(first), int(t), total + (0.0 if pd.isna(v) else float(v)))
            if batch[0] == self.size:
                out.append(self._closed(batch))
                batch = None
        if batch:
            self.state.update(batch)
            self.handle.registerTimer(batch[2] + self.wait)
        else:
            self.state.clear()
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        out = [self._closed(self.state.get())] if self.state.exists() else []
        self.state.clear()
        yield self._rows(key, out)


def batches_stream(rows: DataFrame, key: str, at: str, tie: str, value: str, time: str, size: int = 50, wait: int = 5_000, late_ms: int = 1000) -> DataFrame:
    """``batches`` over a stream; ``time`` is ``at`` as a timestamp. A key's rows must come in order of time from one
    micro-batch to the next. Needs the RocksDB state store."""
    kept = rows.withWatermark(time, f"{late_ms} milliseconds").where(F.col(key).isNotNull() & F.col(at).isNotNull())
    kind = rows.schema[key].dataType.simpleString()
    return kept.groupBy(key).transformWithStateInPandas(Batcher(key, at, tie, value, size, wait), f"{key} {kind}, {BATCH}", "Append", "EventTime")


def jitter_reads(chunks: DataFrame, reads: DataFrame, key: str, timeout: int) -> DataFrame:
    """(key, at, given, silence, left): what each read (key, at, n) gets from a buffer of chunks (key, at, n).

    Nothing (null) is given as long as the oldest chunk in the buffer is younger than ``timeout``; then ``n`` samples are,
    with silence for those that have not come. A chunk that comes at the time of a read is there. ``left`` is what stays.
    Samples are counted, not held: how many have come, how many of them are old enough, how many are taken. Rows with a null
    are left out.
    """
    tell = lambda rows, kind, n: rows.dropna(subset=[key, "at", "n"]).select(key, F.col("at").cast("bigint").alias("at"), F.lit(kind).alias("kind"), n.cast("bigint").alias("n"))
    fresh, asks = tell(chunks, 0, F.col("n")), tell(reads, 2, F.col("n"))
    log = fresh.unionByName(fresh.select(key, (F.col("at") + timeout).alias("at"), F.lit(1).alias("kind"), "n")).unionByName(asks)

    def step(state, row):
        come, old, taken = state or (0, 0, 0)
        n = row["n"]
        if row["kind"] == 0:
            return (come + n, old, taken), []
        if row["kind"] == 1:
            return (come, old + n, taken), []
        if old <= taken:
            return (come, old, taken), [(row["at"], None, 0, come - taken)]
        given = min(n, come - taken)
        return (come, old, taken + given), [(row["at"], given, n - given, come - taken - given)]

    return fold_in_order(log, [key], ["at", "kind", "n"], ["at", "kind", "n"], step, lambda state: [], "at bigint, given bigint, silence bigint, left bigint")


@dataclass(frozen=True)
class SaverRules:
    """Seconds of audio for a checkpoint and in memory at most; milliseconds before another try, doubled to the last."""

    rate: int = 48_000
    checkpoint_s: int = 30
    most_s: int = 600
    first_retry: int = 5_000
    last_retry: int = 60_000


def checkpoints(log: DataFrame, key: str, order: list[str], rules: SaverRules = SaverRules()) -> DataFrame:
    """(key, at, event, checkpoint, samples, pending, dropped, retry_at): the writes of a saver, from rows (key, at, n, ok) of
    ``n`` samples each; ``ok`` tells whether a write at that time works.

    ``written``: all that is pending, as checkpoint number ``checkpoint``. ``failed``: nothing is lost, and it is not tried
    again before ``retry_at``. ``waits``: samples came before then. Beyond ``most_s`` the oldest pending samples are
    ``dropped``. ``rest``: what a key's end leaves pending. Rows that make no checkpoint due make no row. Rows with a null
    time or count are left out; a null ``ok`` is a failure.
    """
    due, most = rules.rate * rules.checkpoint_s, rules.rate * rules.most_s

    def step(state, row):
        pending, failures, retry_at, number, _ = state or (0, 0, None, 0, 0)
        at = row["at"]
        pending += row["n"]
        if pending < due:
            return (pending, failures, retry_at, number, at), []
        if retry_at is not None and at < retry_at:
            event = "waits"
        elif row["ok"]:
            return (0, 0, None, number + 1, at), [(at, "written", number, pending, 0, 0, None)]
        else:
            event, failures = "failed", failures + 1
            retry_at = at + min(rules.first_retry * 2 ** min(failures - 1, 4), rules.last_retry)
        dropped = max(0, pending - most)
        pending -= dropped
        return (pending, failures, retry_at, number, at), [(at, event, None, 0, pending, dropped, retry_at)]

    def finish(state):
        pending, _, _, number, at = state
        return [(at, "rest", number, pending, 0, 0, None)] if pending else []

    rows = log.dropna(subset=[key, "at", "n"])
    return fold_in_order(rows, [key], order, ["at", "n", "ok"], step, finish, "at bigint, event string, checkpoint int, samples bigint, pending bigint, dropped bigint, retry_at bigint")
