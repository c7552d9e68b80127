"""Stream operators: the batch folds they equal, and Structured Streaming queries."""

from __future__ import annotations

import io

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.arrow import in_order


def rate_limited(rows: DataFrame, key: str, time: str, tie: str, interval: int) -> DataFrame:
    """Rows that a limiter lets through: each is at least ``interval`` after the last one that it let through.

    A scan of the key's rows in order of time, which keeps the last time only.
    """

    def step(last, row):
        goes = last is None or row[time] - last >= interval
        return (row[time] if goes else last), goes

    return in_order(rows.select(key, time, tie), [key], [time, tie], [time], step, "goes", "boolean").where("goes").select(key, tie)


def health_states(rows: DataFrame, key: str, time: str, kind: str, stall: int = 30_000_000_000) -> DataFrame:
    """State after each stretch of events: Running, Degraded after an error, Dead after three errors in a row or a stall."""
    order = Window.partitionBy(key).orderBy(time)
    error = (F.col(kind) == "error").cast("int")
    good = F.sum(1 - error).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = rows.withColumn("__g", good).withColumn("__e", error)
    streak = F.sum("__e").over(Window.partitionBy(key, "__g").orderBy(time).rowsBetween(Window.unboundedPreceding, 0))
    gap = F.lead(time).over(order) - F.col(time)
    state = F.when((streak >= 3) | (gap > stall), "Dead").when(streak >= 1, "Degraded").otherwise("Running")
    return marked.withColumn("state", state).groupBy(key, "state").agg(F.count("*").alias("n"))


def two_streams(rows: DataFrame, device: Column, time: Column, value: Column, window_ms: int = 600) -> DataFrame:
    """Tumbling windows in which both devices' samples meet; what one lacks is silence. Works on batches and on streams."""
    w = rows.select(device.alias("device"), time.alias("at"), value.alias("v")).groupBy(F.window("at", f"{window_ms} milliseconds"))
    return w.agg(F.coalesce(F.sum(F.when(F.col("device") == "mic", F.col("v"))), F.lit(0.0)).alias("mic"), F.coalesce(F.sum(F.when(F.col("device") == "system", F.col("v"))), F.lit(0.0)).alias("system"), F.count("*").alias("n"))


def speech_sessions(rows: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    """Sessions of a key's speech frames that end with a gap. Works on batches and on streams."""
    return rows.groupBy(key, F.session_window(time, gap)).agg(F.min(time).alias("first_at"), F.max(time).alias("last_at"), F.count("*").alias("frames"))


def split_sessions(sessions: DataFrame, longest_s: int) -> DataFrame:
    """Pieces of at most ``longest_s`` seconds, as a session window has no maximum length."""
    first, last = F.unix_micros("first_at"), F.unix_micros("last_at")
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((last - first) / (longest_s * 1_000_000))))
    pieces = sessions.withColumn("piece", k)
    start = F.unix_micros("first_at") + F.col("piece") * longest_s * 1_000_000
    return pieces.select("*", start.alias("start_us"), F.least(start + longest_s * 1_000_000, F.unix_micros("last_at")).alias("end_us"))


def reordered(rows: DataFrame, session: str, sequence: str, start: str) -> DataFrame:
    """The reorder buffer's result once all has come: each sequence number once, the first to arrive, by (start, number)."""
    first = Window.partitionBy(session, sequence).orderBy("arrival")
    kept = rows.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(session).orderBy(start, sequence)))


def sentences(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Rows up to one that ends a sentence, as one: (key, sentence_no, text, final)."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ends = F.col(text).rlike(r"[.?!]\s*$")
    n = rows.withColumn("__end", ends.cast("int")).withColumn("sentence_no", F.coalesce(F.sum("__end").over(before), F.lit(0)))
    s = n.groupBy(key, "sentence_no").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("s"), F.bool_or(F.col("__end") == 1).alias("final"))
    return s.select(key, "sentence_no", F.array_join(F.transform("s", lambda x: x["t"]), " ").alias("text"), "final")


def overlapping_windows(rows: DataFrame, key: str, order: str, value: str, size: int, keep: int) -> DataFrame:
    """Buffers of ``size`` values, each beginning with the last ``keep`` of the one before."""
    i = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    step = size - keep
    numbered = rows.withColumn("__i", i)
    w = numbered.withColumn("buffer", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.ceil((F.col("__i") - size + 1) / step)), F.floor(F.col("__i") / step))))
    return w.groupBy(key, "buffer").agg(F.count("*").alias("n"), F.min("__i").cast("long").alias("first_index"), F.sum(value).alias("total"))


def reorder_stream(stream: DataFrame, session: str = "session_id", sequence: str = "sequence_id", wait_ms: int | None = 100) -> DataFrame:
    """Structured Streaming reorder buffer: emits contiguous numbers at once and others when they have waited ``wait_ms``.

    Keeps the first row of a number, and for each session the numbers that wait and the last one emitted. Without
    ``wait_ms``, numbers behind a gap wait for it to be filled, and the query can end when its source does.
    """
    schema = stream.schema
    names = schema.names

    def run(key, parts, state):
        last, waiting = state.get if state.exists else (0, "[]")
        held = pd.read_json(io.StringIO(waiting), orient="records", dtype=False) if waiting != "[]" else pd.DataFrame(columns=names)
        rows = pd.concat([held, *parts], ignore_index=True) if not state.hasTimedOut else held
        rows = rows[rows[sequence] > last].drop_duplicates(sequence).sort_values(sequence)
        out = []
        for r in rows.itertuples(index=False):
            if getattr(r, sequence) == last + 1 or state.hasTimedOut:
                out.append(r)
                last = int(getattr(r, sequence))
        rest = rows[rows[sequence] > last]
        state.update((last, rest.to_json(orient="records")))
        if len(rest) and wait_ms is not None:
            state.setTimeoutDuration(wait_ms)
        yield pd.DataFrame(out, columns=names)

    return stream.groupBy(session).applyInPandasWithState(run, schema, "last long, waiting string", "append", "NoTimeout" if wait_ms is None else "ProcessingTimeTimeout")
