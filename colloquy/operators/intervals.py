"""Interval analytics: merging, union lengths, overlap joins with nearest fallback, clock maps, label stability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.arrow import by_key


def merge_runs(rows: DataFrame, keys: list[str], start: str, end: str, min_gap: int, min_length: int) -> DataFrame:
    """Joins intervals of a key whose gap is below ``min_gap`` and keeps those longer than ``min_length``."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(before.isNull() | (F.col(start) - before >= min_gap), 1).otherwise(0)
    numbered = rows.withColumn("__begins", begins).withColumn("__island", F.sum("__begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")
    return merged.where(F.col(end) - F.col(start) > min_length)


def union_length(rows: DataFrame, keys: list[str], start: str, end: str, name: str) -> DataFrame:
    """Length that the intervals of a key cover; what several cover counts once, touching ones join."""
    order = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(end).over(order)
    own = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.coalesce(reach, F.col(start))))
    return rows.withColumn("__own", own).groupBy(*keys).agg(F.sum("__own").alias(name))


def speaker_rank(turns: DataFrame) -> DataFrame:
    """Speakers of each meeting numbered from 0 by their first turn."""
    first = turns.groupBy("meeting_id", "speaker_key").agg(F.min(F.struct("start_ms", "end_ms", "speaker_key")).alias("first"))
    return first.select("meeting_id", "speaker_key", (F.row_number().over(Window.partitionBy("meeting_id").orderBy("first")) - 1).alias("speaker_index"))


def time_buckets(rows: DataFrame, start: Column, end: Column, width_ms: int) -> DataFrame:
    """A row for each bucket that an interval touches: overlap joins then have an equality to hash on, in long meetings too."""
    first, last = F.floor(start / width_ms).cast("long"), F.floor(end / width_ms).cast("long")
    return rows.withColumn("bucket", F.explode(F.sequence(first, F.greatest(first, last))))


def assign_speakers(segments: DataFrame, turns: DataFrame, nearest_ms: int = 1000, bucket_ms: int = 60_000) -> DataFrame:
    """The speaker who overlaps each segment most: meeting_id, id, speaker_key, overlap (of the segment, 1 at most).

    Ties go to the speaker who speaks first in the meeting. A segment without overlap takes the nearest turn within
    ``nearest_ms``, overlap 0; ties go to the earlier turn. Others, and empty segments, are dropped.
    """
    seg = segments.where("end_ms > start_ms").select("meeting_id", "id", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    turn = turns.join(speaker_rank(turns), ["meeting_id", "speaker_key"]).select("meeting_id", "speaker_key", "speaker_index", F.col("start_ms").alias("ts"), F.col("end_ms").alias("te"))
    # a margin on the turns' side brings the nearest turns into the same buckets
    left = time_buckets(seg, F.col("s"), F.col("e"), bucket_ms)
    right = time_buckets(turn, F.col("ts") - nearest_ms, F.col("te") + nearest_ms, bucket_ms)
    both = left.join(right, ["meeting_id", "bucket"]).where((F.col("ts") - nearest_ms <= F.col("e")) & (F.col("te") + nearest_ms >= F.col("s")))
    # a pair that meets in several buckets counts in each the time within it
    part = F.greatest(F.lit(0), F.least("e", "te", (F.col("bucket") + 1) * bucket_ms) - F.greatest("s", "ts", F.col("bucket") * bucket_ms))
    gap = F.greatest(F.lit(0), F.greatest(F.col("ts") - F.col("e"), F.col("s") - F.col("te")))
    # dealt once by segment: sums and ranks need no other shuffle
    by_speaker = both.withColumn("part", part).withColumn("gap", gap).repartition("meeting_id", "id").groupBy("meeting_id", "id", "s", "e", "speaker_key", "speaker_index").agg(F.sum("part").alias("total"), F.min(F.struct("gap", "ts", "te")).alias("near"))
    best = Window.partitionBy("meeting_id", "id").orderBy(F.desc("total"), F.when(F.col("total") > 0, F.col("speaker_index")), "near.gap", "near.ts", "speaker_index")
    ranked = by_speaker.withColumn("r", F.row_number().over(best)).where("r = 1 and (total > 0 or near.gap <= %d)" % nearest_ms)
    return ranked.select("meeting_id", "id", "speaker_key", F.least(F.lit(1.0), F.col("total") / (F.col("e") - F.col("s"))).alias("overlap"))


def file_to_transcript(seconds: Column, chunk_samples: int = 1_440_000, sample_rate: int = 48_000, frame: int = 1024) -> Column:
    """Maps audio-file time to transcript time: each encoded chunk has a priming frame and padding that the transcript lacks."""
    padded = frame + -(-chunk_samples // frame) * frame
    sample = seconds * sample_rate
    k = F.floor(sample / padded)
    inside = F.least(F.greatest(sample - k * padded - frame, F.lit(0.0)), F.lit(float(chunk_samples)))
    return (k * chunk_samples + inside) / sample_rate


def overlap_matrix(new: DataFrame, old: DataFrame, bucket_ms: int = 60_000) -> DataFrame:
    """Milliseconds for which each new speaker and each previous key overlap: meeting_id, speaker, speaker_key, overlap_ms.

    Turns meet in the buckets that they touch, and each bucket counts the part within it.
    """
    n = time_buckets(new.select("meeting_id", "speaker", F.col("start_ms").alias("s"), F.col("end_ms").alias("e")), F.col("s"), F.col("e"), bucket_ms)
    o = time_buckets(old.select("meeting_id", "speaker_key", F.col("start_ms").alias("ts"), F.col("end_ms").alias("te")), F.col("ts"), F.col("te"), bucket_ms)
    part = F.least("e", "te", (F.col("bucket") + 1) * bucket_ms) - F.greatest("s", "ts", F.col("bucket") * bucket_ms)
    both = n.join(o, ["meeting_id", "bucket"]).withColumn("part", part).where("part > 0")
    return both.groupBy("meeting_id", "speaker", "speaker_key").agg(F.sum("part").alias("overlap_ms"))


def stable_labels(matrix: DataFrame, speakers: DataFrame, previous: DataFrame) -> DataFrame:
    """Gives new speakers the previous keys they overlap most, one to one; others get the lowest unused ``S<n>``.

    ``speakers``: meeting_id, n (how many, numbered from 0); ``previous``: meeting_id, speaker_key. One task per meeting
    reads its few speakers, not its turns.
    """
    rows = matrix.select("meeting_id", F.lit("o").alias("kind"), "speaker", "speaker_key", "overlap_ms")
    rows = rows.unionByName(speakers.select("meeting_id", F.lit("n").alias("kind"), F.col("n").cast("int").alias("speaker"), F.lit(None).cast("string").alias("speaker_key"), F.lit(0).cast("long").alias("overlap_ms")))
    rows = rows.unionByName(previous.select("meeting_id", F.lit("p").alias("kind"), F.lit(0).alias("speaker"), "speaker_key", F.lit(0).cast("long").alias("overlap_ms")).distinct())

    def label(found):
        size = max((x["speaker"] for x in found if x["kind"] == "n" and x["speaker"] is not None), default=0)
        known = {x["speaker_key"] for x in found if x["kind"] == "p"}
        got: dict[int, str] = {}
        for x in sorted((x for x in found if x["kind"] == "o"), key=lambda x: (-x["overlap_ms"], x["speaker"], x["speaker_key"])):
            if x["speaker"] not in got and x["speaker_key"] not in got.values() and x["overlap_ms"] > 0:
                got[x["speaker"]] = x["speaker_key"]
        free = (f"S{i}" for i in range(1, 10**6) if f"S{i}" not in known)
        return [(i, got[i] if i in got else next(free)) for i in range(size)]

    return by_key(rows, ["meeting_id"], ["kind", "speaker", "speaker_key", "overlap_ms"], label, "speaker int, speaker_key string")


def best_speakers(matrix: DataFrame) -> DataFrame:
    """(meeting_id, speaker, speaker_key): each speaker of an overlap matrix with one key at most, so that most time is shared.

    Pairs without common time are left out. One task per meeting reads its few speakers.
    """
    import numpy as np

    from colloquy.operators.vectors import best_mapping

    def run(found):
        shared: dict = {}
        for x in found:
            shared[x["speaker"], x["speaker_key"]] = shared.get((x["speaker"], x["speaker_key"]), 0) + x["overlap_ms"]
        speakers, keys = sorted({s for s, _ in shared}), sorted({k for _, k in shared})
        wide = np.array([[float(shared.get((s, k), 0)) for k in keys] + [0.0] * len(speakers) for s in speakers])
        return [(speakers[i], keys[g]) for i, g in enumerate(best_mapping(wide)) if g < len(keys) and wide[i, g] > 0]

    kinds = {f.name: f.dataType.simpleString() for f in matrix.schema}
    return by_key(matrix.dropna(subset=["speaker", "speaker_key"]), ["meeting_id"], ["speaker", "speaker_key", "overlap_ms"], run, f"speaker {kinds['speaker']}, speaker_key {kinds['speaker_key']}")
