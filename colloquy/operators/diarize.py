"""Who speaks when: from the activity of up to three local speakers in overlapping windows to turns of global speakers.

A window is a row with one number for each frame, whose bits tell which local speakers are active, as an array or, with much
less work, as binary with a byte for each frame; nothing has a row for each frame. What windows say about a stretch of time meets in tiles of ``TILE`` frames, so a long recording is spread over
tasks, and a tile meets only the windows that reach into it.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.arrow import fold_in_order, parts_of
from colloquy.operators import intervals as I
from colloquy.operators import vectors as V
from colloquy.sources.files import settled

LOCALS = 3
TILE = 512


@dataclass(frozen=True)
class Frames:
    """Sizes in samples: a window, the step between windows, and between frames; a frame's field is centred on it."""

    window: int = 160_000
    step: int = 48_000
    shift: int = 270
    field: int = 991
    rate: int = 16_000

    def millis(self, frame: Column) -> Column:
        return F.floor((frame * self.shift + self.field / 2) * 1000 / self.rate).cast("bigint")


def bit_of(local: Column) -> Column:
    return F.get(F.array(*(F.lit(1 << k) for k in range(LOCALS))), local)


def n_frames(windows: DataFrame) -> Column:
    return F.octet_length("activity") if windows.schema["activity"].dataType.simpleString() == "binary" else F.size("activity")


def frames_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The frames of all rows, one row after the other, and how many each row has."""
    if pa.types.is_binary(column.type):
        size, (_, at, data) = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.buffers()
        first = int(np.frombuffer(at, np.int32)[column.offset]) if len(column) else 0
        return np.frombuffer(data or b"", np.uint8)[first : first + size.sum()], size
    return column.flatten().fill_null(0).to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def embed_jobs(windows: DataFrame, how: Frames = Frames(), least: int = 10) -> DataFrame:
    """(recording, window, local, clean, ranges) for each local speaker who speaks alone in ``least`` frames of a window.

    ``ranges`` are the runs of those frames as samples of the recording, from the first to behind the last; a run up to the
    window's end stops at its last frame. Windows without frames, or with null ones, have no jobs.
    """
    kind = windows.schema["recording"].dataType.simpleString()
    start = windows.schema["window"].dataType.simpleString()
    rows = windows.where(n_frames(windows) > 0).select("recording", "window", "activity")
    return rows.mapInArrow(functools.partial(_jobs, how, least), f"recording {kind}, window {start}, local int, clean int, ranges array<struct<start:bigint,end:bigint>>")


def _jobs(how: Frames, least: int, batches):
    for batch in parts_of(batches, 1 << 20):
        mask, size = frames_of(batch.column("activity"))
        first, window = np.concatenate([[0], np.cumsum(size)]), batch.column("window").to_numpy().astype(np.int64)
        rows = np.repeat(np.arange(len(size)), size)
        out = []
        for local in range(LOCALS):
            on = mask == 1 << local
            clean = np.bincount(rows[on], minlength=len(size))
            keep = clean >= least
            # a run begins where the frame before is off or of another window, and likewise ends
            here = np.flatnonzero(on & keep[rows])
            new = np.diff(here, prepend=-2) != 1
            new[1:] |= rows[here[1:]] != rows[here[:-1]]
            head = np.flatnonzero(new)
            begins, ends = here[head], here[np.append(head[1:], len(here)) - 1] + 1 if len(here) else here
            row = rows[begins]
            sample = lambda k: (np.floor(k / size[row] * how.window)).astype(np.int64) + window[row] * how.step
            out.append((np.flatnonzero(keep), clean[keep], np.bincount(row, minlength=len(size))[keep], sample(begins - first[row]), sample(np.minimum(ends - first[row], size[row] - 1))))
        picked, clean, count, begins, ends = (np.concatenate(x) for x in zip(*out))
        local = np.repeat(np.arange(LOCALS, dtype=np.int32), [len(x[0]) for x in out])
        spans = pa.StructArray.from_arrays([pa.array(begins), pa.array(ends)], ["start", "end"])
        ranges = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), spans)
        at = pa.array(picked)
        yield pa.RecordBatch.from_arrays([batch.column("recording").take(at), batch.column("window").take(at), pa.array(local), pa.array(clean.astype(np.int32)), ranges], ["recording", "window", "local", "clean", "ranges"])


def speaker_runs(windows: DataFrame, mapping: DataFrame, lengths: DataFrame, how: Frames = Frames()) -> DataFrame:
    """(recording, speaker, first, end): runs of frames, cut at tiles, in which a global speaker is active.

    ``mapping``: (recording, window, local, speaker); ``lengths``: (recording, samples). A frame has as many speakers as its
    windows' mean number of active locals, rounded half up, those with the most votes (ties: the smaller number) and at
    least one. Frames behind the recording's end are left out.
    """
    named = mapping.groupBy("recording", "window").agg(F.collect_list(F.struct(F.col("local").cast("int").alias("local"), F.col("speaker").cast("bigint").alias("speaker"))).alias("names"))
    # arrays take much more room than their files say: never sent to the driver
    known = windows.join(named.hint("merge"), ["recording", "window"], "left").join(lengths.hint("merge"), "recording")
    first = F.floor(F.col("window") * how.step / how.shift + 0.5).cast("bigint")
    placed = known.where(n_frames(windows) > 0).select("recording", "activity", "names", first.alias("first"), n_frames(windows).alias("n"), F.floor(F.col("samples") / how.shift).alias("last"))
    tiles = placed.withColumn("tile", F.explode(F.sequence(F.floor(F.col("first") / TILE), F.floor((F.col("first") + F.col("n") - 1) / TILE))))
    skip = F.greatest(F.lit(0), F.col("tile") * TILE - F.col("first")).cast("int")
    at = F.greatest(F.lit(0), F.col("first") - F.col("tile") * TILE).cast("int")
    cut = F.substring if windows.schema["activity"].dataType.simpleString() == "binary" else F.slice
    part = cut("activity", skip + 1, F.lit(TILE) - at)
    gathered = tiles.groupBy("recording", "tile").agg(F.max("last").alias("last"), F.collect_list(F.struct(at.alias("at"), part.alias("part"), "names")).alias("parts"))
    kind = windows.schema["recording"].dataType.simpleString()
    return gathered.mapInArrow(_vote, f"recording {kind}, speaker bigint, first bigint, end bigint")


def _vote(batches):
    for batch in parts_of(batches, 1 << 19):
        column = batch.column("parts")
        parts, n = column.flatten(), batch.num_rows
        masks, size = frames_of(parts.field("part"))
        tile = np.repeat(np.arange(n), np.diff(column.offsets.to_numpy()))
        first, at = np.cumsum(size) - size, parts.field("at").to_numpy(zero_copy_only=False).astype(np.int64)
        cells = np.repeat(tile * TILE + at - first, size) + np.arange(len(masks))
        covered = np.bincount(cells, minlength=n * TILE)
        active = np.bincount(cells, np.bitwise_count(masks), n * TILE)
        many = np.floor(active / np.maximum(covered, 1) + 0.5).reshape(n, TILE)
        # a line of votes for each speaker who is named in a tile, by tile and speaker
        names = parts.field("names")
        part = np.repeat(np.arange(len(parts)), names.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        local, speaker = (names.flatten().field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("local", "speaker"))
        order = np.lexsort((speaker, tile[part]))
        part, local, speaker = part[order], local[order], speaker[order]
        new = np.ones(len(part), bool)
        new[1:] = (np.diff(tile[part]) != 0) | (np.diff(speaker) != 0)
        line, who, where = np.cumsum(new) - 1, speaker[new], tile[part][new]
        if not len(who):
            continue
        long = size[part]
        frame = np.repeat(first[part] - (np.cumsum(long) - long), long) + np.arange(long.sum())
        said = masks[frame] >> np.repeat(local, long) & 1
        votes = np.bincount(np.repeat(line * TILE + at[part] - first[part], long) + frame, said, len(who) * TILE).reshape(-1, TILE)
        # a speaker's place is the number of those in the tile with more votes, or as many and a smaller number
        place = np.zeros(votes.shape, np.int64)
        begin = np.searchsorted(where, where)
        count = np.searchsorted(where, where, "right") - begin
        for k in np.unique(count):
            of = np.flatnonzero((count == k) & (begin == np.arange(len(where))))[:, None] + np.arange(k)
            place[of] = np.argsort(np.argsort(-votes[of], axis=1, kind="stable"), axis=1, kind="stable")
        on = (place < many[where]) & (votes > 0)
        index, last = (batch.column(c).to_numpy().astype(np.int64)[where] for c in ("tile", "last"))
        on &= index[:, None] * TILE + np.arange(TILE) <= last[:, None]
        edge = np.diff(np.pad(on.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, start = np.nonzero(edge == 1)
        _, stop = np.nonzero(edge == -1)
        if len(row):
            yield pa.RecordBatch.from_arrays([batch.column("recording").take(pa.array(where[row])), *(pa.array(x) for x in (who[row], start + index[row] * TILE, stop + index[row] * TILE))], ["recording", "speaker", "first", "end"])


def speaker_turns(runs: DataFrame, how: Frames = Frames(), min_on_ms: int = 100, min_off_ms: int = 500) -> DataFrame:
    """(recording, speaker, start_ms, end_ms): runs of a speaker less than ``min_off_ms`` apart joined, those over
    ``min_on_ms`` kept. Speakers are numbered anew from 0 by their first turn (ties: the smaller number)."""
    spans = runs.select("recording", "speaker", (F.col("first") * how.shift).alias("start"), (F.col("end") * how.shift).alias("stop"))
    turns = I.merge_runs(spans, ["recording", "speaker"], "start", "stop", min_off_ms * how.rate // 1000, min_on_ms * how.rate // 1000)
    # windows over the turns, so that what they are made of isn't worked out once more for a join
    begun = turns.withColumn("begin", F.min("start").over(Window.partitionBy("recording", "speaker")))
    number = (F.dense_rank().over(Window.partitionBy("recording").orderBy("begin", "speaker")) - 1).cast("bigint")
    frame = lambda c: how.millis((F.col(c) / how.shift))
    return begun.withColumn("number", number).select("recording", F.col("number").alias("speaker"), frame("start").alias("start_ms"), frame("stop").alias("end_ms"))


def global_speakers(items: DataFrame, threshold: float = 0.6, long: int = 60, min_size: int = 4, min_share: float = 0.02) -> DataFrame:
    """(recording, window, local, speaker) for embedded jobs (recording, window, local, clean, e).

    Jobs of at least ``long`` clean frames, all if there are fewer than two, are clustered by average linkage; small clusters
    are folded into the most similar large one; each window's locals are mapped one to one to the clusters' centroids, so
    that their similarity in all is largest. One task holds the vectors of a recording's jobs that are clustered.
    """
    def step(state, row):
        # by falling ``clean``: the first two rows tell whether there are two long ones
        held, n_long = state or ([], 0)
        n_long += row["clean"] >= long
        if n_long < 2 or row["clean"] >= long:
            held.append((row["window"] * LOCALS + row["local"], row["clean"], row["e"]))
        return (held, n_long), []

    def finish(state):
        # clusters are numbered by their first job
        _, clean, vectors = zip(*sorted(state[0], key=lambda x: x[0]))
        return V.voices(np.array(vectors, float), np.array(clean, float), threshold, min_size, min_share)

    reads = ["window", "local", "clean", "e"]
    cents = fold_in_order(items.select("recording", *reads), ["recording"], [F.desc("clean"), "window", "local"], reads, step, finish, "speaker bigint, centroid array<double>")
    return V.map_windows(items, cents, "recording", "window", "local", "e")


def diarize(windows: DataFrame, embedded: DataFrame, lengths: DataFrame, how: Frames = Frames(), min_on_ms: int = 100, min_off_ms: int = 500, **clustering) -> DataFrame:
    """(recording, speaker, start_ms, end_ms) from windows (recording, window, activity), the embeddings of their jobs
    (recording, window, local, clean, e) and the recordings' lengths in samples. Recordings without a job have no turns."""
    mapping = settled(global_speakers(settled(embedded, "embedded"), **clustering), "speakers")
    return speaker_turns(speaker_runs(windows, mapping, lengths, how), how, min_on_ms, min_off_ms)


def count_errors(reference: DataFrame, hypothesis: DataFrame) -> DataFrame:
    """(recording, speech, missed, false_alarm, confused) in frames, from runs (recording, who, s, e) of frames that do not
    overlap for one ``who``; a hypothesis is right where the reference has the same ``who``.

    Turn boundaries are events of +1 and -1; running sums over them tell how many speak and how many are right in each
    stretch, so nothing has a row for each frame.
    """
    edges = lambda rows, r, h: rows.select("recording", "who", F.explode(F.array(F.struct(F.col("s").alias("t"), F.lit(r).alias("dr"), F.lit(h).alias("dh")), F.struct(F.col("e").alias("t"), F.lit(-r).alias("dr"), F.lit(-h).alias("dh")))).alias("x")).select("recording", "who", "x.*")
    steps = edges(reference, 1, 0).unionByName(edges(hypothesis, 0, 1)).groupBy("recording", "who", "t").agg(F.sum("dr").alias("dr"), F.sum("dh").alias("dh"))
    own = Window.partitionBy("recording", "who").orderBy("t")
    right = steps.withColumn("both", F.sum("dr").over(own) * F.sum("dh").over(own)).withColumn("dc", F.col("both") - F.coalesce(F.lag("both").over(own), F.lit(0)))
    moments = right.groupBy("recording", "t").agg(F.sum("dr").alias("dr"), F.sum("dh").alias("dh"), F.sum("dc").alias("dc"))
    order = Window.partitionBy("recording").orderBy("t")
    run = moments.select("recording", (F.lead("t").over(order) - F.col("t")).alias("n"), *(F.sum(f"d{k}").over(order).alias(k) for k in "rhc"))
    total = lambda c, name: F.coalesce(F.sum(F.col("n") * c), F.lit(0)).cast("bigint").alias(name)
    return run.groupBy("recording").agg(total(F.col("r"), "speech"), total(F.greatest(F.col("r") - F.col("h"), F.lit(0)), "missed"), total(F.greatest(F.col("h") - F.col("r"), F.lit(0)), "false_alarm"), total(F.least("r", "h") - F.col("c"), "confused"))


def error_rate(reference: DataFrame, hypothesis: DataFrame, frame_ms: int = 10) -> DataFrame:
    """(recording, speech, missed, false_alarm, confused, rate), in frames of ``frame_ms``, without a collar.

    Both sides are turns (recording, speaker, start_ms, end_ms). Hypothesis speakers stand for the reference speakers that
    the mapping with the most shared time gives them; each stands for one at most. Overlapping turns of one speaker count
    once. ``speech`` counts each reference speaker, ``rate`` is the errors' share of it (of one frame, if there is none).
    """
    frame = lambda c: F.floor((F.col(c) + frame_ms / 2) / frame_ms).cast("bigint")
    quantised = lambda rows: rows.select("recording", "speaker", F.greatest(frame("start_ms"), F.lit(0)).alias("s"), F.greatest(frame("end_ms"), F.lit(0)).alias("e")).where("e > s")
    ref, hyp = (I.merge_runs(quantised(x), ["recording", "speaker"], "s", "e", 1, 0) for x in (reference, hypothesis))
    shared = I.overlap_matrix(hyp.select(F.col("recording").alias("meeting_id"), "speaker", F.col("s").alias("start_ms"), F.col("e").alias("end_ms")), ref.select(F.col("recording").alias("meeting_id"), F.col("speaker").alias("speaker_key"), F.col("s").alias("start_ms"), F.col("e").alias("end_ms")))
    mapping = I.best_speakers(shared).select(F.col("meeting_id").alias("recording"), "speaker", F.col("speaker_key").alias("stands_for"))
    named = hyp.join(mapping, ["recording", "speaker"], "left")
    # one name for each reference speaker and for each hypothesis speaker that stands for none
    who = F.when(F.col("stands_for").isNotNull(), F.struct(F.lit(True).alias("known"), F.col("stands_for").cast("string").alias("name"))).otherwise(F.struct(F.lit(False).alias("known"), F.col("speaker").cast("string").alias("name")))
    sums = count_errors(ref.withColumn("who", F.struct(F.lit(True).alias("known"), F.col("speaker").cast("string").alias("name"))), named.withColumn("who", who))
    return sums.withColumn("rate", (F.col("missed") + F.col("false_alarm") + F.col("confused")) / F.greatest("speech", F.lit(1)))
