"""Removal of repeated byte strings by distributed prefix doubling over sampled suffixes.

Suffixes are sampled by content: a position is kept if the gram there is the smallest of some ``reach`` grams in a row, so
equal strings keep the same positions but near their ends. The bytes between kept positions are phrases. A suffix's first
rank names its first two phrases; then, round by round, a rank is paired with that of the suffix as many phrases further
on, the pairs are ranked anew, and a suffix that has become unique is dropped. The last pairing ends at the threshold: it
reaches as far as a repeated string of ``window`` bytes surely does. What is left are the suffixes that may begin inside a
repeated string; the strings around each of them, a segment, are then compared over all their bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import _sketch
from colloquy.llm._bitset import filter_rows, set_bits, slot_of
from colloquy.llm._scratch import Scratch
from colloquy.llm._text import ByteNames, chunks, minimizers, mix, string_parts
from colloquy.llm.substring import covered, finish, runs_of


class Sampling:
    """How positions are sampled for strings of ``window`` bytes."""

    def __init__(self, window: int):
        if window < 2:
            raise ValueError("strings of two bytes at least")
        self.window = window
        self.reach = max(1, window // 5)
        self.gram = max(1, min(16, window // 25))
        #: A run of phrases from the first position that is surely kept is within the string up to this length.
        self.threshold = window - self.gram - 3 * self.reach + 3


class Suffixes:
    """The sampled suffixes of a run of texts: ``row`` numbers a suffix's text, ``number`` the sampled place within it."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, how: Sampling):
        self.names, self.window = ByteNames(raw, how.gram), how.window
        size = np.diff(offsets)
        # runs of grams within one text
        runs = np.where(size >= how.window, size - how.gram - how.reach + 2, 0)
        row = np.repeat(np.arange(len(size)), runs)
        start = np.arange(len(row)) + (offsets[:-1] - np.cumsum(runs) + runs)[row]
        found = minimizers(self.names.grams, how.reach)[start] if len(start) else np.zeros(0, np.int64)
        change = np.ones(len(found), bool)
        change[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
        at, row = found[change], row[change]
        begin, end = np.searchsorted(row, np.arange(len(size)), "left"), np.searchsorted(row, np.arange(len(size)), "right")
        index = np.arange(len(at))
        number, place = index - begin[row], at - offsets[row]
        phrases = np.minimum(np.searchsorted(at, at + how.threshold, "right"), end[row]) - 1 - index
        before = np.concatenate([[0], place[:-1] - how.reach + 2])[: len(place)]
        first = np.maximum(np.where(number == 0, 0, before), 0)
        count = np.maximum(np.minimum(place - how.reach + 1, size[row] - how.window) - first + 1, 0)
        used = np.flatnonzero(phrases > 0)
        phrases = phrases[used]
        self.row, self.number, self.place, self.first, self.count = row[used], number[used], place[used], first[used], count[used]
        self.base = offsets[self.row]
        self.span = at[used + np.minimum(phrases, 2)] - at[used]
        #: Rounds of doubling from two phrases on, and how many phrases further the last pairing reaches.
        self.rounds = np.maximum(np.frexp(phrases.astype(float))[1] - 2, 0)
        self.step = np.where(phrases > 1, phrases - (2 << self.rounds), 0)
        self.rank = self.names.of(at[used], at[used] + self.span)

    def segment(self, pick: np.ndarray) -> np.ndarray:
        """Names of all bytes that the strings of a segment cover."""
        out = np.zeros(len(pick), np.uint64)
        some = np.flatnonzero(self.count[pick])
        start = self.base[pick[some]] + self.first[pick[some]]
        out[some] = self.names.of(start, start + self.count[pick[some]] - 1 + self.window)
        return out


def _suffixes(batch: pa.RecordBatch, how: Sampling):
    """(first row, suffixes) of runs of texts, of which those count that hold a string of the window's size."""
    raw, offsets = string_parts(batch.column("text"))
    for a, b in chunks(offsets):
        if offsets[b] - offsets[a] >= how.window:
            yield a, Suffixes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], how)


COLUMNS = ["number", "place", "span", "rounds", "step", "rank", "first", "count", "segment"]


def _texts(keyed: DataFrame, scratch: Scratch):
    """Parts that make up the texts, each once, with column ``times``; and what their batches must be filtered by."""
    again = scratch.save(keyed.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key"), "again")
    if not again.take(1):
        return [(keyed.withColumn("times", F.lit(1)), None)]
    bits = set_bits(again)
    several = filter_rows(keyed, "key", bits).groupBy("key").agg(F.min("id").alias("id"), F.min("text").alias("text"), F.least(F.count("*"), F.lit(2)).cast("int").alias("times"))
    return [(keyed.withColumns({"times": F.lit(1), "slot": slot_of("key")}), bits), (several, None)]


def repeated_strings(keyed: DataFrame, how: Sampling, scratch: Scratch, group_rows: int) -> DataFrame:
    """(key, start, count): runs of strings that occur elsewhere; and with a negative count, (place, -span) of two phrases
    that also start in a document with a smaller id. ``keyed``: id, text, and a key that only equal rows share."""
    spark = keyed.sparkSession
    id_type = keyed.schema["id"].dataType.simpleString()
    parts = _texts(keyed, scratch)

    def left(batch, bits):
        return batch if bits is None else batch.filter(pa.array(~bits.among(batch.column("slot").to_numpy())))

    def ranks(bits):
        def run(batches):
            for batch in batches:
                batch = left(batch, bits)
                times, found, held = batch.column("times").to_numpy(), [], 0
                for row, s in _suffixes(batch, how):
                    found.append(np.repeat(s.rank, times[row + s.row]))
                    held += len(found[-1])
                    if held > 500_000:
                        yield _sketch.partial(np.concatenate(found))
                        found, held = [], 0
                if found:
                    yield _sketch.partial(np.concatenate(found))

        return run

    sketches = [part.mapInArrow(ranks(bits), _sketch.SCHEMA) for part, bits in parts]
    shared = spark.sparkContext.broadcast(_sketch.merge(sketches[0] if len(sketches) == 1 else sketches[0].unionByName(sketches[1]), scratch))
    kinds = [pa.int32()] * 5 + [pa.int64(), pa.int32(), pa.int32(), pa.int64()]

    def places(bits):
        def run(batches):
            for batch in batches:
                batch = left(batch, bits)
                row, columns, held = [], [[] for _ in COLUMNS], 0

                def flush():
                    at = pa.array(np.concatenate(row))
                    own = [batch.column(c).take(at) for c in ("key", "id", "times")]
                    return pa.RecordBatch.from_arrays(own + [pa.array(np.concatenate(c), kind) for c, kind in zip(columns, kinds)], ["key", "id", "times", *COLUMNS])

                for r, s in _suffixes(batch, how):
                    pick = np.flatnonzero(shared.value.among(s.rank))
                    if len(pick):
                        row.append(r + s.row[pick])
                        for c, v in zip(columns, (s.number, s.place, s.span, s.rounds, s.step, s.rank.view(np.int64), s.first, s.count)):
                            c.append(v[pick])
                        columns[-1].append(s.segment(pick).view(np.int64))
                        held += len(pick)
                    if held > 200_000:
                        yield flush()
                        row, columns, held = [], [[] for _ in COLUMNS], 0
                if row:
                    yield flush()

        return run

    schema = f"key bigint, id {id_type}, times int, number int, place int, span int, rounds int, step int, rank bigint, first int, count int, segment bigint"
    made = [part.mapInArrow(places(bits), schema) for part, bits in parts]
    suffixes = scratch.save(made[0] if len(made) == 1 else made[0].unionByName(made[1]), "suffixes")
    most = suffixes.agg(F.max("rounds")).first()[0]

    def repeated(level: DataFrame, name: str) -> DataFrame:
        """The rows whose rank is not unique, with the least id of the rank. The ranks are written before they are joined,
        so that Spark splits the tasks that a frequent string fills."""
        counts = scratch.save(level.groupBy("rank").agg(F.sum("times").alias("n"), F.min("id").alias("least")).where("n > 1").select("rank", "least"), f"ranks-{name}")
        return level.join(counts, "rank")

    fields = ["key", "number", "times", "rounds", "step", "rank"]
    level = repeated(suffixes.select("id", "place", "span", *fields), "0").withColumn("copied", F.coalesce(F.col("id") > F.col("least"), F.lit(False)))
    first = scratch.save(level.select(*fields, "place", "span", "copied"), "level-0")
    level, ended = first.select(*fields), []
    for number in range(0 if most is None else most + 1):
        last = F.col("rounds") == number
        further = F.when(last, F.col("step")).otherwise(2 << number)
        follower = level.select("key", F.col("number").alias("to"), F.col("rank").alias("next"))
        pairs = level.withColumn("to", F.col("number") + further).join(follower, ["key", "to"])
        ranked = pairs.select("key", "number", "times", "rounds", "step", F.xxhash64("rank", "next", F.when(last, F.col("step")).otherwise(-1)).alias("rank"), F.lit(0).alias("id"))
        now = scratch.save(repeated(scratch.save(ranked, "pairs"), str(number + 1)).select(*fields), f"level-{number + 1}")
        scratch.drop("pairs", f"ranks-{number}")
        ended.append(now.where(last))
        level = now.where(~last)
    copied = first.where("copied").select("key", F.col("place").alias("start"), (-F.col("span")).alias("count"))
    if not ended:
        return copied
    runs = ended[0].select("key", "number", "rank")
    for part in ended[1:]:
        runs = runs.unionByName(part.select("key", "number", "rank"))
    segments = suffixes.where("count > 0").select("key", "times", "number", "first", "count", "segment").join(runs.withColumnRenamed("rank", "run"), ["key", "number"])
    segments = scratch.save(segments.drop("number"), "segments")
    return copied.unionByName(_compare(keyed, segments, how.window, scratch, group_rows))


def _compare(keyed: DataFrame, segments: DataFrame, window: int, scratch: Scratch, group_rows: int) -> DataFrame:
    """(key, start, count): the strings of segments with the same run that occur elsewhere. Equal segments repeat whole; one
    of them stands for all where segments that occur once stand beside others."""
    names = scratch.save(segments.groupBy("run", "segment").agg(F.sum("times").alias("times"), F.min(F.struct("key", "first", "count")).alias("one")), "names")
    whole = segments.join(names.where("times > 1").select("run", "segment"), ["run", "segment"], "left_semi").select("key", F.col("first").alias("start"), "count")
    mixed = scratch.save(names.groupBy("run").agg(F.count("*").alias("members"), F.min("times").alias("fewest")).where("members > 1 and fewest = 1").select("run", "members"), "mixed")
    asked = names.join(mixed, "run").select("one.key", F.struct("run", "members", F.least("times", F.lit(2)).cast("int").alias("times"), "one.first", "one.count").alias("a"))
    by_text = scratch.save(asked.groupBy("key").agg(F.collect_list("a").alias("asked")), "asked")
    bits = set_bits(by_text.select("key"))
    joined = filter_rows(keyed, "key", bits).join(by_text.withColumnRenamed("key", "other").hint("merge"), F.col("key") == F.col("other")).select("key", "text", "asked")
    contexts = scratch.save(joined.mapInArrow(_cut(window), "key bigint, run bigint, members bigint, times int, first int, count int, context binary"), "contexts")
    few = contexts.where(F.col("members") <= group_rows).repartition("run").sortWithinPartitions("run")
    found = few.mapInArrow(_within_groups(window), "key bigint, start int, count int")
    # a run with very many different segments: its strings meet by their own names
    single = contexts.where(F.col("members") > group_rows).mapInArrow(_each_string(window), "key bigint, start int, run bigint, code bigint, times int")
    again = scratch.save(single.groupBy("run", "code").agg(F.sum("times").alias("total")).where("total > 1").select("run", "code"), "codes")
    more = single.where("times = 1").join(again, ["run", "code"]).select("key", "start", F.lit(1).alias("count"))
    return whole.unionByName(found).unionByName(more)


def _cut(window: int):
    """Cuts the segments asked for out of their texts."""

    def run(batches):
        names = ["key", "run", "members", "times", "first", "count", "context"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            out, held = [], 0
            for key, text, asked in zip(batch.column("key").to_pylist(), batch.column("text"), batch.column("asked")):
                raw = text.as_py().encode("utf-8")
                for a in asked.as_py():
                    part = raw[a["first"] : a["first"] + a["count"] - 1 + window]
                    out.append((key, a["run"], a["members"], a["times"], a["first"], a["count"], part))
                    held += len(part)
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return run


def _strings(table, window: int):
    """(row, place, name) of each string of the segments."""
    raw, offsets = string_parts(table.column("context"))
    count = table.column("count").to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = offsets[row] + place
    return row, place, ByteNames(raw, min(16, window)).windows(window)[at] if len(at) else np.zeros(0, np.uint64)


def _within_groups(window: int, rows_at_once: int = 1_000):
    """The strings of each group of segments, which arrive together, compared with one another."""

    def emit(table):
        row, place, code = _strings(table, window)
        code = mix(code ^ mix(table.column("run").to_numpy().view(np.uint64), 5)[row])
        times = table.column("times").to_numpy()
        values, back = np.unique(code, return_inverse=True)
        total = np.bincount(back, times[row], len(values))
        hit = (times[row] == 1) & (total[back] > 1)
        # all strings of a segment overlap, so what they cover together is one stretch
        low, high = np.full(len(times), 1 << 30), np.full(len(times), -1)
        np.minimum.at(low, row[hit], place[hit])
        np.maximum.at(high, row[hit], place[hit])
        keep = np.flatnonzero(high >= 0)
        start = table.column("first").to_numpy()[keep] + low[keep]
        return pa.RecordBatch.from_arrays([pa.array(table.column("key").to_numpy()[keep]), pa.array(start.astype(np.int32)), pa.array((high - low + 1)[keep].astype(np.int32))], ["key", "start", "count"])

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            group = rest.column("run").to_numpy()
            edges = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, int)
            done = int(edges[-1]) if len(edges) else 0
            start = 0
            for edge in edges[1:].tolist():
                if edge - start > rows_at_once or edge == done:
                    yield emit(rest.slice(start, edge - start).combine_chunks())
                    start = edge
            rest = rest.slice(done)
        if rest is not None and rest.num_rows:
            yield emit(rest.combine_chunks())

    return run


def _each_string(window: int):
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1_000):
                table = batch.slice(a, 1_000)
                row, place, code = _strings(table, window)
                at = pa.array(row)
                start = (table.column("first").to_numpy()[row] + place).astype(np.int32)
                yield pa.RecordBatch.from_arrays([table.column("key").take(at), pa.array(start), table.column("run").take(at), pa.array(code.view(np.int64)), table.column("times").take(at)], ["key", "start", "run", "code", "times"])

    return run


def remove_byte_windows(docs: DataFrame, window: int = 400, group_rows: int = 4_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes each byte that a string of ``window`` bytes covers which also starts anywhere else, overlaps included.

    Columns: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and longest_copied: the length of the
    longest stretch covered by strings of two phrases, some ``window`` / 5 bytes each, that also start in a document with a
    smaller id. Texts are their UTF-8 bytes, null is empty; strings never cross documents and are judged on the input. Every
    row counts, whatever its id: repeated and null ids, and repeated rows. Shorter texts keep everything.
    """
    how = Sampling(window)
    rows = docs.select(docs[id_col].alias("k0"), docs[text_col].alias("text"), F.xxhash64(docs[id_col], docs[text_col]).alias("doc_id")).withColumn("mark", F.col("doc_id"))
    scratch = Scratch(docs.sparkSession, "bytes")
    keyed = rows.where(F.octet_length("text") >= window).select(F.col("k0").alias("id"), "text", F.col("doc_id").alias("key"))
    found = repeated_strings(keyed, how, scratch, group_rows).select(F.col("key").alias("doc_id"), F.col("key").alias("mark"), "start", "count")
    runs = scratch.save(runs_of(found), "runs")

    def make(text, runs):
        raw = text.encode("utf-8")
        if runs is None:
            return len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), 0
        size = runs & ((1 << 24) - 1)
        copied = size >= 1 << 23  # a negative count
        cover = covered(runs[~copied], len(raw), window)
        kept = np.frombuffer(raw, np.uint8)[~cover].tobytes()
        part = covered((((runs[copied] >> 24) + 1) << 24) + ((1 << 24) - size[copied]), len(raw), 1)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], part, [False]]).astype(np.int8)))
        return len(raw), int(cover.sum()), int(cover[0]) + int((cover[1:] & ~cover[:-1]).sum()), hashlib.sha256(kept).hexdigest(), int((edge[1::2] - edge[::2]).max(initial=0))

    return finish(rows, runs, "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, longest_copied bigint", make).withColumnRenamed("k0", "doc_id")
