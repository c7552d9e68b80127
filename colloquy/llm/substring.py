"""Removal of repeated passages of words, by a count-min prefilter.

Windows are tied to anchors, the smallest gram within each window, which is at the same place in equal windows. Windows in
turn with the same anchor are a segment. A count-min sketch of the anchors' grams overestimates how often each window
occurs, so windows estimated once are left alone, and all others are compared exactly: first whole segments, of which
equal ones need to be looked at once only, then the single windows of the distinct segments.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import _sketch
from colloquy.llm._bitset import filter_rows, set_bits, slot_of
from colloquy.llm._scratch import Scratch, lean
from colloquy.llm._text import SEPARATOR, Names, Words, chunks, minimizers, mix, string_parts

WORD_GRAM = 24


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, text, a number that tells rows with the same id apart, and the id once more, as a column to keep."""
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("mark"), docs[id_col].alias("k0"))


class Segments:
    """The segments of one document: first window, number of windows, anchor's gram, and the rolling hashes."""

    def __init__(self, codes: np.ndarray, window: int, gram: int):
        self.window = window
        self.names = Names(codes, 2 * window - gram)
        grams = mix(self.names.windows(gram), gram)
        at = minimizers(grams, window - gram + 1)
        change = np.ones(len(at), bool)
        change[1:] = at[1:] != at[:-1]
        self.first = np.flatnonzero(change)
        self.count = np.diff(np.append(self.first, len(at)))
        self.anchor = at[self.first]
        self.gram = grams[self.anchor]

    def name(self, pick: np.ndarray) -> np.ndarray:
        """Hash of all that the windows of a segment cover."""
        start, count = self.first[pick], self.count[pick]
        return self.names.of(start, start + count - 1 + self.window)

    def windows(self, pick: np.ndarray) -> np.ndarray:
        """Names of the windows of some segments, one after the other."""
        count = self.count[pick]
        before = np.cumsum(count) - count
        return self.names.windows(self.window)[np.arange(count.sum()) + np.repeat(self.first[pick] - before, count)]


def _documents(batch: pa.RecordBatch, window: int):
    """(row, word hashes) of each document that has a window."""
    raw, offsets = string_parts(batch.column("text"))
    for a, b in chunks(offsets):
        found = Words(raw, offsets[a : b + 1])
        for row, (s, e) in enumerate(zip(found.first[:-1].tolist(), found.first[1:].tolist()), a):
            if e - s >= window:
                yield row, found.hash[s:e]


def _sketch_of(rows: DataFrame, window: int, gram: int, scratch: Scratch) -> _sketch.Repeated:
    def run(batches):
        for batch in batches:
            grams, held = [], 0
            for _, codes in _documents(batch, window):
                grams.append(np.unique(Segments(codes, window, gram).gram))
                held += len(grams[-1])
                if held > 1_000_000:
                    yield _sketch.partial(np.concatenate(grams))
                    grams, held = [], 0
            if grams:
                yield _sketch.partial(np.concatenate(grams))

    return _sketch.merge(rows.select("text").mapInArrow(lean(run), _sketch.SCHEMA), scratch)


def _segments(rows: DataFrame, bits: _sketch.Repeated, window: int, gram: int) -> DataFrame:
    """Segments whose windows are estimated repeated, with the names of their windows."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "mark", "start", "count", "gram", "name", "windows"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches):
        for batch in batches:
            row, parts, windows, held = [], [[] for _ in types], [], 0

            def flush():
                at = pa.array(np.repeat(np.array([r for r, _ in row], np.int64), [n for _, n in row]))
                columns = [batch.column("doc_id").take(at), batch.column("mark").take(at)] + [pa.array(np.concatenate(p), t) for p, t in zip(parts, types)]
                sizes = np.concatenate([[0], np.cumsum(np.concatenate(parts[1]))]).astype(np.int32)
                return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(windows).view(np.int64)))], names)

            for r, codes in _documents(batch, window):
                s = Segments(codes, window, gram)
                pick = np.flatnonzero(shared.value.among(s.gram))
                if not len(pick):
                    continue
                row.append((r, len(pick)))
                for p, v in zip(parts, (s.first[pick], s.count[pick], s.gram[pick].view(np.int64), s.name(pick).view(np.int64))):
                    p.append(v)
                windows.append(s.windows(pick))
                held += int(s.count[pick].sum())
                if held > 500_000:
                    yield flush()
                    row, parts, windows, held = [], [[] for _ in types], [], 0
            if row:
                yield flush()

    return rows.mapInArrow(lean(run), f"doc_id {id_type}, mark bigint, start int, count int, gram bigint, name bigint, windows array<bigint>")


def repeated_word_windows(rows: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """(doc_id, mark, runs) with runs of windows that also start in a document with a smaller id: longs start * 2**24 + count."""
    rows = rows.where("doc_id is not null")
    bits = _sketch_of(rows, window, min(WORD_GRAM, window), scratch)
    segments = scratch.save(_segments(rows, bits, window, min(WORD_GRAM, window)), "segments")
    # written before they are joined, so that Spark splits the tasks that a frequent passage fills
    smallest = scratch.save(segments.groupBy("gram", "name").agg(F.min("doc_id").alias("least_id")), "smallest")
    seen = segments.join(smallest, ["gram", "name"])
    whole = seen.where("doc_id > least_id").select("doc_id", "mark", "start", "count")
    # of equal segments, the one in the smallest document stands for all; any smaller document is smaller than theirs too
    single = seen.where("doc_id = least_id").select("doc_id", "mark", "start", "gram", F.posexplode("windows").alias("step", "code")).select("doc_id", "mark", (F.col("start") + F.col("step")).alias("start"), "gram", "code")
    first = single.groupBy("gram", "code").agg(F.min("doc_id").alias("least_id"), F.max("doc_id").alias("most_id")).where("least_id < most_id").select("gram", "code", "least_id")
    part = single.join(scratch.save(first, "first"), ["gram", "code"]).where("doc_id > least_id").select("doc_id", "mark", "start", F.lit(1).alias("count"))
    runs = scratch.save(runs_of(whole.unionByName(part)), "runs")
    scratch.drop("segments", "smallest", "first")
    return runs


def runs_of(found: DataFrame) -> DataFrame:
    """(doc_id, mark, runs): the runs of windows (start, count) of each row, as longs start * 2**24 + count."""
    return found.groupBy("doc_id", "mark").agg(F.collect_list(F.shiftleft(F.col("start").cast("long"), 24) + F.col("count")).alias("runs"))


def covered(runs, size: int, window: int) -> np.ndarray:
    """Which of ``size`` units the windows of the runs cover."""
    r = np.asarray(runs, np.int64)
    start, count = r >> 24, r & ((1 << 24) - 1)
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + count - 1 + window, -1)
    return np.cumsum(edge[:-1]) > 0


def finish(rows: DataFrame, runs: DataFrame, columns: str, make) -> DataFrame:
    """Calls make(text, runs or None) on every row: what the row keeps (columns k0, k1, ...), then the columns made.

    Only rows that may have runs are shuffled. A task holds one Python worker: the other rows are picked where they are
    made, and the join is a shuffle.
    """
    bits = set_bits(runs.select(F.col("doc_id").alias("key")))
    shared = rows.sparkSession.sparkContext.broadcast(bits)
    made = [c.strip().split(" ") for c in columns.split(",")]
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    kept = [c for c in rows.columns if c not in ("doc_id", "text", "mark")]

    def run(batches):
        for batch in batches:
            if "slot" in batch.schema.names:
                batch = batch.filter(pa.array(~shared.value.among(batch.column("slot").to_numpy())))
            has = "runs" in batch.schema.names
            values = [make(t.as_py() or "", r.values.to_numpy() if has and r.is_valid else None) for t, r in zip(batch.column("text"), batch.column("runs") if has else batch.column("text"))]
            new = [pa.array(c, kinds[kind]) for c, (_, kind) in zip(list(zip(*values)) or [()] * len(made), made)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + new, kept + [name for name, _ in made])

    schema = ", ".join([f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept] + [columns])
    keys = runs.select(F.col("doc_id").alias("other_id"), F.col("mark").alias("other_mark"), "runs")
    maybe = filter_rows(rows, "doc_id", bits)
    joined = maybe.join(keys.hint("merge"), maybe["doc_id"].eqNullSafe(keys["other_id"]) & (maybe["mark"] == keys["other_mark"]), "left").select("text", "runs", *kept)
    clear = rows.select("text", slot_of(rows["doc_id"]).alias("slot"), *kept)
    return clear.mapInArrow(lean(run), schema).unionByName(joined.mapInArrow(lean(run), schema))


def _words(text: str) -> list[bytes]:
    return [w for w in text.encode("utf-8").translate(_TO_BLANK).split(b" ") if w]


_TO_BLANK = bytes(0x20 if SEPARATOR[b] else b for b in range(256))


def remove_word_windows(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """Removes each word that a window of ``window`` words covers which also starts in a document with a smaller id.

    Columns: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by blanks), with ``texts`` also kept. Words
    are ``[^\\x20\\x09-\\x0D]+``, unchanged. Windows are judged on the input. Null texts have no words; a null id neither
    removes nor is removed; rows with the same id never remove each other's words.
    """
    rows = _columns(docs, id_col, text_col)
    runs = repeated_word_windows(rows, window, Scratch(docs.sparkSession, "windows"))

    def make(text, runs):
        words = _words(text)
        gone = 0
        if runs is not None:
            cover = covered(runs, len(words), window)
            gone = int(cover.sum())
            kept = b" ".join([w for w, c in zip(words, cover.tolist()) if not c])
        else:
            kept = b" ".join(words)
        return (len(words), gone, hashlib.sha256(kept).hexdigest()) + ((kept.decode(),) if texts else ())

    return finish(rows, runs, "n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * texts, make).withColumnRenamed("k0", "doc_id")


def without_word_windows(docs: DataFrame, window: int = 50) -> DataFrame:
    """The documents, columns as they are, with repeated windows removed: a text that loses words is its kept words joined
    by blanks, and n_chars follows; other texts stay as they are, null as null."""
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    names = {c: f"k{i}" for i, c in enumerate(others)}
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"), *(docs[c].alias(k) for c, k in names.items()), docs["text"].isNull().alias("k_null"))
    runs = repeated_word_windows(rows.select("doc_id", "text", "mark"), window, Scratch(docs.sparkSession, "windows"))

    def make(text, runs):
        if runs is None:
            return (text,)
        words = _words(text)
        cover = covered(runs, len(words), window).tolist()
        return (b" ".join([w for w, c in zip(words, cover) if not c]).decode(),)

    out = finish(rows, runs, "kept string", make)
    text = F.when(~F.col("k_null"), F.col("kept"))
    made = {"text": text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} | {c: F.col(k) for c, k in names.items()}
    return out.select(*(made[c].alias(c) for c in docs.columns))
