"""Document fingerprints by SpotSigs: chains of content words that follow common-word anchors.

A fingerprint is the set of its chains' 32-bit hashes, written as base64 of the sorted numbers. Sets are compared by
Jaccard similarity. Over the whole corpus, fingerprints meet in tiles of like set length, where they agree in one of enough
parts of the hash space; sizes and bitmaps bound the overlap before the sets are intersected (``jaccard``).
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm import jaccard
from colloquy.llm._text import CHUNK, Words, mix

#: Common words of English, French, German and Spanish.
ANCHORS = frozenset(
    "a an and are as at be been but by can for from had has have he her his i if in is it its not of on or she so that the their there they this to was we were which will with you "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur ne nous on ou par pas plus pour que qui sa se ses son sont sur un une vous "
    "aber als am auch auf aus bei das dass dem den der des die doch ein eine einem einen einer er es für hat ich im ist mit nach nicht noch nur oder sich sie sind so und von war wie wir zu zum zur "
    "al como con del el ella en es esta este fue ha las lo los más me mi no nos o para pero por se si sin su sus también te un una y ya yo".split()
)
#: What a word leaves out: all but letters and digits.
DROPPED = re.compile(r"[^\w\s]+|_+")
#: ASCII and Latin letters: of these texts only ASCII characters can be dropped.
_LATIN = re.compile("[\\x00-\\x7f\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f]*")
_ASCII_DROPPED = bytes(c for c in range(128) if not chr(c).isalnum() and not chr(c).isspace())
_ASCII_BLANK = bytes(0x20 if c < 128 and chr(c).isspace() else c for c in range(256))


def clean(text: str) -> bytes:
    """The text's words between blanks: in lower case, letters and digits only."""
    low = text.lower()
    if low.isascii() or _LATIN.fullmatch(low):
        return low.encode().translate(_ASCII_BLANK, _ASCII_DROPPED)
    return " ".join(DROPPED.sub("", low).split()).encode("utf-8", "replace")


def word_codes(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    return Words(np.frombuffer(b" ".join(raw), np.uint8), np.array([0, sum(map(len, raw)) + len(raw) - 1])).hash


class Spots:
    """Turns texts into fingerprints."""

    def __init__(self, chain: int = 2):
        self.chain = chain
        self.anchors = np.sort(word_codes(sorted(ANCHORS)))

    def numbers(self, text: str) -> np.ndarray:
        return self.sets([text])[0]

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """Sorted distinct hashes of each text's chains.

        Without an anchor before a content word, every word begins a chain; without words, the text is its own chain.
        """
        out, part, size = [], [], 0
        for text in [*texts, None]:
            if part and (text is None or size + len(text) > CHUNK):
                raw = [clean(t) for t in part]
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
                out += self.some(part, Words(np.frombuffer(b"".join(raw), np.uint8), offsets))
                part, size = [], 0
            if text is not None:
                part.append(text)
                size += len(text)
        return out

    def some(self, texts: list[str], words: Words) -> list[np.ndarray]:
        codes, first = words.hash, words.first
        text_of = np.repeat(np.arange(len(texts)), np.diff(first))
        common = self.anchors[np.minimum(np.searchsorted(self.anchors, codes), len(self.anchors) - 1)] == codes
        content, anchor = np.flatnonzero(~common), np.flatnonzero(common)
        head = np.searchsorted(content, anchor)
        owner = np.append(text_of[content], -1)
        begins = owner[head] == text_of[anchor]
        anchor, head = anchor[begins], head[begins]
        hashes = self.chains(codes[anchor], np.append(codes[content], np.uint64(0)), head, owner, text_of[anchor])
        edges = np.searchsorted(text_of[anchor], np.arange(len(texts) + 1)).tolist()
        out = []
        for i, text in enumerate(texts):
            if edges[i] < edges[i + 1]:
                out.append(np.unique(hashes[edges[i] : edges[i + 1]]))
            elif first[i] < first[i + 1]:
                own = codes[first[i] : first[i + 1]]
                n = len(own)
                out.append(np.unique(self.chains(np.zeros(n, np.uint64), np.append(own, np.uint64(0)), np.arange(n), np.append(np.zeros(n, int), -1), np.zeros(n, int))))
            else:
                out.append(np.unique(np.frombuffer(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=4).digest(), np.uint32)) if text else np.zeros(0, np.uint32))
        return out

    def chains(self, start: np.ndarray, codes: np.ndarray, head: np.ndarray, owner: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Hashes of a first code and the ``chain`` codes from ``head`` on, as far as they are of the same text."""
        h = mix(start)
        for step in range(self.chain):
            place = np.minimum(head + step, len(codes) - 1)
            h = mix(h ^ np.where(owner[place] == text, codes[place], np.uint64(step + 1)))
        return (h >> np.uint64(32)).astype(np.uint32)


def encode(numbers: np.ndarray) -> str:
    return base64.b64encode(numbers.astype("<u4").tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets. Two empty sets are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


_spots: dict[int, Spots] = {}


def spots(chain: int) -> Spots:
    return _spots.setdefault(chain, Spots(chain))


def fingerprints(docs: DataFrame, chain: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The fingerprint of every whole text, and the number of its chains; nothing is shuffled. Null counts as empty."""
    kept = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches):
        s = spots(chain)
        for batch in batches:
            sets = s.sets([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([encode(x) for x in sets], pa.string()), pa.array([len(x) for x in sets], pa.int64())], ["doc_id", "fingerprint", "n_chains"])

    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, fingerprint string, n_chains bigint")


def hashes(fingerprint: np.ndarray) -> np.ndarray:
    """A fingerprint's numbers as sorted 64-bit hashes, equal for equal numbers only."""
    return np.sort(mix(fingerprint.astype(np.uint64) + np.uint64(1)))


def near_copies(docs: DataFrame, percent: int = 80, chain: int = 2, tile_rows: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chains, class_id and node for every row: the class is the smallest id that a document reaches by links.

    Two documents of the corpus are linked, wherever they stand, when the Jaccard similarity of their fingerprints is at
    least ``percent`` / 100. A text without chains is a class of its own; a null id has none. ``node`` names the set.
    """

    def sets_of(raw, offsets, width):
        s = spots(chain)
        return [hashes(x) for x in s.sets([raw[a:b].tobytes().decode("utf-8") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])]

    out = jaccard.linked_components(docs, 0, percent, tile_rows, id_col, text_col, sets_of)
    return out.select("doc_id", F.col("n_shingles").alias("n_chains"), F.col("component_id").alias("class_id"), "node")


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_next(docs: DataFrame, chain: int = 2, id_col: str = "doc_id", text_col: str = "text", classes: DataFrame | None = None, range_bytes: int = 32 << 20, most_ranges: int = 50_000) -> DataFrame:
    """Fingerprints every text, its edited text and the next document's, by descending id (after the last: the first).

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null texts count as
    empty; a null id stands last; rows with the same id follow each other by the hash of their text. A single document is
    its own next. Ids are of any type that can be ordered. The rows are dealt by ranges of ids of about ``range_bytes``
    each, ``most_ranges`` at most; the next document is in the same range, or it is the head of another one, of which
    there is one for each range. Texts are compressed before they are dealt. With ``classes`` (of ``near_copies``), also
    class_id.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    kept = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    out = f"doc_id {kind.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if classes is not None:
        out += f", class_id {kind.simpleString()}"
    size = kept.agg(F.sum(F.octet_length("text"))).first()[0]
    if size is None:
        return spark.createDataFrame([], out)
    ranges = min(most_ranges, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // range_bytes))
    # the ranges' bounds: quantiles of a bounded sample of ids, the same whatever the rows' order
    sample = kept.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(32 * ranges)
    ids = sorted(r["doc_id"] for r in sample.collect())
    bounds = sorted({ids[i * len(ids) // ranges] for i in range(1, ranges)}) if ids else []

    def range_of(doc_id) -> int:
        """0 for null, which is below all ids."""
        return 0 if doc_id is None else 1 + bisect.bisect_right(bounds, doc_id)

    def deal(batches):
        names = ["doc_id", "range", "end", "mark", "packed"]
        for batch in batches:
            held = batch.column("range") if "range" in batch.schema.names else pa.array([range_of(i) for i in batch.column("doc_id").to_pylist()], pa.int32())
            packed = [zlib.compress(t.as_py().encode(), 1) for t in batch.column("text")]
            end = pa.array([int("range" in batch.schema.names)] * batch.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), held, end, batch.column("mark"), pa.array(packed, pa.binary())], names)

    dealt_by = _range_column(kind, bounds) if bounds else F.when(F.col("doc_id").isNull(), 0).otherwise(1)
    # one row for each range: its greatest id, which follows the least of the next higher range
    heads = kept.select("doc_id", dealt_by.alias("range")).groupBy("range").agg(F.max("doc_id").alias("head")).orderBy("range").collect()
    following = [(heads[i - 1]["head"], r["range"]) for i, r in enumerate(heads)]
    targets = F.broadcast(spark.createDataFrame(following, f"head {kind.simpleString()}, range int"))
    marked = kept.withColumn("mark", F.xxhash64("text"))
    first = marked.join(targets, marked["doc_id"].eqNullSafe(targets["head"])).groupBy("range").agg(F.max_by(F.struct("doc_id", "text", "mark"), "mark").alias("row")).select("range", "row.*")
    schema = f"doc_id {kind.simpleString()}, range int, end int, mark bigint, packed binary"
    rows = marked.mapInArrow(deal, schema).unionByName(first.select("doc_id", "text", "mark", "range").mapInArrow(deal, schema))
    rows = rows.withColumns({"node": F.lit(None).cast("long"), "class_id": F.lit(None).cast(kind)})
    if classes is not None:
        # the class of each id and set, where it is another document's, goes before the rows with that id
        told = classes.where("class_id != doc_id").select("doc_id", "node", "class_id").distinct()
        rows = rows.unionByName(told.select("doc_id", dealt_by.alias("range"), F.lit(0).alias("end"), F.lit(None).cast("long").alias("mark"), F.lit(None).cast("binary").alias("packed"), "node", "class_id"))
    rows = rows.repartition(ranges, "range").sortWithinPartitions("range", "end", F.desc_nulls_last("doc_id"), F.desc_nulls_last("node"), F.desc("mark"))

    def run(batches):
        s = spots(chain)
        names = [f.split(" ")[0] for f in out.split(", ")]
        before, told_of, told = None, None, {}
        for batch in (b.slice(i, 128) for b in batches for i in range(0, b.num_rows, 128)):
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "packed", "end", "range", "node", "class_id"))))
            texts = [zlib.decompress(packed).decode() for _, packed, _, _, node, _ in rows if node is None]
            ready, pairs = iter(zip(texts, s.sets(texts))), []
            for doc_id, _, last, block, node, other_class in rows:
                if node is not None:
                    if told_of != doc_id:
                        told_of, told = doc_id, {}
                    told[node] = other_class
                    continue
                now, numbers = next(ready)
                if before is not None and before[3] == block:
                    pairs.append((*before[:3], before[4], edited(before[1], now), numbers))
                own_class = told.get(jaccard.node_of(hashes(numbers)), doc_id) if told and told_of == doc_id and len(numbers) else doc_id
                before = None if last else (doc_id, now, numbers, block, own_class)
            made: list[list] = [[] for _ in names]
            for (old_id, old, old_numbers, old_class, other, numbers), other_numbers in zip(pairs, s.sets([p[4] for p in pairs])):
                row = (old_id, len(old), hashlib.sha256(other.encode()).hexdigest(), encode(old_numbers), encode(other_numbers), likeness(old_numbers, other_numbers), likeness(old_numbers, numbers), old_class)
                for column, value in zip(made, row):
                    column.append(value)
            types = [batch.column("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), batch.column("doc_id").type][: len(names)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, types)], names)

    return rows.mapInArrow(run, out)


def _range_column(kind: T.DataType, bounds: list) -> Column:
    """The number of an id's range, 0 for null."""

    @F.pandas_udf(T.IntegerType())
    def find(doc_id):
        import pandas as pd

        return pd.Series([0 if missing else 1 + bisect.bisect_right(bounds, i) for i, missing in zip(doc_id.tolist(), doc_id.isna())], dtype="int32")

    return F.coalesce(F.when(F.col("doc_id").isNotNull(), find(F.coalesce(F.col("doc_id"), F.lit(bounds[0]).cast(kind)))), F.lit(0))
