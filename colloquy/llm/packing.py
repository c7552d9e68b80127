"""Best-fit packing of token sequences by exact-complement hashing.

The plan depends on how many pieces there are of each length, at most ``max_len`` numbers, however many documents there
are. From the longest length down, the gap that a piece leaves is looked up in an index of the sums of one, two and three
lengths with pieces left, and a choice that fills it exactly is used as often as the counts allow; where there is none, the
gap takes the best-fitting length. Spark then numbers the pieces of each length and gives each its place.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm._scratch import Scratch, lean
from colloquy.llm.bpe import PLAIN_TEXT, WordTokenizer, byte_letters, tokenizer

#: Most words that a task keeps; the table is emptied beyond it, and when the task ends.
WORDS_KEPT = 400_000
PIECES = "doc_id {id}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"


class TokenBytes:
    """Token ids of texts as little-endian 32-bit numbers, by the tokenizers library: texts are cut into words, each word is
    given to its model once, and words are kept. Pieces between blanks are more various: 1.4 times as many differ."""

    def __init__(self, splitter: WordTokenizer):
        self.splitter = splitter
        self.model = splitter.library.model
        self.letter = dict(enumerate(byte_letters()))
        self.table: dict[str, bytes] = {}

    def of(self, texts: list[str]) -> list[bytes]:
        out, table, special = [], self.table, self.splitter.special
        words_of = self.splitter.words.findall
        for text in texts:
            if any(s in text for s in special) or PLAIN_TEXT.fullmatch(text) is None:
                out.append(array("I", self.splitter.library.encode(text, add_special_tokens=False).ids).tobytes())
                continue
            if len(table) > WORDS_KEPT:
                table.clear()
            words = words_of(text)
            found = list(map(table.get, words))
            if None in found:
                found = [self.learn(w) if x is None else x for x, w in zip(found, words)]
            out.append(b"".join(found))
        return out

    def learn(self, word: str) -> bytes:
        letters = word.encode().decode("latin-1").translate(self.letter)
        value = self.table[word] = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        return value


_token_bytes: dict[str, TokenBytes] = {}


class Sums:
    """Index of the sums of one, two and three lengths that have pieces left: how many ordered choices make each sum.

    A length that runs out is taken out of the index in one pass over it; pieces only ever become fewer, so a sum that no
    choice makes stays so.
    """

    def __init__(self, left: np.ndarray):
        self.left, self.size = left, len(left)
        self.one = np.zeros(self.size, np.int64)
        self.two, self.three = self.one.copy(), self.one.copy()
        for length in np.flatnonzero(left).tolist():
            self.change(length, 1)

    def change(self, length: int, sign: int) -> None:
        """Puts a length in, or takes it out, of all sums."""
        if sign < 0:
            self.one[length] = 0
            self.two[length:] -= 2 * self.one[: self.size - length]
            if 2 * length < self.size:
                self.two[2 * length] -= 1
        self.three[length:] += sign * 3 * self.two[: self.size - length]
        if 2 * length < self.size:
            self.three[2 * length :] += sign * 3 * self.one[: self.size - 2 * length]
        if 3 * length < self.size:
            self.three[3 * length] += sign
        if sign > 0:
            self.two[length:] += 2 * self.one[: self.size - length]
            if 2 * length < self.size:
                self.two[2 * length] += 1
            self.one[length] = 1

    def take(self, use: Counter) -> int:
        """Takes a sequence's lengths as often as they last, and says how often that is."""
        times = min(int(self.left[x]) // k for x, k in use.items())
        for x, k in use.items():
            self.left[x] -= times * k
            if not self.left[x]:
                self.change(x, -1)
        return times

    def pair(self, spare: np.ndarray, total: int) -> list[int]:
        if total < 2 or not self.two[total]:
            return []
        low = np.arange(total // 2, 0, -1)
        hit = low[(spare[low] > 0) & (spare[total - low] > (2 * low == total))]
        return [int(total - hit[0]), int(hit[0])] if len(hit) else []

    def exact(self, used: Counter, gap: int) -> list[int]:
        """One, two or three lengths that fill the gap beside those used, whichever have pieces left; empty if none do."""
        if not (self.one[gap] or self.two[gap] or self.three[gap]):
            return []
        spare = self.left.copy()
        for x, k in used.items():
            spare[x] -= k
        if spare[gap] > 0:
            return [gap]
        if two := self.pair(spare, gap):
            return two
        if self.three[gap]:
            third = np.arange(gap // 3, 0, -1)
            for x in third[(spare[third] > 0) & (self.two[gap - third] > 0)].tolist():
                spare[x] -= 1
                if two := self.pair(spare, gap - x):
                    return [x, *two]
                spare[x] += 1
        return []

    def largest(self, used: Counter, gap: int) -> int:
        """The longest length that fits the gap beside those used, or 0."""
        fits = np.flatnonzero(self.one[: gap + 1])
        return next((int(x) for x in fits[::-1] if self.left[x] > used[int(x)]), 0)


def plan(counts: dict[int, int], max_len: int) -> list[tuple[int, list[int]]]:
    """(how many sequences, the lengths in each) for pieces counted by length.

    From the longest length down: its gap is filled exactly if any choice can, else by the longest length that fits, whose
    own gap is looked up again.
    """
    left = np.zeros(max_len + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    sums, out = Sums(left), []
    for length in range(max_len, 0, -1):
        while left[length] > 0:
            items, gap = [length], max_len - length
            while gap > 0:
                used = Counter(items)
                more = sums.exact(used, gap) or [x for x in [sums.largest(used, gap)] if x]
                if not more:
                    break
                items += more
                gap -= sum(more)
            out.append((sums.take(Counter(items)), items))
    return out


def pack(docs: DataFrame, tokenizer_path: str, max_len: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into sequences of at most ``max_len`` tokens; one row for each piece.

    A document is its token ids and then ``end_id``; null and empty texts are that id alone. Documents of more tokens are
    cut into pieces of ``max_len``, of which the first may be shorter. Repeated rows are packed as often as they occur,
    ids may be null, an empty table gives no rows, other columns are ignored.
    """
    spark = docs.sparkSession
    kept = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    tail = end_id.to_bytes(4, "little")

    def cut(batches):
        tokens = _token_bytes.get(tokenizer_path) or _token_bytes.setdefault(tokenizer_path, TokenBytes(tokenizer(tokenizer_path)))
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("at", "piece", "start", "length", "crc", "nth")}
            texts = batch.column("text")
            for at, ids in enumerate(x for i in range(0, len(texts), 200) for x in tokens.of([t or "" for t in texts.slice(i, 200).to_pylist()])):
                ids += tail
                n = len(ids) // 4
                first = n if n <= max_len else n % max_len or max_len
                edges = [0, *range(first, n + 1, max_len)]
                for piece, (a, b) in enumerate(zip(edges, edges[1:])):
                    values = (at, piece, a, b - a, zlib.crc32(memoryview(ids)[4 * a : 4 * b]), seen[b - a])
                    seen[b - a] += 1
                    for k, v in zip(rows, values):
                        rows[k].append(v)
            n = len(rows["at"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows["at"], pa.int64())), pa.array(rows["piece"], pa.int32()), *(pa.array(rows[k], pa.int64()) for k in ("start", "length", "crc")), pa.array([part] * n, pa.int32()), pa.array(rows["nth"], pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
            )
        tokens.table.clear()

    schema = PIECES.format(id=kept.schema["doc_id"].dataType.simpleString())
    pieces = Scratch(spark, "packing").save(kept.mapInArrow(lean(cut), schema), "pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # at most max_len rows
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, sequences, taken = [], 0, Counter()
    for times, lengths in plan(counts, max_len):
        offset = 0
        for length in lengths:
            slots.append((length, taken[length], sequences, offset))
            taken[length] += times
            offset += length
        sequences += times
    slots.sort()
    table = np.array(slots, np.int64).reshape(-1, 4)
    keys = (table[:, 0] << 46) + table[:, 1]

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 46) + rank, "right") - 1
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(table[at, 2] + rank - table[at, 1]), pa.array(table[at, 3])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(base, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(lean(place), schema.split(", part")[0] + ", sequence_id bigint, offset bigint")
