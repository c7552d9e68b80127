"""Spelling variants: words of a vocabulary that differ by one letter, found with a bit-sliced position index.

A word of m letters is cut into pieces. Two words that differ by one inserted, deleted or replaced letter agree on all
pieces but one, so words meet in tiles: those of m or m + 1 letters that agree outside piece i. The index of a tile holds
one bit set over its words for each (place, letter) of that piece. A letter of a query ands one of them into the set of
words matched without an error, and the same letter, at places shifted by one, into the sets with one error, so all words
of a tile go through the recurrence at once. Bits are ordered by frequency: the first one that stays is the best form.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm._scratch import Scratch

#: Words of one index: bit sets of 16 longs.
INDEX_WORDS = 1024
#: Queries that go through an index at once, and places whose bit sets are made at once.
QUERY_ROWS, PLACES = 1024, 2048
RUN = "[A-Za-z\\u00C0-\\u00FF]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(run: Column) -> Column:
    """A-Z as a-z and nothing else."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def misspelt(run: Column, doc_id: Column, every: int = 31) -> Column:
    """The run without one letter, where ``every`` divides the crc32 of ``<doc_id>:<run>``; a null id is empty."""
    code = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = F.pmod(code, F.length(run).cast("bigint")).cast("int")
    without = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(F.pmod(code, F.lit(every)) == 0, without).otherwise(run)


def vocabulary(docs: DataFrame, least_letters: int = 7, least_n: int = 2, every: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): maximal runs of letters of all texts, folded, some with a letter left out (``misspelt``), counted.

    Words of at least ``least_letters`` code points that occur ``least_n`` times are kept. Null and empty texts have none;
    repeated rows count again.
    """
    runs = docs.select(docs[id_col].alias("id"), F.explode(F.regexp_extract_all(docs[text_col], F.lit(f"{RUN}{{{least_letters},}}"), F.lit(0))).alias("run"))
    words = runs.select("id", fold(F.col("run")).alias("run")).select(misspelt(F.col("run"), F.col("id"), every).alias("word"))
    return words.where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def postings(words: DataFrame, pieces: int) -> DataFrame:
    """(kind, rest, middle, word, n): each word in the tiles of its own length m and of m - 1, where it is the longer one.

    ``kind`` numbers (m, piece), ``rest`` is the word without the piece, ``middle`` the piece.
    """
    size = F.length("word")
    classed = words.select("word", "n", size.alias("size"), F.explode(F.array(size, size - 1)).alias("m"))
    each = classed.where(F.col("m") >= pieces).select("*", F.explode(F.array(*[F.lit(i) for i in range(pieces)])).alias("i"))
    low, high = F.expr(f"int(i * m div {pieces})"), F.expr(f"int((i + 1) * m div {pieces})")
    cut = each.withColumns({"low": low, "tail": F.col("m") - high})
    middle = F.substring("word", F.col("low") + 1, F.col("size") - F.col("low") - F.col("tail"))
    rest = F.concat(F.substring("word", F.lit(1), F.col("low")), F.when(F.col("tail") > 0, F.substring("word", F.col("size") - F.col("tail") + 1, F.col("tail"))).otherwise(""))
    return cut.select((F.col("m").cast("bigint") * pieces + F.col("i")).alias("kind"), rest.alias("rest"), middle.alias("middle"), "word", "n")


class Index:
    """Bit sets over words, one for each (place, letter), of middles of ``short`` or one more letters.

    ``group`` numbers the tile of each word; words of a tile stand together, and a query meets its own tile's alone.
    ``first`` tells that no piece stands before this one.
    """

    def __init__(self, letters: list[np.ndarray], short: int, group: np.ndarray, first: bool):
        self.short, self.first, self.group = short, first, group
        self.longs = -(-len(letters) // 64)
        self.letters = np.zeros((len(letters), short + 1), np.uint32)
        size = np.array([len(x) for x in letters])
        for row, x in enumerate(letters):
            self.letters[row, : len(x)] = x
        self.of_size = {s: self.pack(size[None, :] == s)[0] for s in (short, short + 1)}
        self.groups, start = np.unique(group, return_index=True)
        number = np.arange(len(group))
        ends = np.append(start[1:], len(group))
        self.masks = self.pack((number >= start[:, None]) & (number < ends[:, None]))

    def pack(self, flags: np.ndarray) -> np.ndarray:
        full = np.zeros((len(flags), self.longs * 64), bool)
        full[:, : flags.shape[1]] = flags
        return np.packbits(full, axis=1, bitorder="little").view(np.uint64)

    def slices(self, begin: int, end: int):
        """(keys, sets) of the places begin..end; a key is place << 32 | letter. The last set is empty."""
        part = self.letters[:, begin:end].astype(np.uint64)
        keyed = part | (np.arange(begin, begin + part.shape[1], dtype=np.uint64) << np.uint64(32))
        word, place = np.nonzero(part)
        keys, back = np.unique(keyed[word, place], return_inverse=True)
        sets = np.zeros((len(keys) + 1, self.longs * 64), bool)
        sets[back, word] = True
        return keys, np.packbits(sets, axis=1, bitorder="little").view(np.uint64)

    def near(self, queries: np.ndarray, size: int, group: np.ndarray) -> np.ndarray:
        """For each query of ``size`` letters (rows), the bit set of the words that differ by exactly one letter."""
        zero = self.masks[np.searchsorted(self.groups, group)].copy()
        one, moved, at_gap = np.zeros_like(zero), zero.copy(), zero.copy()
        longer = size > self.short
        if longer:
            moved, at_gap = np.zeros_like(zero), np.zeros_like(zero)
        made = (0, 0, None, None)
        for place in range(size):
            if made[1] < min(place + 2, self.short + 1):
                begin = max(0, place - 1)
                made = (begin, begin + PLACES, *self.slices(begin, begin + PLACES))
            keys, sets = made[2:]

            def among(shift, place=place, keys=keys, sets=sets):
                want = queries[:, place].astype(np.uint64) | (np.uint64(place + shift) << np.uint64(32))
                found = np.minimum(np.searchsorted(keys, want), max(0, len(keys) - 1))
                return sets[np.where(keys[found] == want, found, len(keys))] if len(keys) else np.zeros_like(zero)

            here = among(0)
            if longer:  # the query's letter is one too many
                if place == 0:
                    moved = zero.copy()
                    at_gap = zero.copy()
                else:
                    back = among(-1)
                    moved = (moved & back) | zero
                    at_gap &= back
                zero &= here
            else:
                one = (one & here) | (zero & ~here)
                zero &= here
                ahead = among(1)
                moved = (moved & ahead) | zero  # the word has a letter more
                at_gap &= ahead
        if longer:
            found = moved & self.of_size[self.short]
            return found if self.first else found & ~at_gap
        found = moved & self.of_size[self.short + 1]
        if not self.first:  # a letter at the border of two pieces counts in the first of them
            found &= ~at_gap
        return found | (one & self.of_size[self.short])


def _codes(middles: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in middles.to_pylist()]


def _compare(pieces: int):
    """Rows arrive by (kind, rest, part), each tile's own words first and by falling n; the others are queries only."""
    names = ["word", "n_near", "best_n", "best"]

    def answers(index, vocabulary, rows, group):
        """(word, number of near words, the first one's n, the first one) of the queries that have any."""
        letters = _codes(rows.column("middle"))
        size = np.array([len(x) for x in letters])
        for s in (index.short, index.short + 1):
            picked = np.flatnonzero(size == s)
            for a in range(0, len(picked), QUERY_ROWS):
                some = picked[a : a + QUERY_ROWS]
                found = index.near(np.array([letters[k] for k in some]).reshape(len(some), s), s, group[some])
                count = np.bitwise_count(found).sum(1, dtype=np.int64)
                hit = np.flatnonzero(count)
                if not len(hit):
                    continue
                lead = (found[hit] != 0).argmax(1)
                bits = found[hit, lead]
                best = pa.array(lead * 64 + np.bitwise_count((bits & (~bits + np.uint64(1))) - np.uint64(1)))
                yield pa.RecordBatch.from_arrays([rows.column("word").take(pa.array(some[hit])), pa.array(count[hit]), vocabulary.column("n").take(best), vocabulary.column("word").take(best)], names)

    def indexes(words: pa.RecordBatch, kind: int, group: np.ndarray):
        m, i = divmod(kind, pieces)
        short = (i + 1) * m // pieces - i * m // pieces
        most = max(1, min(INDEX_WORDS, (1 << 22) // (short + 1)))
        for a in range(0, words.num_rows, most):
            part = words.slice(a, most)
            yield Index(_codes(part.column("middle")), short, group[a : a + most], i == 0), part

    def within(parts: list[pa.RecordBatch], kind: int, group: np.ndarray):
        """The words of whole tiles as queries of one another; a word alone in its tile has no other to meet."""
        words = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        _, back, members = np.unique(group, return_inverse=True, return_counts=True)
        company = members[back] > 1
        words, group = words.filter(pa.array(company)), group[company]
        for index, part in indexes(words, kind, group):
            low, high = np.searchsorted(group, index.group[0], "left"), np.searchsorted(group, index.group[-1], "right")
            yield from answers(index, part, words.slice(low, high - low), group[low:high])

    def run(batches):
        parts, groups, kind, size = [], [], None, 0  # own words of whole tiles of one kind
        tile, number, asked = None, 0, None  # the tile that comes in, and its indexes once there are queries from elsewhere
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("kind", "rest", "part"))))
            own = batch.column("own").to_numpy(zero_copy_only=False)
            starts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for s, e in zip(starts, starts[1:]):
                if s == e:
                    continue
                if keys[s] != tile:
                    if parts and (kind != keys[s][0] or size >= INDEX_WORDS):
                        yield from within(parts, kind, np.concatenate(groups))
                        parts, groups, size = [], [], 0
                    tile, kind, number, asked = keys[s], keys[s][0], number + 1, None
                mine = s + int(own[s:e].sum())  # own words come first
                if mine > s:
                    parts.append(batch.slice(s, mine - s))
                    groups.append(np.full(mine - s, number))
                    size += mine - s
                if e > mine:
                    if asked is None:
                        these = [(p, g) for p, g in zip(parts, groups) if g[0] == number]
                        asked = list(indexes(pa.Table.from_batches([p for p, _ in these]).combine_chunks().to_batches()[0], kind, np.concatenate([g for _, g in these]))) if these else []
                    rows = batch.slice(mine, e - mine)
                    for index, part in asked:
                        yield from answers(index, part, rows, np.full(rows.num_rows, number))
        if parts:
            yield from within(parts, kind, np.concatenate(groups))

    return run


def near_words(words: DataFrame, scratch: Scratch, pieces: int = 3, tile_words: int = 8192) -> DataFrame:
    """(word, n_near, best_n, best): how many words of (word, n) differ by one code point, and the most frequent of them
    (ties: the smallest). Words without any are left out; every word is given once and has ``pieces`` letters at least.

    A tile of more than ``tile_words`` words is dealt to several tasks: each holds a share of its words and sees all of
    them as queries.
    """
    rows = postings(words, pieces)
    hot = scratch.save(rows.groupBy("kind", "rest").agg(F.count("*").alias("members")).where(F.col("members") > tile_words).select("kind", "rest", F.ceil(F.col("members") / tile_words).cast("int").alias("parts")), "hot")
    several = rows.join(hot, ["kind", "rest"])
    home = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    dealt = several.select("*", home.alias("home"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("kind", "rest", "part", (F.col("home") == F.col("part")).alias("own"), "middle", "word", "n")
    plain = rows.join(hot, ["kind", "rest"], "left_anti").select("kind", "rest", F.lit(0).alias("part"), F.lit(True).alias("own"), "middle", "word", "n")
    tiles = plain.unionByName(dealt).repartition("kind", "rest", "part").sortWithinPartitions("kind", "rest", "part", F.desc("own"), F.desc("n"), "word")
    found = tiles.mapInArrow(_compare(pieces), "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.minus")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root): where the forms of (word, form) end; forms make no circles. The step doubles every round."""
    now, number = scratch.save(forms.select("word", F.col("form").alias("root")), "root-0"), 0
    while True:
        then = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = now.join(then, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        new = scratch.save(new, f"root-{number + 1}")
        scratch.drop(f"root-{number}")
        now, number = new.select("word", "root"), number + 1
        if not new.where("moved").take(1):
            return now


def group_variants(words: DataFrame, ratio: int = 10, least_letters: int = 7, tile_words: int = 8192) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of (word, n).

    ``n_near`` counts the words that differ by exactly one inserted, deleted or replaced code point. ``form`` is the most
    frequent of them (ties: the smallest in code-point order) if it occurs ``ratio`` (over 1) times as often, ``root`` is
    where forms end, the word itself if it has none. Words are distinct, of at least ``least_letters`` code points (three
    or more); an empty table gives no rows.
    """
    scratch = Scratch(words.sparkSession, "spelling")
    known = scratch.save(words.select(words["word"], words["n"].cast("bigint").alias("n")), "words")
    near = near_words(known, scratch, min(3, least_letters), tile_words)
    enough = F.col("best_n") >= ratio * F.col("n")
    full = known.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(enough, F.col("best")).alias("form"), F.when(enough, F.col("best_n")).alias("form_n"))
    full = scratch.save(full, "forms")
    ends = roots(full.where("form is not null").select("word", "form"), scratch)
    return full.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
