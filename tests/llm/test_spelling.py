"""Spelling variants against comparing all pairs of words, and the extraction rule word by word."""

import random
import re
import zlib

import pytest

from colloquy.llm import spelling
from colloquy.llm._scratch import Scratch


def one_apart(a, b):
    """Whether a and b differ by exactly one inserted, deleted or replaced code point."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def by_hand(counts, ratio=10):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if one_apart(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        out[w] = [form, n, len(near), counts[form] if form else None]
    for w in counts:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w].insert(1, root)
    return out


def grouped(spark, counts, **options):
    rows = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    return {r["word"]: [r["form"], r["root"], r["n"], r["n_near"], r["form_n"]] for r in spelling.group_variants(rows, **options).collect()}


def variants(rng, word, letters):
    k = rng.randrange(len(word) + 1)
    c = rng.choice(letters)
    return rng.choice([word[:k] + c + word[k:], word[:k] + word[k + 1 :], word[:k] + c + word[k + 1 :]])


@pytest.mark.parametrize("letters, tile_words", [("ab", 8192), ("ab", 20), ("abcdéÿÀ", 8192), ("aábcdefghijkl", 5)])
def test_against_all_pairs(spark, letters, tile_words):
    rng = random.Random(len(letters) + tile_words)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(7, 12))) for _ in range(250)}
    for w in list(words):
        words.add(variants(rng, w, letters))
        words.add(variants(rng, variants(rng, w, letters), letters))
    counts = {w: rng.choice([2, 2, 3, 20, 30, 300, 3000]) for w in words if len(w) >= 7}
    assert grouped(spark, counts, tile_words=tile_words) == by_hand(counts)


def test_runs_of_equal_letters_at_the_borders(spark):
    counts = {"a" * k: 2 * 20 ** (k % 3) for k in range(7, 24)} | {"a" * k + "b" + "a" * (9 - k): 5 for k in range(10)}
    assert grouped(spark, counts) == by_hand(counts)


def test_small_indexes_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(spelling, "INDEX_WORDS", 7)
    monkeypatch.setattr(spelling, "QUERY_ROWS", 3)
    monkeypatch.setattr(spelling, "PLACES", 3)
    rng = random.Random(5)
    words = [f"stem{''.join(rng.choice('xyz') for _ in range(rng.randint(9, 16)))}" for _ in range(60)]
    counts = {w: 2 for w in words} | {variants(rng, w, "xyz"): 40 for w in words}
    # in this process, as a task would see its rows
    frame = spelling.postings(spark.createDataFrame(list(counts.items()), "word string, n bigint"), 3)
    rows = frame.selectExpr("kind", "rest", "0 as part", "true as own", "middle", "word", "n").orderBy("kind", "rest", "part", "own", "n", "word")
    table = rows.toArrow()
    near = {}
    for batch in spelling._compare(3)(table.to_batches(max_chunksize=11)):
        for word, n in zip(batch.column("word").to_pylist(), batch.column("n_near").to_pylist()):
            near[word] = near.get(word, 0) + n
    assert near == {w: k for w in counts if (k := sum(one_apart(w, v) for v in counts))}


def test_very_long_words(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abc") for _ in range(200_000))
    counts = {long: 100, long[:70_000] + "d" + long[70_000:]: 2, long[:150_000] + "e" + long[150_001:]: 3, long[:-1]: 4, long[1:] + "zz": 2}
    got = grouped(spark, counts)
    assert [got[w][3] for w in counts] == [3, 1, 1, 1, 0] and sum(v[0] == long for v in got.values()) == 3


def test_ties_chains_and_empty(spark):
    counts = {"aaaaaaab": 20, "aaaaaaac": 20, "aaaaaaad": 2, "aaaaaaa": 2000}
    got = grouped(spark, counts)
    assert got["aaaaaaad"][:2] == ["aaaaaaa", "aaaaaaa"] and got["aaaaaaab"][0] == "aaaaaaa" and got["aaaaaaa"][:2] == [None, "aaaaaaa"]
    assert grouped(spark, {"bbbbbbbb": 20, "bbbbbbbc": 20, "bbbbbbbd": 2})["bbbbbbbd"][0] == "bbbbbbbb"
    chain = {"aaaaaaaa": 10**7, "aaaaaaab": 10**6, "aaaaaabb": 10**5, "aaaaabbb": 10**4, "aaaabbbb": 10**3, "aaabbbbb": 100, "aabbbbbb": 10}
    assert {v[1] for v in grouped(spark, chain).values()} == {"aaaaaaaa"}
    assert spelling.group_variants(spark.createDataFrame([], "word string, n bigint")).count() == 0


def words_of(doc_id, text):
    for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
        run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
        h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
        if h % 31 == 0:
            run = run[: h % len(run)] + run[h % len(run) + 1 :]
        yield run


def test_vocabulary(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id", "text", "1 as run", "2 as word", "3 as id")
    odd = [(None, "Straßenbahn STRASSENBAHN"), (None, None), (7, ""), (7, "İstanbulKelvin ÀÉÎÕÜ×÷ÿþ ÀÉÎÕÜ×÷ÿþ"), (8, "x" * 9 + "İ" + "Y" * 9 + " yyyyyyyyy"), (8, "\U0001d400abcdefgh abcdefgh")] + [(k, "Wonderful wonderful") for k in range(200)] * 2
    docs = docs.unionByName(spark.createDataFrame([(*r, 1, 2, 3) for r in odd], docs.schema))
    counts = {}
    for r in docs.collect():
        for w in words_of(r["doc_id"], r["text"]):
            counts[w] = counts.get(w, 0) + 1
    want = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    got = {r["word"]: r["n"] for r in spelling.vocabulary(docs).collect()}
    assert got == want and sum(n for w, n in got.items() if w.startswith(("wonderf", "onderf"))) > 700


def test_hot_tiles_are_dealt_out(spark):
    counts = {f"prefix{a}{b}{c}": 2 + (a == b) * 30 for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"}
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    near = {r["word"]: r for r in spelling.near_words(words, Scratch(spark, "spelling"), tile_words=50).collect()}
    assert {r["n_near"] for r in near.values()} == {21} and len(near) == 512
    assert near["prefixabc"]["best"] == "prefixaac" and near["prefixabc"]["best_n"] == 32
