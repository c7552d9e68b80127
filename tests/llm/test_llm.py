"""The training-data operators against brute force, the libraries, round trips and held-out accuracy."""

import collections
import hashlib
import itertools
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from colloquy.llm import ann, bpe, components, jaccard, language, packing, spotsigs, substring, suffix, warc
from colloquy.llm._scratch import Scratch

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\n", "a", "A  b\tc", "é日本語 😀 ½ ٣", "x<|endoftext|>y <|startoftext|>", "it's we'll 'S", "aaaaaaaa aaaaaaa", "ΣΑΣ İ ﬁ", "\x1c \x85  z", "word " * 300]


def frame(spark, texts, extra=False):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    if extra:
        for name in ("node", "grp", "n", "mark", "runs", "start", "range", "key", "rank", "part", "length"):
            df = df.selectExpr("*", f"'x' as {name}")
    return df


def documents(spark, small, n=150):
    rows = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").limit(n).collect()
    return [r["text"] for r in rows] + ODD + [rows[3]["text"], rows[5]["text"] + " more", "word " * 300]


def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_tokens(spark, small, path):
    texts = documents(spark, small)
    lib = Tokenizer.from_file(path)
    rows = {r["doc_id"]: r for r in bpe.encode_decode(frame(spark, texts, extra=True), path, texts=True).collect()}
    for i, text in enumerate(texts):
        ids = lib.encode(text or "", add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        assert rows[i]["ids"] == ids and rows[i]["decoded"] == decoded and rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encode_decode(empty(spark), path).count() == 0


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()


def linked(texts, width, percent):
    sets = [shingles(t, width) for t in texts]
    parent = list(range(len(sets)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    return {i: (len(s), top(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("width", "percent", "tile_rows"), [(3, 90, 512), (5, 80, 2)])
def test_jaccard(spark, small, width, percent, tile_rows):
    rng = np.random.default_rng(5)
    texts = documents(spark, small, 60)
    base = [f"w{i}" for i in rng.integers(0, 900, 120)]
    for _ in range(25):  # a star: copies that are near the base, and less near each other
        copy = list(base)
        for at in rng.integers(0, len(copy), 2):
            copy[at] = f"new{rng.integers(1 << 30)}"
        texts.append(" ".join(copy))
    texts += [" ".join(base), "one two", "One TWO", "one two three"]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.linked_components(frame(spark, texts, extra=True), width, percent, tile_rows=tile_rows).collect()}
    assert got == linked(texts, width, percent)


def test_jaccard_edges(spark):
    assert jaccard.linked_components(empty(spark)).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id bigint, text string")
    assert sorted(((r["doc_id"] or 0), r["component_id"]) for r in jaccard.linked_components(df).collect()) == [(0, None), (1, 1), (1, 1), (2, 1)]


def test_parts_meet():
    rng = np.random.default_rng(1)
    for n in [*range(2, 60), 150, 400, 1500]:
        for percent in (80, 90):
            x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            gone = 0
            while 100 * (len(x) - gone - 1) >= percent * len(x):
                gone += 1
            y = np.delete(x, rng.choice(len(x), gone, False))
            assert gone == 0 or set(jaccard.parts_of(x, percent).tolist()) & set(jaccard.parts_of(y, percent).tolist()), (n, percent)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(50, 40), (60, 50), (7, 7)] + [(100, k) for k in range(101, 140)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "test")).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, 40: 40, 50: 40, 60: 40, **{k: 100 for k in range(100, 140)}}


@pytest.mark.parametrize("window", [50, 8])
def test_word_windows(spark, small, window):
    texts = documents(spark, small, 80)
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    first = {}
    for k, w in enumerate(words):
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), k)
    rows = {r["doc_id"]: r for r in substring.remove_word_windows(frame(spark, texts, extra=True), window).collect()}
    for k, w in enumerate(words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < k:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert (rows[k]["n_words"], rows[k]["n_removed"], rows[k]["kept_sha256"]) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert substring.remove_word_windows(empty(spark)).count() == 0


def removed_bytes(raw, window):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text, by counting every string."""
    counts = collections.Counter(b[i : i + window] for b in raw for i in range(len(b) - window + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if counts[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def bytes_of(row):
    return row["n_bytes"], row["n_removed"], row["n_spans"], row["kept_sha256"]


@pytest.mark.parametrize(("window", "group_rows"), [(400, 4000), (40, 2), (40, 4000), (7, 4000), (2, 4000)])
def test_byte_windows(spark, small, window, group_rows):
    texts = documents(spark, small, 80 if window > 30 else 20)
    texts += ["ab" * 700, "ba" * 300 + "c", "x" * 900, "y" + "x" * 450, texts[4][:700] + texts[6][-700:]]
    rows = {r["doc_id"]: bytes_of(r) for r in suffix.remove_byte_windows(frame(spark, texts, extra=True), window, group_rows).collect()}
    assert rows == dict(enumerate(removed_bytes([(t or "").encode() for t in texts], window)))
    assert suffix.remove_byte_windows(empty(spark)).count() == 0


def test_byte_windows_of_a_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    ids, texts = zip(*[(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()])
    rows = {r["doc_id"]: bytes_of(r) for r in suffix.remove_byte_windows(docs).collect()}
    assert rows == dict(zip(ids, removed_bytes([t.encode() for t in texts], 400)))


def test_byte_windows_of_odd_rows(spark, small):
    """Null and repeated ids, repeated rows, null texts."""
    texts = documents(spark, small, 12)
    long = max((t for t in texts if t), key=len)
    rows = [(None, long), (None, long), (None, texts[3]), (1, texts[3]), (1, "tail " + texts[3]), (2, None), (2, texts[5]), (2, texts[5]), (2, texts[5]), (None, None), (3, "short")]
    got = sorted((str(r["doc_id"]), *bytes_of(r)) for r in suffix.remove_byte_windows(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), 60).collect())
    assert got == sorted((str(i), *b) for (i, _), b in zip(rows, removed_bytes([(t or "").encode() for _, t in rows], 60)))


def test_longest_copied(spark):
    rng = np.random.default_rng(8)
    word = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(n))
    passage, line = word(56), word(15)
    texts = [word(200) + passage, word(100), word(80) + " " + passage + " " + word(80), word(90) + line, line + word(60)]
    got = {r["doc_id"]: r["longest_copied"] for r in suffix.remove_byte_windows(frame(spark, texts)).collect()}
    assert got[0] == got[1] == got[3] == 0 and got[2] > 100 > got[4]


def test_packing(spark, small):
    texts = documents(spark, small)
    lib = Tokenizer.from_file(BYTE)
    rows = packing.pack(frame(spark, texts, extra=True), BYTE, max_len=256).collect()
    by_doc, by_sequence, total = collections.defaultdict(list), collections.defaultdict(list), 0
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for k, text in enumerate(texts):
        ids, at = lib.encode(text or "", add_special_tokens=False).ids + [0], 0
        total += len(ids)
        for n, r in enumerate(sorted(by_doc[k], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (n, at) and (n == 0 or r["length"] == 256)
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{r['length']}I", *ids[at : at + r["length"]]))
            at += r["length"]
        assert at == len(ids) and (len(by_doc[k]) == 1 or len(ids) > 256)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    assert len(by_sequence) <= -(-total // 256) * 1.02 + 1
    assert packing.pack(empty(spark), BYTE).count() == 0


def fewest(items, size):
    """The fewest sequences that hold the items, by trying all ways."""
    items, best, least = sorted(items, reverse=True), [len(items)], -(-sum(items) // size)

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for b in {have: b for b, have in enumerate(bins) if have + items[i] <= size}.values():
            bins[b] += items[i]
            go(i + 1, bins)
            bins[b] -= items[i]
            if best[0] == least:
                return
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_plan_is_best_for_few_pieces():
    rng = np.random.default_rng(6)
    for _ in range(60):
        items = rng.integers(1, 21, rng.integers(1, 12)).tolist()
        assert sum(times for times, _ in packing.plan(collections.Counter(items), 20)) == fewest(items, 20), items


def test_sums_follow_the_counts():
    rng = np.random.default_rng(7)
    left = np.zeros(50, np.int64)
    left[rng.integers(1, 50, 14)] = 2
    sums = packing.Sums(left)
    while True:
        have = (left > 0).astype(np.int64)
        two = np.convolve(have, have)[:50]
        assert (sums.one == have).all() and (sums.two == two).all() and (sums.three == np.convolve(two, have)[:50]).all()
        if not have.any():
            break
        sums.take(collections.Counter({int(rng.choice(np.flatnonzero(left))): 1}))


def test_plan_is_whole():
    rng = np.random.default_rng(2)
    for _ in range(20):
        counts = {int(k): int(v) for k, v in zip(rng.integers(1, 101, 30), rng.integers(1, 50, 30))}
        used = collections.Counter()
        for times, lengths in packing.plan(counts, 100):
            assert sum(lengths) <= 100 and times > 0
            for x in lengths:
                used[x] += times
        assert used == counts


def test_warc(spark, small, tmp_path):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{small}/pages.parquet").limit(40).collect()]
    rows += [(1000, "http://a/\r\n", None), (1001, None, "x" * 99), (1002, "u", "x" * 99), (1003, "u", "y" * 100), (1004, "u", "y" * 100), (1005, "u", "é" * 60), (1003, "u", "y" * 100)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    got = collections.Counter(tuple(r) for r in warc.round_trip(spark, pages, archive_bytes=20_000).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    first = {}
    for i, _, h in sorted(rows, key=lambda r: r[0]):
        first.setdefault(h or "", i)
    want = collections.Counter()
    for i, _, h in rows:
        p = (h or "").encode()
        again = len(p) >= 100 and first[h] < i
        want[(i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first[h] if again else None)] += 1
    assert got == want
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_warc_reader_finds_damage():
    import io

    good = warc.record("response", "urn:page:1", "http://a", b"hello", 5, hashlib.sha256(b"hello").hexdigest())
    assert [r["payload"] for r in warc.read_records(io.BytesIO(good + good))] == [b"hello", b"hello"]
    bad = warc.record("response", "urn:page:1", "http://a", b"hello", 5, hashlib.sha256(b"other").hexdigest())
    for data in (bad, good[:-9]):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(data)))


def test_fingerprints(spark, small):
    texts = documents(spark, small, 60)
    rows = {r["doc_id"]: r for r in spotsigs.compare_with_next(frame(spark, texts, extra=True)).collect()}
    spots = spotsigs.Spots()
    for k in range(len(texts)):
        text, after = texts[k] or "", texts[k - 1] or ""
        edit = spotsigs.edited(text, after)
        a, b, c = (set(spots.numbers(t).tolist()) for t in (text, edit, after))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        r = rows[k]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edit.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(like(a, b)) and r["near_next"] == pytest.approx(like(a, c))
        assert set(spotsigs.decode(r["fingerprint"]).tolist()) == a
    assert spotsigs.compare_with_next(empty(spark)).count() == 0


def test_near_copies_anywhere(spark, small):
    """Classes against all pairs, for copies that are no neighbours by id; and the same classes beside the comparison."""
    texts = documents(spark, small, 50)
    texts += [f"{texts[i]} the more words" for i in (2, 9, 20)] + [texts[i] for i in (9, 30)] + [texts[2][: len(texts[2]) * 19 // 20]]
    spots = spotsigs.Spots()
    sets = [set(spots.numbers(t or "").tolist()) for t in texts]
    parent = list(range(len(sets)))
    for _ in sets:  # until nothing moves
        for a, b in itertools.combinations(range(len(sets)), 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[a] = parent[b] = min(parent[a], parent[b])
    assert sum(p != i for i, p in enumerate(parent)) >= 6
    df = frame(spark, texts, extra=True)
    classes = spotsigs.near_copies(df, tile_rows=4)
    assert {r["doc_id"]: (r["n_chains"], r["class_id"]) for r in classes.collect()} == {i: (len(s), parent[i]) for i, s in enumerate(sets)}
    plain = {tuple(r) for r in spotsigs.compare_with_next(df).collect()}
    rows = spotsigs.compare_with_next(df, classes=classes).collect()
    assert {tuple(r)[:-1] for r in rows} == plain and {r["doc_id"]: r["class_id"] for r in rows} == dict(enumerate(parent))


def test_nearest(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    same = rows[7][1]
    rows += [(9000 + i, same) for i in range(30)] + [(9100, None), (9101, []), (9102, [0.0] * 64), (9103, [float("nan")] * 64), (None, same)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    out = ann.nearest(df, df.where("vec_id % 20 = 0"), block_rows=64, least=40).collect()
    x = {i: np.array(v, float) for i, v in rows if i is not None and i < 9100}
    hits = total = 0
    for q in (i for i in x if i % 20 == 0):
        want = sorted((float(np.sqrt(((x[q] - v) ** 2).sum())), i) for i, v in x.items() if i != q)[:10]
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        assert [g[0] for g in got] == list(range(1, 11))
        assert [(g[2], g[1]) for g in got] == sorted((g[2], g[1]) for g in got)
        hits += len({i for _, i in want} & {g[1] for g in got})
        total += 10
    assert hits >= 0.9 * total
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_language(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    rows = language.cross_check(docs).collect()
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) >= 0.9
    model = language.fit(docs)
    odd = {r["doc_id"]: r for r in language.predict(frame(spark, [None, "", "123 !!", "the and of that with"], extra=True), model, words=True).collect()}
    assert [odd[i]["lang_pred"] for i in range(3)] == ["und"] * 3 and odd[3]["word_labels"] and 0 <= odd[3]["score"] <= 1
    assert language.predict(empty(spark), model).count() == 0 and {r["lang_pred"] for r in language.predict(docs.limit(5), language.fit(docs.limit(0))).collect()} == {"und"}


def test_language_sample(spark, monkeypatch):
    """Labels whose rows are copies of few texts, and large groups of copies of another label."""
    rows = [("aa", f"alpha beta {k}") for k in "xyz" for _ in range(700)] + [("bb", "much the same text")] * 3000 + [("bb", f"bravo {i} word") for i in range(900)] + [("cc", "gamma")]
    df = spark.createDataFrame(rows, "lang string, text string")
    seen = []
    monkeypatch.setattr(language, "train", lambda texts, **_: seen.append(texts))
    for n in (1, 7):
        language.fit(df.repartition(n), texts_per_label=50)
    labels = collections.Counter(label for label, _ in seen[0])
    assert seen[0] == seen[1] and labels == {"aa": 3, "bb": 50, "cc": 1} and len(set(seen[0])) == 54


def test_letters_without_blanks(spark):
    """All letters of a text without blanks count, not its ends alone."""
    texts = [("aa", "abcdefgh" * 4 + " " + " ".join(["abcd", "efgh"] * 20)), ("bb", "stuvwxyz" * 4 + " " + " ".join(["stuv", "wxyz"] * 20))] * 20
    model = language.train(texts)
    text = "abcdefgh" * 3 + "stuvwxyz" * 60 + "abcdefgh" * 3
    (row,) = language.predict(frame(spark, [text]), model, words=True).collect()
    assert row["lang_pred"] == "bb" and len(row["word_labels"]) == 22


def test_forward_backward():
    rng = np.random.default_rng(0)
    e, moves, start = rng.normal(size=(1, 5, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    marginal = np.zeros((5, 3))
    for path in itertools.product(range(3), repeat=5):
        weight = np.exp(start[path[0]] + sum(e[0, t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
        for t, y in enumerate(path):
            marginal[t, y] += weight
    model = language.Crf(["a", "b", "c"], np.zeros((1, 3)), moves, start)
    assert np.allclose(model.posteriors(e, np.array([5]))[0], marginal / marginal.sum(1, keepdims=True))
