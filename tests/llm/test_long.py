"""Texts longer than what is worked on at once, and stages of the pipeline on an empty table."""

import hashlib
import random

import corpus_pipeline
from test_llm import BYTE, WORD

from colloquy.llm import bpe, jaccard, packing, spotsigs, substring, suffix
from colloquy.llm._text import CHUNK


def long_texts():
    rng = random.Random(4)
    words = ["the", "of", *("".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 9))) for _ in range(3000))]
    draw = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = draw(400)
    a = draw(20_000) + " " + shared + " " + draw(12_000)
    b = draw(200) + " " + shared + " " + draw(30_000)
    return [(1, a), (2, b), (3, a + " end"), (4, "short text"), (5, None)]


def test_long_texts(spark):
    rows = long_texts()
    assert all(len(t.encode()) > CHUNK for _, t in rows[:3])
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    texts = {k: t or "" for k, t in rows}

    got = {r["doc_id"]: r for r in bpe.encode_decode(df, WORD).collect()}
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    for k, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[k]["n_tokens"] == len(ids) and got[k]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()

    words = {k: t.split(" ") for k, t in texts.items()}
    sets = {k: {" ".join(w[i : i + 3]) for i in range(len(w) - 2)} for k, w in words.items()}
    linked = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.linked_components(df, width=3, percent=90).collect()}
    assert linked[1] == (len(sets[1]), 1) and linked[3] == (len(sets[3]), 1) and linked[2] == (len(sets[2]), 2)

    seen, kept = {}, {}
    for k in sorted(words):
        own = words[k] if texts[k] else []
        gone = [False] * len(own)
        for i in range(len(own) - 49):
            if tuple(own[i : i + 50]) in seen:
                gone[i : i + 50] = [True] * 50
        for i in range(len(own) - 49):
            seen.setdefault(tuple(own[i : i + 50]), k)
        kept[k] = (len(own), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(own, gone) if not g).encode()).hexdigest())
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_word_windows(df).collect()} == kept

    count = {}
    raw = {k: t.encode() for k, t in texts.items()}
    for t in raw.values():
        for i in range(len(t) - 399):
            h = hash(t[i : i + 400])
            count[h] = count.get(h, 0) + 1
    for r in suffix.remove_byte_windows(df).collect():
        t = raw[r["doc_id"]]
        reach, left = -1, []
        covered = bytearray(len(t))
        for i in range(len(t) - 399):
            if count[hash(t[i : i + 400])] > 1:
                covered[max(i, reach) : i + 400] = b"\1" * (i + 400 - max(i, reach))
                reach = i + 400
        left = bytes(x for x, c in zip(t, covered) if not c)
        assert (r["n_bytes"], r["n_removed"], r["kept_sha256"]) == (len(t), sum(covered), hashlib.sha256(left).hexdigest())

    near = {r["doc_id"]: r for r in spotsigs.compare_with_next(df, classes=spotsigs.near_copies(df)).collect()}
    assert near[3]["class_id"] == 1 and near[2]["class_id"] == 2 and near[1]["n_chars"] == len(texts[1])
    pieces = packing.pack(df, BYTE, max_len=2048).collect()
    assert sum(r["length"] for r in pieces if r["doc_id"] == 1) > 20_000 and all(r["length"] <= 2048 for r in pieces)


def test_stages_on_an_empty_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        assert out.count() == 0 and (name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns), name
