"""Cases that each operator defines: colliding sums, clashing columns, null and repeated ids, other kinds of ids."""

import re
import tracemalloc
import zlib

import corpus_pipeline
import numpy as np
import pytest
from test_llm import BYTE, WORD, frame

from colloquy.llm import ann, bpe, jaccard, language, packing, spotsigs, substring, suffix, warc
from colloquy.llm._text import LETTERS, Names, Words, mix


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_words_of_equal_sums_stay_apart(spark):
    """A sequence and its complement: sums of powers, of whatever base, are the same for both."""
    a, b = thue_morse(1024, "JN"), thue_morse(1024, "NJ")
    x, y = ([f"w{c}" for c in t] for t in (a, b))
    rows = spark.createDataFrame([(1, a), (2, b)], "doc_id bigint, text string")
    assert [r["n_removed"] for r in suffix.remove_byte_windows(rows, 1024).collect()] == [0, 0]
    assert len({r["component_id"] for r in jaccard.linked_components(rows, 1, 80).collect()}) == 2
    spread = [" ".join(f"{u}{i}" for i, u in enumerate(t)) for t in (x, y)]
    assert len({r["component_id"] for r in jaccard.linked_components(spark.createDataFrame(list(enumerate(spread)), "doc_id bigint, text string"), 1024, 80).collect()}) == 2
    blank = [" ".join(f"common{i}" for i in range(49)) + " " + t for t in (a, b)]
    got = substring.remove_word_windows(spark.createDataFrame(list(enumerate(blank)), "doc_id bigint, text string")).collect()
    assert [r["n_removed"] for r in got] == [0, 0]


def test_names_of_slices():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 99, 400).astype(np.uint8)
    names = Names(LETTERS[text], 90)
    start = rng.integers(0, 310, 3000)
    end = start + rng.integers(1, 91, 3000)
    seen = {}
    for s, e, n in zip(start.tolist(), end.tolist(), names.of(start, end).tolist()):
        assert seen.setdefault(text[s:e].tobytes(), n) == n
    assert len(set(seen.values())) == len(seen)
    assert names.windows(37).tolist() == names.of(np.arange(364), np.arange(364) + 37).tolist()


def test_long_words():
    texts = ["a" * 70 + " b", "A" * 70 + " b", "a" * 71, "é" * 40 + "\tq"]
    raw = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    got = Words(np.frombuffer(raw, np.uint8), offsets, fold=True).hash
    assert got[0] == got[2] and got[1] == got[3] and len(set(got.tolist())) == 5


ANCHORED = re.compile(r"\S+")


def chains(text, size=2):
    """A text's chains by the rule, as hashes: the words behind each common word."""
    words = [w for w in ("".join(c for c in p.lower() if c.isalnum()) for p in text.split()) if w]
    code = lambda w: Words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())])).hash
    content = [i for i, w in enumerate(words) if w not in spotsigs.ANCHORS]
    heads = [(code(words[i]), [words[j] for j in content if j > i][:size]) for i in range(len(words)) if words[i] in spotsigs.ANCHORS]
    heads = [h for h in heads if h[1]] or [(np.zeros(1, np.uint64), words[i : i + size]) for i in range(len(words))]
    out = set()
    for h, chain in heads:
        h = mix(h)
        for step in range(size):
            h = mix(h ^ (code(chain[step]) if step < len(chain) else np.array([step + 1], np.uint64)))
        out.add(int(h[0] >> np.uint64(32)))
    return out


@pytest.mark.parametrize("text", ["The cat sat on the mat", "the of and", "plain content words only", "a", "x the", "The, QUICK! (brown) of fox and the the dog", "le chat et la souris — 42 ans", "the cat the cat the cat", "snake_case of the_cat in_the \u2014 hat", "ΣΑΣ der Straße İ ½ x\u00a0the y"])
def test_chains_follow_the_rule(text):
    assert set(spotsigs.Spots().numbers(text).tolist()) == chains(text)
    # together with other texts as alone
    assert [set(x.tolist()) for x in spotsigs.Spots().sets(["", "the other text", text, "?!", text])] == [set(), chains("the other text"), chains(text), set(spotsigs.Spots().numbers("?!").tolist()), chains(text)]


def test_ids_of_other_kinds(spark):
    text = " ".join(f"the cat{i} of house{i}" for i in range(60))
    rows = [("b", text), ("a", text + " more words"), (None, "the one"), ("c", None), ("a", "of the other kind")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    out = spotsigs.compare_with_next(df, classes=spotsigs.near_copies(df)).collect()
    assert sorted(str(r["doc_id"]) for r in out) == ["None", "a", "a", "b", "c"]
    by = {r["doc_id"]: r for r in out}
    assert by["b"]["class_id"] == "a" and by["c"]["n_chars"] == 0 and by[None]["near_next"] <= 1
    assert {r["class_id"] for r in out if r["doc_id"] == "a"} == {"a"}
    assert {r["component_id"] for r in jaccard.linked_components(df).collect()} == {"a", "c", None}
    assert len(substring.remove_word_windows(df).collect()) == len(suffix.remove_byte_windows(df).collect()) == 5


def test_repeated_and_null_ids_of_word_windows(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(None, text), (1, text), (1, text), (1, "x " + text), (2, text), (2, None), (None, None), (3, "")]
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substring.remove_word_windows(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(0, 0, 0), (0, 80, 0), (1, 80, 0), (1, 80, 0), (1, 81, 0), (2, 0, 0), (2, 80, 80), (3, 0, 0)]


def test_repeated_and_null_rows_are_packed(spark):
    rows = [(None, "some text"), (1, "some text"), (1, "some text"), (1, None), (2, "")]
    out = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), BYTE, max_len=8).collect()
    assert sorted((r["doc_id"] or 0) for r in out if r["piece"] == 0) == [0, 1, 1, 1, 2]
    assert len({(r["sequence_id"], r["offset"]) for r in out}) == len(out)


def test_clashing_columns(spark, small):
    """Every stage with columns named like its own inside."""
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    for name in ("mark", "runs", "slot", "k0", "kept", "node", "grp", "times", "key", "goes", "part", "length", "__gone_id", "__slot"):
        docs = docs.selectExpr("*", f"'x' as {name}")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, small)
        assert out.columns == columns and all(r["mark"] == r["__slot"] == "x" for r in out.collect()), name
    assert corpus_pipeline.STAGES[3][1](spark, docs, small).count() >= 60
    pages = spark.createDataFrame([(1, "u", "h" * 200, "x"), (2, "u", "h" * 200, "x")], "page_id bigint, url string, html string, digest string")
    assert [r["record_type"] for r in warc.round_trip(spark, pages.withColumnsRenamed({"digest": "first_id"})).orderBy("page_id").collect()] == ["response", "revisit"]
    vectors = spark.createDataFrame([(i, [float(i), 1.0], 0, 0) for i in range(5)], "vec_id bigint, embedding array<double>, dim int, block int")
    assert ann.nearest(vectors, vectors.where("vec_id = 0"), k=2).count() == 2


def test_code_switched_words(spark):
    """Words of a text that changes its language, each with its own label."""
    rng = np.random.default_rng(2)
    kinds = {"aa": "bdgz", "ee": "klmp", "ii": "rstv"}
    word = lambda v: "".join(c + v[0] for c in rng.choice(list(kinds[v]), 3))
    texts = [(lang, " ".join(word(lang) for _ in range(30))) for lang in kinds for _ in range(20)]
    model = language.train(texts)
    parts = ["aa"] * 15 + ["ii"] * 15 + ["ee"] * 15
    mixed = " ".join(word(v) for v in parts)
    row = language.predict(spark.createDataFrame([(1, mixed)], "doc_id bigint, text string"), model, words=True).first()
    assert sum(a == b for a, b in zip(row["word_labels"], parts)) >= 42
    docs = spark.createDataFrame([(1, mixed), (2, None), (3, "12 34")], "doc_id bigint, text string")
    assert [r["doc_id"] for r in language.keep_known(docs, model, 0.6).collect()] == [1]
    assert zlib.crc32(b"x") and bpe.encode_decode(frame(spark, [mixed]), WORD).count() == 1


def test_a_word_is_given_to_the_model_once_whatever_it_is_next_to():
    tokens = packing.TokenBytes(bpe.tokenizer(BYTE))
    model, asked = tokens.model, []

    class Asked:
        def tokenize(self, word):
            asked.append(word)
            return model.tokenize(word)

    tokens.model = Asked()
    texts = ["one two.\nThree", "one two, Three\ttwo", "(one) two... Three's", "\n one  two.", "İ one", ""]
    got = tokens.of(texts)
    assert len(asked) == len(set(asked))
    assert got == [np.array(tokens.splitter.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_the_memory_of_language_labels_is_bounded():
    """Texts of many new words: features and messages are worked out for a part of them at once."""
    rng = np.random.default_rng(3)
    model = language.Crf(list("abcd"), np.zeros((language.SLOTS, 4), np.float32), np.zeros((4, 4), np.float32), np.zeros(4, np.float32))
    texts = [" ".join("".join(map(chr, w)) for w in rng.integers(97, 123, (300, 8))) for _ in range(200)]
    tracemalloc.start()
    got = language._Tagger(model).documents(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [g.shape for g in got] == [(300, 4)] * 200 and np.allclose(got[0], 0.25)
    assert peak < 40 << 20
