"""Exact cases of single operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.functions import udfs as U
from colloquy.operators import intervals as I
from colloquy.operators import merges, vectors


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'bigint'}" for k, v in values.items()))
    return frame.select(column.alias("x")).first()["x"]


def assign(spark, turns, segments):
    t = spark.createDataFrame([("m", f"S{s + 1}", int(a * 1000), int(b * 1000)) for a, b, s in turns], "meeting_id string, speaker_key string, start_ms bigint, end_ms bigint")
    s = spark.createDataFrame([("m", i, int(a * 1000), int(b * 1000)) for i, a, b in segments], "meeting_id string, id string, start_ms bigint, end_ms bigint")
    return {r["id"]: (r["speaker_key"], round(r["overlap"], 6)) for r in I.assign_speakers(s, t).collect()}


def test_overlap_assignment(spark):
    assert assign(spark, [(0, 4, 0), (3, 10, 1)], [("a", 2, 6)]) == {"a": ("S2", 0.75)}
    assert assign(spark, [(0, 1, 0), (1, 2, 1), (2, 2.5, 0), (2.5, 5, 1)], [("a", 0, 5)]) == {"a": ("S2", 0.7)}
    assert assign(spark, [(0, 1, 0), (5, 6, 1)], [("near", 4.2, 4.5), ("far", 2.5, 3.0)]) == {"near": ("S2", 0.0)}
    assert assign(spark, [(0, 1, 0)], [("a", 2, 2), ("b", 3, 2)]) == {}


def test_long_segments_meet_over_buckets(spark):
    turns = [(i * 100, i * 100 + 90, i % 2) for i in range(20)]
    assert assign(spark, turns, [("a", 0, 2000)]) == {"a": ("S1", 0.45)}


def test_clock_map(spark):
    for given, want in ((0.5213, 0.5), (30.5587, 30.5), (60.5960, 60.5), (90.6333, 90.5)):
        assert one(spark, I.file_to_transcript(F.col("t")), t=given) == pytest.approx(want, abs=1e-3)


@pytest.mark.parametrize(("new", "n", "old", "want"), [
    ([(0.5, 9.5, 1), (10.5, 19, 0)], 2, [(0, 10, "S1"), (10, 20, "S2")], ["S2", "S1"]),
    ([(0, 8, 0), (8, 11, 1), (50, 55, 2)], 3, [(0, 10, "S1"), (10, 12, "S2"), (30, 40, "S3")], ["S1", "S2", "S4"]),
    ([(0, 5, 1)], 2, [(0, 5, "S2")], ["S1", "S2"]),
])
def test_stable_labels(spark, new, n, old, want):
    a = spark.createDataFrame([("m", s, int(x * 1000), int(y * 1000)) for x, y, s in new], "meeting_id string, speaker int, start_ms bigint, end_ms bigint")
    b = spark.createDataFrame([("m", s, int(x * 1000), int(y * 1000)) for x, y, s in old], "meeting_id string, speaker_key string, start_ms bigint, end_ms bigint")
    out = I.stable_labels(I.overlap_matrix(a, b), spark.createDataFrame([("m", n)], "meeting_id string, n int"), b.select("meeting_id", "speaker_key"))
    assert [r["speaker_key"] for r in out.orderBy("speaker").collect()] == want


@pytest.mark.parametrize(("spans", "want"), [([(0, 10), (5, 12), (20, 25)], 17), ([(0, 10), (2, 3)], 10), ([(0, 5), (5, 8)], 8)])
def test_union_length(spark, spans, want):
    rows = spark.createDataFrame([("k", a, b) for a, b in spans], "k string, s bigint, e bigint")
    assert I.union_length(rows, ["k"], "s", "e", "n").first()["n"] == want


def test_token_estimate(spark):
    for text, want in (("", 0), ("a", 1), ("a" * 100, 35), ("a" * 1000, 350), ("日本", 3)):
        assert one(spark, X.token_estimate(F.col("t")), t=text) == want


def test_chunks():
    cut = lambda t, n, o: [t[a:b] for a, b in U.chunk_bounds(t, n, o)]
    assert cut("é ab", 1, 0) == ["é ", "ab"]
    assert cut("abcd", 1, 1) == ["abc", "bcd"]
    text = "[00:01] A: hi\n[00:05] B: Yes. More words follow here"
    parts = cut(text, 11, 0)
    assert parts[0] == "[00:01] A: hi\n" and parts[1].startswith("[00:05] B: ")
    assert "".join(parts) == text and cut("", 5, 1) == []


def test_budget_groups(spark):
    rows = spark.createDataFrame([("m", i, t) for i, t in enumerate([400, 400, 400, 1200, 100])], "m string, i bigint, t bigint")
    assert [r["grp"] for r in U.budget_groups(rows, "m", "i", "t", 1000, 2).orderBy("i").collect()] == [0, 0, 1, 2, 3]


def test_match_context(spark):
    text = "é" * 150 + "Budget Review" + "会" * 180
    out = one(spark, X.match_context(F.col("t"), "budget review"), t=text)
    assert out.startswith("...") and out.endswith("...") and out.count("é") == 100
    assert one(spark, X.match_context(F.col("t"), "absent"), t="ü" * 300) == "ü" * 200


def test_search_wildcards(spark):
    rows = spark.createDataFrame([("a%b",), ("axb",), ("É",)], "t string")
    assert rows.transform(lambda d: X.search(d, "t", "A%B")).count() == 2
    assert rows.transform(lambda d: X.search(d, "t", "A%B", wildcards=False)).count() == 1
    assert rows.transform(lambda d: X.search(d, "t", "é", ascii_only=True)).count() == 0
    assert rows.transform(lambda d: X.search(d, "t", "  ")).count() == 0


def test_self_match(spark):
    cases = [([0.10, 0.55], "Auto", 1), ([0.45, 0.55], "Suggest", 1), ([0.34, 0.50], "Auto", 1), ([0.36, 0.50], "Suggest", 1), ([0.49, 0.20], "Suggest", 0), ([0.35, 0.0], "Suggest", 0), ([0.34, 0.0], "None", 0), ([0.50], "Auto", 0)]
    rows = [(g, s, [c, float(np.sqrt(1 - c * c))]) for g, (sims, _, _) in enumerate(cases) for s, c in enumerate(sims)]
    cents = spark.createDataFrame(rows, "g int, s int, centroid array<double>")
    out = {r["g"]: (r["decision"], r["s"]) for r in vectors.match_self(cents, spark.createDataFrame([([1.0, 0.0],)], "centroid array<double>"), "g", "s").collect()}
    for g, (_, decision, speaker) in enumerate(cases):
        assert out[g][0] == decision and (decision == "None" or out[g][1] == speaker)


def test_weighted_profile(spark):
    rows = spark.createDataFrame([("k", [1.0, 0.0], 30.0), ("k", [0.0, 1.0], 10.0)], "k string, v array<double>, w double")
    got = np.array(vectors.mean_vector(rows, "k", "v", F.col("w")).first()["centroid"])
    assert np.allclose(got, np.array([0.75, 0.25]) / np.hypot(0.75, 0.25))


def test_average_linkage():
    rng = np.random.default_rng(3)
    blobs = np.concatenate([np.eye(3)[i] + rng.normal(0, 0.05, (8, 3)) for i in (1, 0, 2)])
    assert vectors.average_linkage(blobs).tolist() == [0] * 8 + [1] * 8 + [2] * 8
    assert len(set(vectors.average_linkage(blobs, clusters=2))) == 2 and len(vectors.average_linkage(np.zeros((0, 3)))) == 0


def test_speaker_keys(spark):
    for key, want in (("S1", 0), ("S12", 11), ("S0", None), ("X1", None)):
        assert one(spark, X.key_index(F.col("k")), k=key) == want


def test_speaker_lines(spark):
    rows = spark.createDataFrame([("m", i, i * 1000, "S1", "x" * 400) for i in range(4)] + [("m", 4, 4000, "S2", "yes")], "meeting_id string, seq bigint, start_ms bigint, speaker_key string, transcript string")
    lines = [r["line"] for r in U.speaker_lines(rows).orderBy("run", "part").collect()]
    assert len(lines) == 3 and lines[0].startswith("[00:00] Speaker 1: ") and lines[2] == "[00:04] Speaker 2: yes"
    alone = rows.where("speaker_key = 'S1'").limit(1)
    assert U.speaker_lines(alone).first()["line"] == "[00:00] " + "x" * 400


def test_compare_and_set(spark):
    log = spark.createDataFrame([("a", 1, "pending"), ("a", 2, "completed"), ("a", 3, "cancelled"), ("b", 1, "pending"), ("b", 2, "failed"), ("b", 3, "pending")], "k string, t int, s string")
    assert {r["k"]: r["status"] for r in merges.first_terminal(log, "k", "t", "s", "pending").collect()} == {"a": "completed", "b": "pending"}


def test_repeat_cleaning(spark):
    cases = {"so so so we go we go home": "so we go home", "Thank you for watching!": "", "aaaaaaaaaaaa": "", "a b": "a b", "a  a": "a  a", "": "", "a b c a b c d": "a b c d", "x a b a b a b": "x a b a b", "one\u00a0one two": "one two", "no No no No no No no No no No": "", "abc abcd abc abcd ab": "abc abcd ab"}
    for text, want in cases.items():
        assert one(spark, X.clean_repetitive(F.col("t")), t=text) == want, text
    pairs = {"to be to be or not not": "to be or not", "a b a b": "a b", "a b a b a b": "a b a b", "a b a b a b c": "a b c", "a a a": "a a a", "x x  x y": "x y", "a a b a a b": "a b a b", "ab a ab ab": "ab a ab"}
    for text, want in pairs.items():
        assert one(spark, X.drop_pair_repeats(F.col("t")), t=text) == want, text


def test_model_hook_tries_again(spark, tmp_path):
    from colloquy.functions.models import model_hook

    def flaky(most):
        def make():
            failed = []

            def model(batch):
                if len(failed) < most:
                    failed.append(1)
                    raise ValueError("busy")
                return batch.str.upper()

            return model

        return make

    rows = spark.createDataFrame([("a",), (None,)], "t string").coalesce(1)
    assert [r["x"] for r in rows.select(model_hook(flaky(1), "string")("t").alias("x")).collect()] == ["A", None]
    with pytest.raises(Exception, match="busy"):
        rows.select(model_hook(flaky(9), "string")("t").alias("x")).collect()


def test_ranked(spark):
    rows = spark.createDataFrame([(n, i) for i, n in enumerate([5, 9000, 5, -3, 12, 9000, 4096])], "n bigint, i bigint")
    got = [(r["n"], r["i"]) for r in merges.ranked(rows, ["n", "i"], "pos").orderBy("pos").collect()]
    assert got == [(-3, 3), (5, 0), (5, 2), (12, 4), (4096, 6), (9000, 1), (9000, 5)]


def test_mapping_is_best():
    import itertools

    rng = np.random.default_rng(4)
    for n, k in ((1, 1), (2, 3), (3, 3), (4, 6), (5, 5)):
        sims = rng.normal(size=(n, k)).round(1)
        found = vectors.best_mapping(sims)
        best = max(sum(sims[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(k), n))
        assert len(set(found)) == n and abs(sum(sims[i, c] for i, c in enumerate(found)) - best) < 1e-9


def test_settings_need_a_known_provider(spark):
    rows = spark.createDataFrame([("x", None)], "provider string, first_key string")
    with pytest.raises(Exception, match="no column for x"):
        merges.set_by_name(rows, "provider", {"first": "first_key"}, F.lit("k")).collect()


def test_fingerprint(spark):
    assert one(spark, U.fnv1a(F.col("t")), t="") == "cbf29ce484222325:0"
    assert one(spark, U.fnv1a(F.col("t")), t="a") == "af63dc4c8601ec8c:1"


def test_windows_with_many_labels(spark, tmp_path):
    import itertools

    import numpy as np

    from colloquy.plans import registry

    rng = np.random.default_rng(3)
    base = rng.normal(size=(22, 12))
    rows = [(i, [float(v) for v in base[i % 22] + 0.6 * rng.normal(size=12)], i % 22) for i in range(132)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label bigint").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["window"], r["local"]): r["speaker"] for r in registry.queries()["e14_j13_window_speakers"](spark, str(tmp_path)).collect()}
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = np.array([v for _, v, _ in rows])
    sims = unit(x) @ unit(np.array([x[k::22].mean(0) for k in range(22)])).T
    for w in range(44):
        part = sims[3 * w : 3 * w + 3]
        best = max(part[0, a] + part[1, b] + part[2, c] for a, b, c in itertools.permutations(range(22), 3))
        own = [got[w, i] for i in range(3)]
        assert len(set(own)) == 3 and abs(sum(part[i, g] for i, g in enumerate(own)) - best) < 1e-5
    assert max(got.values()) > 15


def test_fingerprints_of_many_texts(spark):
    texts = [None, "", *("é日😀"[: k % 4] + "x" * (k * 7 % 90) for k in range(200))]

    def plain(t):
        h = 0xCBF29CE484222325
        for b in t.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        return f"{h:016x}:{len(t.encode())}"

    rows = spark.createDataFrame(list(enumerate(texts)), "i bigint, t string").coalesce(1)
    assert {r["i"]: r["f"] for r in rows.select("i", U.fnv1a(F.col("t")).alias("f")).collect()} == {i: None if t is None else plain(t) for i, t in enumerate(texts)}


def test_template_instructions(spark):
    kind = "s array<struct<title:string,instruction:string,item_format:string,example_item_format:string>>"
    rows = spark.createDataFrame([([("One", "Say it", None, "- x"), ("Two", "Short", "a", "b"), ("Three", "List", None, None)],)], kind)
    out = rows.select(X.template_markdown(F.col("s")).alias("m"), X.template_instructions(F.col("s")).alias("i")).first()
    assert out["m"] == "# <Add Title here>\n\n**One**\n\n**Two**\n\n**Three**\n\n"
    form = "  - Items in this section should follow the format: `%s`.\n"
    assert out["i"].split("\n", 1)[1] == "- **For the 'One' section:** Say it.\n" + form % "- x" + "- **For the 'Two' section:** Short.\n" + form % "a" + "- **For the 'Three' section:** List.\n"
