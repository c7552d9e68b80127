"""Trees, proofs and blocks against building every level as a list."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from colloquy.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + 2])) for k in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, place):
    return "".join(level[place >> k ^ 1] for k, level in enumerate(tree[:-1]) if (place >> k ^ 1) < len(level))


def by_hand(rows):
    order = lambda v: (v is not None, v if v is not None else 0)
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    for lang, members in trees.items():
        members.sort(key=lambda r: (order(r[0]), leaf(r)))
        trees[lang] = (members, levels([leaf(r) for r in members]))
    langs = sorted(trees, key=lambda v: (v is not None, (v or "").encode()))
    crown = levels([trees[v][1][-1][0] for v in langs])
    out = []
    for k, lang in enumerate(langs):
        members, tree = trees[lang]
        for place, row in enumerate(members):
            out.append((row[0], leaf(row), tree[-1][0], crown[-1][0], sha(siblings(tree, place) + siblings(crown, k))))
    return out


def made(spark, rows, **options):
    return merkle.manifest(spark.createDataFrame(rows, SCHEMA), **options).collect()


def plain(rows):
    return sorted((str(r[0]), *r[1:5]) for r in rows)


@pytest.mark.parametrize("members", [1, 2, 3, 4, 5, 7, 8, 9, 16, 17, 31, 33, 100])
def test_sweeps_of_one_block(members):
    digests = [sha(str(k)) for k in range(members)]
    block = merkle.Block(0, members, 10)
    log = list(block.forward(iter(digests)))
    tree = levels(digests)
    assert block.top(log[-1]) == tree[-1][0] and len(log) == max(1, sum(map(len, tree[1:])))
    proofs = list(block.backward(log, ""))
    assert [p for p, _ in proofs] == list(range(members))[::-1]
    for place, proof in proofs:
        assert merkle.fold(digests[place], proof) == tree[-1][0] and merkle.proof_digest(proof) == sha(siblings(tree, place))


def test_the_queue_stays_small(monkeypatch):
    """A heap holds at most two messages a level, however many members a block has."""
    most = 0
    push = merkle.heapq.heappush

    def counted(queue, item):
        nonlocal most
        push(queue, item)
        most = max(most, len(queue))

    monkeypatch.setattr(merkle.heapq, "heappush", counted)
    block = merkle.Block(0, 1000, 10)
    log = list(block.forward(sha(str(k)) for k in range(1000)))
    assert len(list(block.backward(log, ""))) == 1000 and most <= 22


@pytest.mark.parametrize("height", [1, 2, 10])
def test_against_lists(spark, height):
    rng = random.Random(height)
    rows = [(k, rng.choice(["a", None, ""]), rng.choice(["en", "en", "en", "fr", "é", None, "", "z\U0001d400"]), rng.choice([None, 0, -5, 10**12]), rng.choice([None, "", "héllo\n", "x" * 1000])) for k in range(60)]
    rows += [(None, None, None, None, None), (None, "b", "en", 1, "t"), (3, "c", "en", 3, "u"), (3, "c", "en", 3, "u"), (99, "only", "alone", 1, "one")]
    got = made(spark, rows, height=height)
    assert plain(got) == plain(by_hand(rows))
    assert all(r["verified"] and r["folded_root"] == r["root"] == merkle.fold(r["leaf"], r["proof"]) for r in got)


def test_several_rounds(spark):
    rows = [(k, "s", "en" if k % 5 else "fr", k, f"text {k}") for k in range(3000)]
    assert plain(made(spark, rows)) == plain(by_hand(rows))
    assert plain(made(spark, rows[:700], height=3)) == plain(by_hand(rows[:700]))


def test_many_trees(spark):
    rows = [(k, "s", f"l{k % 70}", k, None) for k in range(300)]
    assert plain(made(spark, rows, height=2)) == plain(by_hand(rows))


def test_claims_and_other_columns(spark):
    rows = [(k, "s", "en", k if k % 3 else None, "t") for k in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as tree", "2 as place", "3 as digest", "4 as told", "5 as width", "6 as block", "'x' as leaf")
    claim = F.when(df["doc_id"] % 2 == 0, df["n_chars"] + 1).otherwise(df["n_chars"])
    got = {r["doc_id"]: r for r in merkle.manifest(df, claims={"n_chars": claim}).collect()}
    for k, r in got.items():
        assert r["verified"] == (k % 2 == 1 or k % 3 == 0) == (r["folded_root"] == r["root"])
        changed = (k, "s", "en", None if k % 3 == 0 else k + 1 - k % 2, "t")
        assert r["folded_root"] == merkle.fold(leaf(changed), r["proof"])


def test_one_and_none(spark):
    (only,) = made(spark, [(1, None, None, None, None)])
    assert only["leaf"] == only["subroot"] == only["root"] == only["folded_root"] == sha("1:1----") and only["proof_sha256"] == sha("") and only["verified"]
    assert made(spark, []) == []


def test_long_text_and_other_ids(spark):
    text = "é" * 300_000
    df = spark.createDataFrame([("b", text), ("a", None)], "doc_id string, text string")
    got = {r["doc_id"]: r for r in merkle.manifest(df.selectExpr("*", "'l' as lang"), fields=("doc_id", "text")).collect()}
    assert got["b"]["leaf"] == sha("1:b600000:" + text) and got["a"]["subroot"] == sha(got["a"]["leaf"] + got["b"]["leaf"])
