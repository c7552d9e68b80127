"""Large groups of sets that are near, but not linked: what is made of them follows their number, not its square."""

import numpy as np
import pyarrow as pa
from test_llm import frame, linked

from colloquy.llm import jaccard
from colloquy.llm._scratch import Scratch


def near_copies(n):
    """Texts with a long passage in common and ends of their own: their similarity is 0.79."""
    base = [f"w{i}" for i in range(304)]
    texts = [" ".join([*base, *(f"own{k}-{i}" for i in range(40))]) for k in range(n)]
    return texts + [t + " end" for t in texts[5 : n : n // 5]]


def test_near_sets_are_not_paired(spark, monkeypatch):
    made = {}
    save = Scratch.save

    def counted(self, df, name):
        out = save(self, df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    runs = []
    for n in (30, 120):
        texts = near_copies(n)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.linked_components(frame(spark, texts), 5, 80).collect()}
        assert got == linked(texts, 5, 80) and len({c for _, c in got.values()}) == n
        runs.append(dict(made))
        made.clear()
    assert not {k: (runs[0].get(k), v) for k, v in runs[1].items() if v > 8 * max(runs[0].get(k, 0), 120)}


def tile(group, least, component, sets):
    n = len(sets)
    names = ["group", "i", "j", "left", "node", "component", "n", "least", "data"]
    data = [np.array(s, np.uint64).view(np.int64) for s in sets]
    rows = [pa.array([group] * n), *[pa.array([0] * n, pa.int32())] * 3, pa.array(range(n), pa.int64()), pa.array(component, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(least, pa.list_(pa.int64())), pa.array(data, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(rows, names)


def test_pairs_meet_once():
    """A pair is left to a smaller group only if both sets are known to be in it."""
    x = list(range(100))
    apart, shared = [list(range(1, 17)), list(range(101, 117))], [list(range(1, 17)), list(range(16, 32))]
    count = lambda run, batch: sum(b.num_rows for b in run(iter([batch])))
    maps = [jaccard.bitmap_of(np.array(s, np.uint64)) for s in (x, x[1:])]
    sizes = pa.array([100, 99], pa.int64())
    for least, made in ((apart, 1), (shared, 0)):
        assert count(jaccard._links(80), tile(500, least, [1, 2], [x, x[1:]])) == made
        assert count(jaccard._near_rows(80), tile(500, least, [1, 2], maps).set_column(6, "n", sizes)) == 2 * made
    wide = jaccard.bitmap_of(np.array(x, np.uint64), 64)
    mixed = tile(500, apart, [1, 2], [wide, maps[1]]).set_column(6, "n", sizes)
    assert count(jaccard._near_rows(80), mixed) == 2


def test_links_join_as_all_would():
    """Six linked sets of components of their own are joined by five links, over batches that cut the tile."""
    sets = [[*range(100), 1000 + k] for k in range(6)]
    rows = tile(5, [[5] + [9] * 15] * 6, range(6), sets)
    got = [(a, b) for part in jaccard._links(80)(iter([rows.slice(0, 2), rows.slice(2, 3), rows.slice(5)])) for a, b in zip(*(c.to_pylist() for c in part.columns))]
    assert len(got) == 5 and {v for e in got for v in e} == set(range(6))
