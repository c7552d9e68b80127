"""Speaker embeddings: similarity, profiles, matching, clustering."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.arrow import by_key

AUTO, MARGIN, SUGGEST = 0.5, 0.15, 0.35


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a zero vector."""
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-12))


def unit(a: Column) -> Column:
    norm = F.greatest(F.sqrt(dot(a, a)), F.lit(1e-12))
    return F.transform(a, lambda x: x / norm)


def mean_vector(rows: DataFrame, key: str, vector: str, weight: Column | None = None) -> DataFrame:
    """(key, centroid): the weighted mean of each key's vectors as a unit vector. Sums meet by position, so a key with very
    many vectors is added up before it is shuffled."""
    w = F.lit(1.0) if weight is None else weight
    places = rows.select(key, w.alias("w"), F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("m"))
    return places.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("s")).select(key, unit(F.transform("s", lambda x: x["m"])).alias("centroid"))


def match_self(centroids: DataFrame, profile: DataFrame, group: str, speaker: str) -> DataFrame:
    """How each group's best centroid matches the one-row profile: (group, speaker, similarity, decision).

    Auto at AUTO and MARGIN ahead of the next, else Suggest at SUGGEST, else None. Exact ties go to the last speaker.
    """
    sims = centroids.crossJoin(F.broadcast(profile.select(F.col("centroid").alias("__profile")).limit(1))).where(F.size("centroid") == F.size("__profile"))
    sims = sims.withColumn("similarity", cosine(F.col("centroid"), F.col("__profile")))
    order = Window.partitionBy(group).orderBy(F.desc("similarity"), F.desc(speaker))
    best = sims.withColumn("r", F.row_number().over(order)).withColumn("next", F.lead("similarity").over(order)).where("r = 1")
    ahead = F.col("similarity") - F.coalesce("next", F.lit(float("-inf"))) >= MARGIN
    return best.select(group, speaker, "similarity", F.when((F.col("similarity") >= AUTO) & ahead, "Auto").when(F.col("similarity") >= SUGGEST, "Suggest").otherwise("None").alias("decision"))


#: A group's distances are held at once: 200 MB at this number of vectors.
MOST_VECTORS = 5000


def linkage(distances: np.ndarray) -> list[tuple[float, int, int]]:
    """(height, a, b) of all average-linkage merges of a square matrix, which is used up.

    Nearest-neighbour chains: from any cluster to its nearest one, on until two are each other's nearest, which merge. Each
    step reads a row, and there are about three for each vector, so the time is quadratic.
    """
    d = distances
    np.fill_diagonal(d, np.inf)
    size, merges, chain, free = np.ones(len(d)), [], [], 0
    while len(merges) < len(d) - 1:
        if not chain:
            while size[free] == 0:
                free += 1
            chain.append(free)
        row = d[chain[-1]]
        nearest = int(row.argmin())
        if len(chain) > 1 and row[chain[-2]] <= row[nearest]:
            x, y = sorted((chain.pop(), chain.pop()))
            merges.append((float(row[nearest]), x, y))
            d[x] = (size[x] * d[x] + size[y] * d[y]) / (size[x] + size[y])
            d[x, x], d[x, y] = np.inf, np.inf
            d[:, x] = d[x]
            d[y], d[:, y] = np.inf, np.inf
            size[x], size[y] = size[x] + size[y], 0
        else:
            chain.append(nearest)
    return merges


def linkage_of_sums(units: np.ndarray) -> list[tuple[float, int, int]]:
    """``linkage`` of unit vectors' cosine distances, without a matrix: two clusters' mean distance is one less the product of
    their mean vectors, so a row is worked out from the clusters' sums when it is read. Memory follows the vectors.

    A row's rounding isn't the same from both sides, so what is no further by more than 1e-12 counts as the nearest.
    """
    sums, size, merges, chain, free = units.copy(), np.ones(len(units)), [], [], 0
    while len(merges) < len(units) - 1:
        if not chain:
            while size[free] == 0:
                free += 1
            chain.append(free)
        at = chain[-1]
        row = np.where(size > 0, np.maximum(0, 1 - sums @ (sums[at] / size[at]) / np.maximum(size, 1)), np.inf)
        row[at] = np.inf
        nearest = int(row.argmin())
        if len(chain) > 1 and row[chain[-2]] <= row[nearest] + 1e-12:
            x, y = sorted((chain.pop(), chain.pop()))
            merges.append((float(row[x if at == y else y]), x, y))
            sums[x], size[x], size[y] = sums[x] + sums[y], size[x] + size[y], 0
        else:
            chain.append(nearest)
    return merges


def average_linkage(vectors: np.ndarray, threshold: float = 0.6, clusters: int | None = None) -> np.ndarray:
    """Labels by first appearance: the two closest clusters merge until they are further than the threshold apart, or until
    ``clusters`` are left. More than ``MOST_VECTORS`` vectors are an error."""
    n = len(vectors)
    if n > MOST_VECTORS:
        raise ValueError(f"{n} vectors of one group; at most {MOST_VECTORS} can be clustered")
    if not n:
        return np.zeros(0, int)
    u = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return merged(linkage(np.maximum(0, 1 - u @ u.T)), n, threshold, clusters)


def merged(merges: list[tuple[float, int, int]], n: int, threshold: float, clusters: int | None = None) -> np.ndarray:
    """The labels of ``average_linkage`` from all merges of n vectors."""
    merges = sorted(merges, key=lambda m: m[0])
    apply = sum(h <= threshold for h, _, _ in merges) if clusters is None else n - max(1, clusters)
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for _, a, b in merges[: max(0, apply)]:
        parent[top(b)] = top(a)
    names: dict[int, int] = {}
    return np.array([names.setdefault(top(x), len(names)) for x in range(n)])


def cluster(rows: DataFrame, group: str, item: str, vector: str, threshold: float = 0.6) -> DataFrame:
    """(group, item, label) by average linkage in each group: one recording's embeddings, ``MOST_VECTORS`` at most."""

    def run(found):
        found.sort(key=lambda x: (x[item] is None, x[item]))
        return list(zip((x[item] for x in found), average_linkage(np.array([x[vector] for x in found], float), threshold).tolist()))

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return by_key(rows, [group], [item, vector], run, f"{item} {kinds[item]}, label bigint")


def voices(vectors: np.ndarray, mass: np.ndarray, threshold: float, min_size: int, min_share: float) -> list[tuple[int, list[float]]]:
    """(label, centroid) of one group's vectors: ``cluster``, ``fold_small`` and ``mean_vector`` of units for vectors that are
    held at once anyway. Any number of vectors: beyond ``MOST_VECTORS`` their distances are not."""
    u = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    label = average_linkage(vectors, threshold) if len(u) <= MOST_VECTORS else merged(linkage_of_sums(u), len(u), threshold)

    def means():
        names = np.unique(label)
        m = np.stack([u[label == k].mean(0) for k in names])
        return names, m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

    names, cents = means()
    share = np.bincount(label, mass)
    small = (np.bincount(label) < min_size) | (share < min_share * share.sum())
    if small.any() and not small.all():
        large = ~small[names]
        sims = u @ cents[large].T
        # ties go to the larger label
        nearest = names[large][len(names[large]) - 1 - sims[:, ::-1].argmax(1)]
        label = np.where(small[label], nearest, label)
        names, cents = means()
    return list(zip(names.tolist(), cents.tolist()))


def fold_small(rows: DataFrame, group: str, item: str, vector: str, label: str, mass: str, min_size: int, min_share: float = 0.02) -> DataFrame:
    """Members of clusters that are small, in number or in mass, move to the most similar large cluster, whose centroid
    stays what it was before; groups without a large cluster stay as they are."""
    both = F.struct(group, label)
    sizes = rows.groupBy(group, label).agg(F.count("*").alias("n"), F.sum(mass).alias("m")).withColumn("all", F.sum("m").over(Window.partitionBy(group)))
    sizes = sizes.withColumn("small", (F.col("n") < min_size) | (F.col("m") < min_share * F.col("all")))
    units = rows.withColumn("__u", unit(F.col(vector))).withColumn("__k", both)
    cents = mean_vector(units, "__k", "__u").select(f"__k.{group}", F.col(f"__k.{label}").alias("__to"), "centroid")
    large = sizes.where(~F.col("small")).select(group, F.col(label).alias("__to")).join(cents, [group, "__to"])
    marked = rows.join(sizes.select(group, label, "small"), [group, label])
    moved = marked.where("small").join(large, group).groupBy(group, item).agg(F.max_by("__to", F.struct(cosine(F.col(vector), F.col("centroid")), "__to")).alias("__new"))
    return marked.join(moved, [group, item], "left").select(group, item, F.coalesce("__new", label).alias(label))


def best_mapping(sims: np.ndarray) -> list[int]:
    """For each row another column, so that the sum is largest; each row its best one if there are too few columns.

    Rows are placed one after the other along a cheapest augmenting path over potentials, in rows**2 * columns steps.
    """
    n, k = sims.shape
    if k < n:
        return [int(c) for c in sims.argmax(1)]
    cost = sims.max(initial=0.0) - sims
    of_row, of_column = np.zeros(n), np.zeros(k)
    owner = np.full(k, -1)
    for row in range(n):
        reach, came, done = np.full(k, np.inf), np.full(k, -1), np.zeros(k, bool)
        at, last = row, -1
        while True:
            slack = cost[at] - of_row[at] - of_column + (0.0 if last < 0 else reach[last])
            closer = ~done & (slack < reach - 1e-15)
            reach[closer], came[closer] = slack[closer], last
            nearest = int(np.where(done, np.inf, reach).argmin())
            done[nearest] = True
            last = nearest
            if owner[nearest] < 0:
                break
            at = owner[nearest]
        length = reach[last]
        inner = done & (reach < length)
        of_row[row] += length
        of_row[owner[inner]] += length - reach[inner]
        of_column[inner] -= length - reach[inner]
        while last >= 0:
            before = int(came[last])
            owner[last] = row if before < 0 else owner[before]
            last = before
    place = {int(r): c for c, r in enumerate(owner) if r >= 0}
    return [place[r] for r in range(n)]


#: Centroids that may go to every task; 8 MB at 256 numbers each.
MOST_CENTROIDS = 4096


def few_centroids(centroids: DataFrame, order: str) -> list[list[float]]:
    """The centroids by ``order``, for ``assign_windows``. More than ``MOST_CENTROIDS`` are an error: ``map_windows`` joins
    any number of them instead."""
    rows = centroids.orderBy(order).limit(MOST_CENTROIDS + 1).collect()
    if len(rows) > MOST_CENTROIDS:
        raise ValueError(f"more than {MOST_CENTROIDS} centroids; map_windows joins them")
    return [r["centroid"] for r in rows]


def assign_windows(rows: DataFrame, window: str, local: str, vector: str, centroids: list[list[float]]) -> DataFrame:
    """Maps each window's local speakers (three at most) one to one to the global centroids, any number of them.

    With n local speakers, a best mapping gives each one of its n best centroids, as the others hold n - 1 at most.
    """
    cents = np.array(centroids, float)
    cents /= np.maximum(np.linalg.norm(cents, axis=1, keepdims=True), 1e-12)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(local)
        x = np.vstack(pdf[vector].to_numpy()).astype(float)
        sims = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) @ cents.T
        some = np.unique(np.argsort(-sims, axis=1, kind="stable")[:, : len(sims)])
        return pd.DataFrame({window: pdf[window], local: pdf[local], "speaker": some[best_mapping(sims[:, some])]})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select(window, local, vector).groupBy(window).applyInPandas(run, f"{window} {kinds[window]}, {local} {kinds[local]}, speaker bigint")


def map_windows(rows: DataFrame, centroids: DataFrame, group: str, window: str, local: str, vector: str) -> DataFrame:
    """(group, window, local, speaker): the local speakers of each window mapped one to one to their group's centroids
    (group, speaker, centroid), so that the similarity in all is largest; each to its best where there are too few.

    A window's locals are joined with their group's centroids as similarities, and only each local's best ones come
    together: as many as the window has locals, more can't be needed.
    """
    keys = [group, window]
    here = Window.partitionBy(*keys, local).orderBy(F.desc("sim"), "speaker")
    sims = rows.select(*keys, local, vector).join(centroids, group).select(*keys, local, "speaker", cosine(F.col(vector), F.col("centroid")).alias("sim"))
    best = sims.withColumn("__r", F.row_number().over(here)).join(rows.groupBy(*keys).agg(F.count("*").alias("__n")).hint("merge"), keys).where("__r <= __n")

    def run(found):
        sims: dict = {}
        for x in found:
            sims.setdefault(x[local], {})[x["speaker"]] = -1e6 if x["sim"] is None or np.isnan(x["sim"]) else x["sim"]
        locals_, names = sorted(sims), sorted({n for own in sims.values() for n in own})
        if len(names) < len(locals_):
            return [(k, max(sorted(sims[k]), key=sims[k].get)) for k in locals_]
        if len(locals_) <= 3:
            ways = (w for w in itertools.product(*(sorted(sims[k].items(), key=lambda x: (-x[1], x[0])) for k in locals_)) if len({n for n, _ in w}) == len(w))
            return list(zip(locals_, (n for n, _ in max(ways, key=lambda w: sum(x for _, x in w)))))
        grid = np.array([[sims[k].get(n, -1e6) for n in names] for k in locals_])
        return list(zip(locals_, (names[c] for c in best_mapping(grid))))

    kinds = {f.name: f.dataType.simpleString() for f in best.schema}
    return by_key(best, keys, [local, "speaker", "sim"], run, f"{local} {kinds[local]}, speaker {kinds['speaker']}")
