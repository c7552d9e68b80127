"""Approximate nearest neighbours by a permutation index.

A vector is represented by its ``near`` closest pivots in order. Each block of vectors posts its members in pivot
inverted files: for each pivot, the members that list it and at which place. A query walks the files of its own pivots,
which gives the footrule distance between its list and every member's, and the members with the least are reranked by
their exact distance. The pivots are a bounded sample; every vector is indexed and every query meets every block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Most different lengths of vectors, for each of which the driver holds pivots; more are an error.
MOST_DIMS = 1000


def lists(vectors: np.ndarray, pivots: np.ndarray, near: int) -> np.ndarray:
    """For each vector, its closest pivots in order; ties to the earlier pivot."""
    d = (pivots**2).sum(1)[None] - 2 * vectors @ pivots.T
    return np.argsort(d, axis=1, kind="stable")[:, :near]


class PivotFiles:
    """Inverted files of one block."""

    def __init__(self, vectors: np.ndarray, pivots: np.ndarray, near: int):
        self.n, self.near = len(vectors), min(near, len(pivots))
        order = lists(vectors, pivots, self.near)
        flat = order.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.member, self.place = by_pivot // self.near, by_pivot % self.near
        self.edges = np.searchsorted(flat[by_pivot], np.arange(len(pivots) + 1))

    def footrule(self, query_list: np.ndarray) -> np.ndarray:
        """Footrule distance to each member; a pivot that a list lacks counts as standing behind its end."""
        m = self.near
        out = np.full(self.n, m * (m + 1), np.int64)
        for q, pivot in enumerate(query_list.tolist()):
            post = slice(self.edges[pivot], self.edges[pivot + 1])
            place = self.place[post]
            out[self.member[post]] += np.abs(place - q) - 2 * m + place + q
        return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, pivots: int = 256, near: int = 64, share: float = 0.25, least: int = 400, block_rows: int = 4096, query_rows: int = 8192, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest found for each query among all rows of ``vectors`` but those with its id.

    Columns: query_id, rank (from 1), vec_id, score (Euclidean distance, double precision). Ties go to the smaller id; all
    candidates come if there are fewer than ``k``. Of each block, the ``share`` of least footrule distance is reranked, at
    least ``least`` vectors. Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
    null ids. Vectors of different length are never compared. Rows with the same vector count as one in the index and are
    told apart afterwards by their k + 1 smallest ids, so a vector that a third of all rows share costs as much as any
    other; a row repeated with its id counts once. A task holds ``block_rows`` vectors and ``query_rows`` queries, about.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType.simpleString()

    def usable(df: DataFrame) -> DataFrame:
        v = F.col("vector")
        finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.select(df[id_col].alias("id"), df[vector_col].cast("array<double>").alias("vector")).where("id is not null and vector is not null").where(finite)

    base = usable(vectors)
    salted = Window.partitionBy("vector", "salt").orderBy("id")
    ranked = base.dropDuplicates(["id", "vector"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1)
    distinct = ranked.withColumn("r", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("r") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    dims = {r["d"]: r["n"] for r in base.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy("d").limit(MOST_DIMS + 1).collect()}
    if len(dims) > MOST_DIMS:
        raise ValueError(f"vectors of more than {MOST_DIMS} different lengths")
    schema = f"query_id {id_type}, vec_id {id_type}, score double"
    if not dims:
        return spark.createDataFrame([], f"query_id {id_type}, rank int, vec_id {id_type}, score double")
    pivot_sets = {d: np.array([r["vector"] for r in base.where(F.size("vector") == d).select("vector", F.xxhash64("vector").alias("h")).distinct().orderBy("h", "vector").limit(pivots).collect()], float) for d in dims}
    blocks = F.create_map(*[F.lit(x) for d, n in dims.items() for x in (d, max(1, -(-n // block_rows)))])
    cells = distinct.withColumn("dim", F.size("vector")).withColumn("block", F.pmod(F.xxhash64("vector"), blocks[F.size("vector")]).cast("int"))
    wanted = usable(queries)
    tiles = max(1, -(-wanted.count() // query_rows))
    if tiles > 1:
        cells = cells.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    else:
        cells = cells.withColumn("tile", F.lit(0))
    asked = wanted.withColumns({"dim": F.size("vector"), "tile": F.pmod(F.xxhash64("id", "vector"), F.lit(tiles)).cast("int")}).where(F.col("dim").isin(list(dims))).withColumn("block", F.explode(F.sequence(F.lit(0), blocks[F.col("dim")] - 1)))

    def search(members: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out_q, out_v, out_s = [], [], []
        if len(members) and len(asks):
            x, q = np.vstack(members["vector"].to_numpy()).astype(float), np.vstack(asks["vector"].to_numpy()).astype(float)
            ids = members["ids"].tolist()
            pivot = pivot_sets[x.shape[1]]
            files = PivotFiles(x, pivot, near)
            c = min(len(x), max(least, int(share * len(x))))
            for query_id, vector, order in zip(asks["id"], q, lists(q, pivot, files.near)):
                rule = files.footrule(order)
                some = np.argpartition(rule, c - 1)[:c] if c < len(x) else np.arange(len(x))
                score = np.sqrt(((x[some] - vector) ** 2).sum(1))
                kth = np.partition(score, k)[k] if len(score) > k else np.inf
                near_by = np.flatnonzero(score <= kth)
                found = sorted((s, v) for i, s in zip(some[near_by].tolist(), score[near_by].tolist()) for v in ids[i] if v != query_id)[:k]
                out_q += [query_id] * len(found)
                out_v += [v for _, v in found]
                out_s += [s for s, _ in found]
        return pd.DataFrame({"query_id": out_q, "vec_id": out_v, "score": np.array(out_s, float)})

    found = cells.groupBy("dim", "block", "tile").cogroup(asked.groupBy("dim", "block", "tile")).applyInPandas(search, schema)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
