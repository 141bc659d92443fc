"""Approximate nearest neighbours by collision-counting hashing.

Largest inner product becomes smallest distance by one more coordinate, which lifts every vector to the largest norm.
A block of vectors keeps, for each random projection, its projected values in sorted order. A query opens a window around
its own projected value in each of these arrays and widens all windows by virtual rehashing, radius by radius; a vector
that lies in enough windows has collided often enough and is verified by its inner product in double precision.

A stated set of queries meets all vectors, in blocks of both; each pair of blocks is one group of bounded size. Of each
block a query takes its k best, and the best of these are the answer.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, QUERY_BLOCK = 20_000, 2_000
PROJECTIONS, WIDTH, RATIO = 64, 0.6, 1.12
#: Share of the windows in which a vector must lie, and rows of a block, as a share and besides,
#: that are verified before the search may stop.
THRESHOLD, VERIFY, SPARE = 0.55, 0.25, 500
RESULT = "query_id long, vec_id long, score double"


class CollisionIndex:
    """Sorted projections of one block of lifted vectors."""

    def __init__(self, vectors: np.ndarray, norm: float, seed: int = 20240607):
        self.vectors = vectors
        unit = vectors / norm
        lifted = np.column_stack([unit, np.sqrt(np.maximum(0.0, 1 - (unit * unit).sum(axis=1)))])
        self.directions = np.random.default_rng(seed).standard_normal((lifted.shape[1], PROJECTIONS))
        values = lifted @ self.directions
        self.order = np.argsort(values, axis=0, kind="stable").T.astype(np.int32)
        self.sorted = np.sort(values, axis=0).T.copy()

    def search(self, queries: np.ndarray, k: int):
        """For each query the rows that were verified and their inner products; at least k rows if the block has them."""
        n = len(self.vectors)
        unit = queries / np.linalg.norm(queries, axis=1)[:, None]
        at = np.column_stack([unit, np.zeros(len(unit))]) @ self.directions
        need, enough = int(np.ceil(THRESHOLD * PROJECTIONS)), min(n, k + SPARE + int(VERIFY * n))
        counts = np.zeros((len(queries), n), np.uint8)
        low = high = np.column_stack([np.searchsorted(s, a) for s, a in zip(self.sorted, at.T, strict=True)])
        open_, half = np.arange(len(queries)), WIDTH
        while len(open_):
            # one step of virtual rehashing: all windows of the queries that go on become wider
            a, b = (np.column_stack([np.searchsorted(s, x) for s, x in zip(self.sorted, (at[open_] + sign * half).T, strict=True)]) for sign in (-1, 1))
            a, b = np.minimum(a, low), np.maximum(b, high)
            on = []
            for i, q in enumerate(open_.tolist()):
                new = [part for order, *cut in zip(self.order, a[i].tolist(), low[i].tolist(), high[i].tolist(), b[i].tolist()) for part in (order[cut[0] : cut[1]], order[cut[2] : cut[3]])]
                counts[q] += np.bincount(np.concatenate(new), minlength=n).astype(np.uint8)
                rows = np.flatnonzero(counts[q] >= need)
                if len(rows) >= enough:
                    yield q, rows, (self.vectors[rows] * queries[q]).sum(axis=1)
                else:
                    on.append(i)
            open_, low, high, half = open_[on], a[on], b[on], half * RATIO


def _search_blocks(k: int):
    def run(left, right):
        import pyarrow as pa

        def matrix(table):
            return np.asarray(table.column("v").combine_chunks().flatten(), float).reshape(table.num_rows, -1)

        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            ids = left.column("vec_id").to_numpy()
            index = CollisionIndex(matrix(left), float(left.column("norm")[0].as_py()))
            asking, queries = right.column("vec_id").to_numpy(), matrix(right)
            # the counts of a step's queries stay below 50 MB
            step = max(1, 50_000_000 // left.num_rows)
            found = ((asking[i + q], *x) for i in range(0, len(asking), step) for q, *x in index.search(queries[i : i + step], k + 1))
            for qid, rows, score in found:
                own = ids[rows] != qid
                rows, score = rows[own], score[own]
                best = np.lexsort((ids[rows], -score))[:k]
                for column, values in zip(out, (np.full(len(best), qid), ids[rows[best]], score[best]), strict=True):
                    column.append(values)
        cat = [np.concatenate(c) if c else np.empty(0) for c in out]
        return pa.table({"query_id": pa.array(cat[0].astype(np.int64)), "vec_id": pa.array(cat[1].astype(np.int64)), "score": pa.array(cat[2].astype(float))})

    return run


def nearest_neighbours(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each query row its k nearest other rows by inner product, ties to smaller ids.

    ``queries`` says which rows of ``vectors`` ask. Vectors that are null, zero, or hold a null or non-finite component take
    no part, nor do rows with a null id; vectors of different lengths never meet. Rows that repeat an id are never
    neighbours of that id. Queries without candidates and empty tables give no rows; other columns are not read.
    """
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), queries.alias("asks")).filter("vec_id is not null and size(v) > 0")
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    rows = rows.withColumns({"norm": F.sqrt(squares), "dim": F.size("v")}).filter("norm > 0")
    sizes = {r.dim: r for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q"), F.max("norm").alias("norm")).collect()}
    out = None
    for dim, r in sorted(sizes.items()):
        blocks, asking = -(-r.n // BLOCK), max(1, -(-r.q // QUERY_BLOCK))
        own = rows.filter(F.col("dim") == dim)
        block, q_block = (F.pmod(F.xxhash64("vec_id"), F.lit(x)).cast("int") for x in (blocks, asking))
        data = own.select("vec_id", "v", F.lit(r.norm).alias("norm"), block.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(asking - 1))).alias("q"))
        asked = own.filter("asks").select("vec_id", "v", q_block.alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
        found = data.groupBy("b", "q").cogroup(asked.groupBy("b", "q")).applyInArrow(_search_blocks(k), RESULT)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], RESULT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
