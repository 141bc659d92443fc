"""Hard-negative mining by BOND vertical scans over blocks of vectors.

Vectors are rounded to integers, so all scores are exact. Rows are dealt into blocks of bounded size; a block keeps its
vectors by dimension, sorted by label. Anchors are sent to every block and scan it one after the other: the dimensions are
read in the anchor's own descending order of magnitude, and after every few of them the least and the most that the
dimensions left can add, by the block's minimum and maximum in each, shrink the bitmap of candidates.

1. Positives: candidates share the anchor's label; those go whose best score is below the k-th worst score of the others.
2. Each positive opens a window of scores. Candidates of other labels go when they can't reach any window, or when enough
   others lie in it for certain above them. What is left has been read to the last dimension, so its score is exact.

The best of all blocks are put in order by Spark. Rows are shuffled once a pass; anchors are copied once a block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattspan.llm.common import materialise

#: Bytes of a block's vectors in memory; the rows below which no block is cut to keep more tasks busy.
BLOCK_BYTES, LEAST_ROWS = 64 << 20, 1024
#: Dimensions that are read between two looks at the bitmap.
STEP = 8
#: Longer rounded vectors take no part: scores and bounds of all others are exact in 64 bits.
LONGEST = 2.0**28
#: Below this product of norms doubles are exact.
EXACT = 2.0**50

POSITIVES = "anchor_id long, row_key long, positive_id long, positive_score long"
NEGATIVES = "anchor_id long, row_key long, place int, positive_id long, positive_score long, negative_id long, negative_score long"


def rounded(vector: Column, scale: int = 256) -> Column:
    """The vector's components, times ``scale``, as integers (floors)."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column, scale: int = 256) -> Column:
    """True where the vector is not null, has finite components only, and is not too long to be rounded exactly."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    squares = F.aggregate(vector, F.lit(0.0), lambda s, x: s + F.pow(F.floor(x.cast("double") * scale).cast("double"), 2))
    return F.coalesce(finite & (squares <= LONGEST**2), F.lit(False))


class VerticalBlock:
    """Integer vectors of one length by dimension, sorted by label, and each dimension's bounds."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((ids, labels))
        self.ids, self.labels = ids[order], labels[order]
        columns = vectors[order].T
        self.low, self.high = columns.min(axis=1), columns.max(axis=1)
        #: An upper bound of what any partial sum can reach, over the norm of the one who asks.
        self.norm = float(np.sqrt((np.maximum(np.abs(self.low), np.abs(self.high)).astype(float) ** 2).sum()))
        self.columns = np.ascontiguousarray(columns, float if self.norm < EXACT / LONGEST else np.int64)

    def of_label(self, label: int) -> tuple[int, int]:
        a, b = np.searchsorted(self.labels, [label, label + 1])
        return int(a), int(b)

    def scan(self, anchor: np.ndarray, rows: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
        """The rows that ``keep`` leaves to the last dimension, and their exact scores.

        keep(partial scores, least rest, most rest) says which rows can still matter.
        """
        order = np.argsort(-np.abs(anchor), kind="stable")
        a = anchor[order].astype(self.columns.dtype)
        ends = np.sort(np.stack([self.low[order] * anchor[order], self.high[order] * anchor[order]]), axis=0)
        # bounds of what dimensions from the i-th on add
        rest = np.concatenate([ends[:, ::-1].cumsum(axis=1)[:, ::-1], np.zeros((2, 1), ends.dtype)], axis=1)
        sums = np.zeros(len(rows), self.columns.dtype)
        for i in range(0, len(order), STEP):
            read = self.columns[order[i : i + STEP]]
            sums += a[i : i + STEP] @ (read if len(rows) == read.shape[1] else read[:, rows])
            end = min(i + STEP, len(order))
            alive = keep(sums, rest[0, end], rest[1, end])
            if not alive.all():
                rows, sums = rows[alive], sums[alive]
            if not len(rows):
                break
        return rows, sums.astype(np.int64)

    def _best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(rows) > k:
            near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            rows, scores = rows[near], scores[near]
        order = np.lexsort((self.ids[rows], -scores))[:k]
        return rows[order], scores[order]

    def positives(self, own_id: int, label: int, anchor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the k best other ids of one label, best first, and their scores."""
        a, b = self.of_label(label)
        rows = a + np.flatnonzero(self.ids[a:b] != own_id)

        def keep(sums, least, most):
            if len(sums) <= k:
                return np.ones(len(sums), bool)
            kth = np.partition(sums, len(sums) - k)[len(sums) - k]
            return sums + most >= kth + least

        return self._best(*self.scan(anchor, rows, keep), k)

    def negatives(self, label: int, anchor: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (lowest, highest score) the rows of its k best of other labels, best first, and their scores."""
        open_ = sorted({w for w in windows if w[0] <= w[1]})
        none = np.empty(0, np.int64)
        if not open_:
            return [(none, none) for _ in windows]
        bottom, top = min(w[0] for w in open_), max(w[1] for w in open_)
        a, b = self.of_label(label)
        rows = np.concatenate([np.arange(a), np.arange(b, len(self.ids))])

        def keep(sums, least, most):
            low, high = sums + least, sums + most
            alive = (high >= bottom) & (low <= top)
            if most - least > top - bottom:
                return alive
            wanted = np.zeros(len(sums), bool)
            for lo, hi in open_:
                sure = low[(low >= lo) & (high <= hi)]
                floor = np.partition(sure, len(sure) - k)[len(sure) - k] if len(sure) >= k else lo
                wanted |= (high >= floor) & (high >= lo) & (low <= hi)
            return alive & wanted

        rows, scores = self.scan(anchor, rows, keep)
        found = {}
        for lo, hi in open_:
            inside = (scores >= lo) & (scores <= hi)
            found[lo, hi] = self._best(rows[inside], scores[inside], k)
        return [found.get(w, (none, none)) for w in windows]


def _runs(batches: Iterable) -> Iterator[tuple[int, int, object]]:
    """(block, kind, slice) for each stretch of one block's rows or anchors; batches are sorted by both."""
    for batch in batches:
        key = batch.column("block").to_numpy() * 2 + batch.column("kind").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)] if len(key) else [0]
        for i, j in zip(edges, edges[1:]):
            yield int(key[i]) // 2, int(key[i]) % 2, batch.slice(i, j - i)


def _vectors(part) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: positions of the rows and their vectors as one matrix."""
    import pyarrow.compute as pc

    lengths = pc.list_value_length(part.column("q")).to_numpy()
    out = {}
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        flat = part.column("q").take(at).flatten().to_numpy()
        out[n] = at, flat.reshape(len(at), n).astype(np.int64, copy=False)
    return out


def _scanned(batches: Iterator, ask) -> Iterator[list[tuple]]:
    """Rows of a block build it up, anchors behind them scan it; ask(block, row of the anchor, vector) gives rows of the result."""
    block, rows, built = -1, [], {}
    for at, kind, part in _runs(batches):
        if at != block:
            block, rows, built = at, [], {}
        ids, labels = (part.column(c).to_numpy() for c in ("vec_id", "label"))
        if kind == 0:
            rows += [(n, ids[own], labels[own], v) for n, (own, v) in _vectors(part).items()]
            continue
        for n in {r[0] for r in rows}:
            of = [r[1:] for r in rows if r[0] == n]
            built[n] = VerticalBlock(*(np.concatenate(x) for x in zip(*of, strict=True)))
        rows = []
        extra = {c: part.column(c).to_pylist() for c in part.schema.names if c in ("row_key", "found")}
        for n, (own, v) in _vectors(part).items():
            if n in built:
                for i, vector in zip(own.tolist(), v, strict=True):
                    yield ask(built[n], (int(ids[i]), extra["row_key"][i], int(labels[i]), (extra.get("found") or {i: None})[i]), vector)


def _table(lines: Iterable[list[tuple]], schema: str) -> Iterator:
    import pyarrow as pa

    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int32() if c.endswith(" int") else pa.int64() for c in schema.split(", ")]
    held: list[tuple] = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    for more in lines:
        held += more
        if len(held) >= 10_000:
            yield batch()
            held = []
    if held:
        yield batch()


def _find_positives(k: int):
    def run(batches: Iterator) -> Iterator:
        def ask(block, anchor, vector):
            rows, scores = block.positives(anchor[0], anchor[2], vector, k)
            return [(anchor[0], anchor[1], i, s) for i, s in zip(block.ids[rows].tolist(), scores.tolist())]

        yield from _table(_scanned(batches, ask), POSITIVES)

    return run


def _find_negatives(k: int, low: int, high: int):
    def run(batches: Iterator) -> Iterator:
        def ask(block, anchor, vector):
            windows = [(-(-low * p["score"] // 100), high * p["score"] // 100) for p in anchor[3]]
            found = block.negatives(anchor[2], vector, windows, k)
            return [(anchor[0], anchor[1], j, p["id"], p["score"], i, s) for j, (p, (rows, scores)) in enumerate(zip(anchor[3], found, strict=True)) for i, s in zip(block.ids[rows].tolist(), scores.tolist())]

        yield from _table(_scanned(batches, ask), NEGATIVES)

    return run


def _blocks(rows: DataFrame) -> int:
    """Blocks of at most about BLOCK_BYTES, and as many as keep the tasks busy where there are rows enough."""
    n, longest = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("q")), F.lit(1))).first()
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(-(-n * max(longest, 1) * 8 // BLOCK_BYTES), min(tasks, n // LEAST_ROWS), 1)


def _met(rows: DataFrame, anchors: DataFrame, blocks: int) -> DataFrame:
    """Each block's rows, and behind them all anchors, in one stream a task."""
    here = rows.withColumns({"block": F.pmod(F.xxhash64("vec_id", "label", "q"), F.lit(blocks)).cast("int"), "kind": F.lit(0)})
    asking = anchors.withColumns({"block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "kind": F.lit(1)})
    both = here.unionByName(asking, allowMissingColumns=True)
    return both.repartition(blocks, "block").sortWithinPartitions("block", "kind")


def mine_hard_negatives(
    vectors: DataFrame, anchors: Column, label: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    ``anchors`` says which rows ask, ``label`` is an integer of each row. Components become floor(scale * x); a score is the
    integer inner product with the anchor, higher first, ties to smaller ids. An anchor's positives are its first rows of
    the same label and another id; for each of them come the first rows of other labels whose score lies between ``low`` and
    ``high`` hundredths of the positive's. A positive below zero has no such range and gives no row, nor does an anchor without
    positives, or an empty table.

    Rows with a null id, label or vector, or a null or non-finite component, take no part, nor do vectors whose rounded
    length is above 2**28 (components near a million): their scores leave the exact range. Vectors of different lengths never
    meet; empty vectors score zero with each other. Rows equal in id, label and rounded vector count once; rows that repeat
    only the id are rows of their own, each with its own result. Other columns are not read.
    """
    v = F.col(vector_col)
    rows = vectors.filter(usable(v, scale)).select(
        F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), rounded(v, scale).alias("q"), F.coalesce(anchors, F.lit(False)).alias("asks")
    )
    rows = materialise(rows.filter("vec_id is not null and label is not null").groupBy("vec_id", "label", "q").agg(F.bool_or("asks").alias("asks")), "rounded")
    blocks = _blocks(rows)
    held = rows.select("vec_id", "label", "q")
    asking = rows.filter("asks").select("vec_id", "label", "q", F.xxhash64("label", "q").alias("row_key"))
    best = Window.partitionBy("anchor_id", "row_key").orderBy(F.desc("positive_score"), "positive_id")
    found = _met(held, asking, blocks).mapInArrow(_find_positives(positives), POSITIVES)
    found = found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives)
    lists = found.groupBy("anchor_id", "row_key").agg(F.sort_array(F.collect_list(F.struct("place", F.col("positive_id").alias("id"), F.col("positive_score").alias("score")))).alias("found"))
    lists = lists.select(F.col("anchor_id").alias("vec_id"), "row_key", F.transform("found", lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"))).alias("found"))
    asking = materialise(asking.join(lists, ["vec_id", "row_key"]), "anchors")
    out = _met(held, asking, blocks).mapInArrow(_find_negatives(negatives, low, high), NEGATIVES)
    best = Window.partitionBy("anchor_id", "row_key", "place").orderBy(F.desc("negative_score"), "negative_id")
    out = out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
