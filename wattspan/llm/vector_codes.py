"""Vector codes by member-resident Lloyd: one codebook for each part of the vector, learned on all rows.

The parts of all rows are members. A member lives with the owner of its (position, entry, salt): members are a table that
is bucketed by these three, so an owner sums its residents without a shuffle. After each round only the members whose
nearest entry has changed migrate, into a table bucketed the same way; they are taken from the sums of the old owner and
added to those of the new one. A member that stays is never moved again. All sums are integers, so the codebooks don't
depend on the order in which rows are met.

Equal parts of a batch are one member with a count, and the salt is a hash of the part, so neither equal vectors nor an
entry that holds most rows makes an owner large. Codebooks have a fixed size (entries times dimensions) and go through
the driver; members never do. With the last codebooks each vector is encoded where it is read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattspan.llm.common import join_by_key, materialise
from wattspan.llm.hard_negatives import rounded, usable
from wattspan.llm.segments import mix

#: Members that a bucket is meant to hold, the least salts an entry has, and the most buckets of a table.
MEMBERS, SALTS, MOST_BUCKETS = 1_000_000, 8, 50_000
OWNER = ("position", "entry", "salt")
MEMBER = "position int, entry int, salt int, part array<long>, n long"
MOVE = "position int, entry int, salt int, part array<long>, n long, left int"
ENCODED = "vec_id long, label string, code string, error long"


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the nearest entry (ties: the lower index) and its squared distance, both exact."""
    largest = max(np.abs(parts).max(initial=0), np.abs(book).max(initial=0))
    kind = float if float(largest) ** 2 * 4 * parts.shape[1] < 2.0**53 else np.int64
    x, c = parts.astype(kind), book.astype(kind)
    distance = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
    entry = distance.argmin(axis=1)
    return entry, distance[np.arange(len(x)), entry].astype(np.int64)


def _salt(parts: np.ndarray, salts: int) -> np.ndarray:
    state = np.zeros(len(parts), np.uint64)
    for column in parts.T:
        state = mix(state + column.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return (state % np.uint64(salts)).astype(np.int32)


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _lists(matrix: np.ndarray):
    import pyarrow as pa

    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).ravel()))


def _settle(books: np.ndarray, salts: int):
    """Vectors to members: the distinct parts of a batch with their counts, each with its nearest entry."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        width = books.shape[2]
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column("q"))
            for p, book in enumerate(books):
                parts, counts = np.unique(vectors[:, p * width : (p + 1) * width], axis=0, return_counts=True)
                entry, _ = nearest(parts, book)
                columns = [np.full(len(parts), p, np.int32), entry.astype(np.int32), _salt(parts, salts)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), _lists(parts), pa.array(counts.astype(np.int64))], ["position", "entry", "salt", "part", "n"])

    return run


def _movers(history: list[np.ndarray]):
    """Residents that stayed under all codebooks of ``history`` but the last, and leave under that one."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            position, entry = (batch.column(c).to_numpy() for c in ("position", "entry"))
            parts, goes, to = _matrix(batch.column("part")), np.zeros(len(position), bool), np.zeros(len(position), np.int32)
            for p in np.unique(position).tolist():
                own = np.flatnonzero(position == p)
                for books in history[:-1]:
                    own = own[nearest(parts[own], books[p])[0] == entry[own]]
                to[own] = nearest(parts[own], history[-1][p])[0]
                goes[own] = to[own] != entry[own]
            gone = batch.filter(pa.array(goes))
            if gone.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [gone.column("position"), pa.array(to[goes]), *(gone.column(c) for c in ("salt", "part", "n")), gone.column("entry")], ["position", "entry", "salt", "part", "n", "left"]
                )

    return run


def _encode(books: np.ndarray):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        width = books.shape[2]
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column("q"))
            found = [nearest(vectors[:, p * width : (p + 1) * width], book) for p, book in enumerate(books)]
            codes = np.stack([e for e, _ in found], axis=1).astype(np.uint8)
            error = np.sum([d for _, d in found], axis=0).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


class _Owners:
    """The bucketed tables of members: the first holds all, each later one those that moved in a round."""

    def __init__(self, spark: SparkSession, rows: int, parts: int):
        self.spark, self.salts = spark, max(SALTS, -(-rows // MEMBERS))
        busy = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.buckets = min(MOST_BUCKETS, max(busy, -(-rows * parts // MEMBERS)))
        self.name, self.tables = f"members_{uuid.uuid4().hex}", []

    def move_in(self, members: DataFrame) -> None:
        name = f"{self.name}_{len(self.tables)}"
        self.tables.append(name)
        members.repartition(self.buckets, *OWNER).write.bucketBy(self.buckets, *OWNER).format("parquet").saveAsTable(name)

    def drop(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _add(sums: np.ndarray, counts: np.ndarray, members: DataFrame, entry: str, sign: int) -> None:
    """Add the members' sums and counts to those of (position, entry). Owners sum first; their sums, a bounded number, meet afterwards."""
    width = sums.shape[2]
    by_owner = members.groupBy("position", entry, "salt").agg(F.sum("n").alias("n"), *(F.sum(F.col("part")[i] * F.col("n")).alias(f"s{i}") for i in range(width)))
    totals = by_owner.groupBy("position", entry).agg(F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(width)))
    for r in totals.collect():
        counts[r.position, r[entry]] += sign * r.n
        sums[r.position, r[entry]] += sign * np.array(r[3:], np.int64)


def learn_codebooks(kept: DataFrame, parts: int, entries: int, rounds: int) -> np.ndarray:
    """Codebooks (position, entry, component) after ``rounds`` rounds; kept: vec_id, q of one length."""
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "q").select("q").limit(entries).collect()
    start = np.array([r.q for r in first], np.int64)
    books = np.ascontiguousarray(start.reshape(len(start), parts, -1).transpose(1, 0, 2))
    owners = _Owners(kept.sparkSession, kept.count(), parts)
    sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
    history = [books]
    try:
        for n in range(rounds):
            if n == 0:
                owners.move_in(kept.select("q").mapInArrow(_settle(books, owners.salts), MEMBER))
                _add(sums, counts, owners.spark.table(owners.tables[0]), "entry", 1)
            else:
                moves = None
                for since, name in enumerate(owners.tables):
                    some = owners.spark.table(name).select("position", "entry", "salt", "part", "n").mapInArrow(_movers(history[since + 1 :]), MOVE)
                    moves = some if moves is None else moves.unionByName(some)
                owners.move_in(moves)
                moved = owners.spark.table(owners.tables[-1])
                _add(sums, counts, moved, "entry", 1)
                _add(sums, counts, moved, "left", -1)
            used = counts > 0
            books = np.where(used[:, :, None], sums // np.maximum(counts, 1)[:, :, None], books)
            history.append(books)
    finally:
        owners.drop()
    return books


def compress_vectors(
    vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """One row a vector: vec_id, code (two hex digits a part), error, label_error (its label's errors, nulls together), codebooks_sha256.

    Components become floor(scale * x). Each part's codebook starts as that part of the vectors of the smallest ids; a round
    assigns every part to its nearest entry (squared distance, ties to the lower index) and replaces each used entry by the
    floors of its parts' means; the codes are the nearest entries in the end. ``entries`` is at most 256.

    Vectors that are null, or hold a null or non-finite component, take no part, nor do those whose rounded length is above
    2**28 (components near a million) or whose number of components is not that of the smallest id with a positive multiple of
    ``parts``. Rows with a null id are encoded and come last in the order of ids; rows that repeat an id are rows of their own,
    in the order of their vectors. With fewer rows than ``entries`` the codebooks are as small. An empty table gives no rows;
    other columns are not read. Members are kept as bucketed tables in the warehouse and dropped once the codebooks are there.
    """
    if entries > 256 or rounds < 0:
        raise ValueError("at most 256 entries and no negative number of rounds")
    v = F.col(vector_col)
    rows = vectors.filter(usable(v, scale)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), rounded(v, scale).alias("q"))
    kept = materialise(rows.filter((F.size("q") > 0) & (F.size("q") % parts == 0)), "kept")
    smallest = kept.orderBy(F.asc_nulls_last("vec_id"), "q").select(F.size("q")).limit(1).collect()
    empty = F.lit(None).cast("string")
    if not smallest:
        return kept.select("vec_id", empty.alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), empty.alias("codebooks_sha256"))
    kept = kept.filter(F.size("q") == smallest[0][0])
    books = learn_codebooks(kept, parts, entries, rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    encoded = materialise(kept.mapInArrow(_encode(books), ENCODED), "encoded")
    keyed = encoded.withColumn("key", F.struct(F.col("label").isNull().alias("none"), F.coalesce("label", F.lit("")).alias("label")))
    totals = keyed.groupBy("key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("rows"))
    out = join_by_key(keyed, totals, ["key"], "rows", encoded.count())
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
