"""Shared folders, materialised tables, hot-key joins and connected components for the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than one in HOT_SHARE rows, so at most HOT_SHARE keys are hot.
HOT_SHARE = 1000
#: Bits of a block of a key filter, and its blocks: at most 2048 blocks of 4 KiB, 8 MiB, are broadcast.
FILTER_BITS, FILTER_BLOCKS = 32768, 2048
#: Bytes of an Arrow batch of texts; an executor and its Python worker each hold a batch whole, for every task.
BATCH = 4_000_000
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: What loads something that a Python worker keeps for its later tasks.
_LOADERS: list = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; a local folder only where that setting is missing (local mode)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.scratch_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _places(key: Column) -> tuple[Column, Column]:
    """Block and bit of a 64-bit key in a key filter."""
    return F.pmod(key, F.lit(FILTER_BLOCKS)), F.pmod(F.shiftright(key, 11), F.lit(FILTER_BITS))


def key_filter(keys: DataFrame, key: Column) -> DataFrame:
    """Bitmaps of 64-bit keys. Their size is fixed; the fuller they are, the more other keys pass as well."""
    block, bit = _places(key)
    return keys.select(block.alias("block"), bit.alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def with_passes(rows: DataFrame, filter_: DataFrame, key: str) -> DataFrame:
    """rows with ``passes``: false only where the key is not in the filter."""
    block, _ = _places(F.col(key))
    probed = rows.join(F.broadcast(filter_), block == F.col("block"), "left")
    bit = f"cast(pmod(shiftright({key}, 11), {FILTER_BITS}) as int)"
    byte = F.conv(F.hex(F.expr(f"substring(bitmap, {bit} div 8 + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(byte, F.lit(0)).bitwiseAND(F.expr(f"shiftleft(1, {bit} % 8)")) != 0
    return probed.withColumn("passes", hit).drop("block", "bitmap")


def without(docs: DataFrame, dropped: DataFrame, keys: list[Column]) -> DataFrame:
    """``docs`` without the rows whose keys are a row of ``dropped``; nulls equal nulls, extra columns may have any name.

    Only rows that a filter of fixed size lets pass are shuffled with their columns.
    """
    names = [f"k{i}" for i in range(len(keys))]
    gone = dropped.toDF(*names)
    rows = docs.select(F.struct("*").alias("row"), *(k.alias(n) for k, n in zip(keys, names, strict=True))).withColumn("key", F.xxhash64(*names))
    rows = with_passes(rows, key_filter(gone, F.xxhash64(*names)), "key")
    a, b = rows.filter("passes").alias("a"), gone.alias("b")
    same = [F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")) for n in names]
    left = a.join(b, same, "left_anti")
    return left.select("row").unionByName(rows.filter("not passes").select("row")).select("row.*")


def join_by_key(rows: DataFrame, lookup: DataFrame, keys: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """rows ⋈ lookup where lookup has one row a key and ``weight`` holds the rows of that key.

    Keys with more than total/HOT_SHARE rows are at most HOT_SHARE, so their lookup rows are broadcast;
    all other keys are shuffled, and none of them holds more than one in HOT_SHARE rows.
    """
    hot = lookup.filter(F.col(weight) * HOT_SHARE > F.lit(total))
    cold = lookup.filter(F.col(weight) * HOT_SHARE <= F.lit(total))
    by_hot = rows.join(F.broadcast(hot), keys, "inner")
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return by_hot.unionByName(rest.join(cold, keys, how), allowMissingColumns=True)


def map_texts(rows: DataFrame, function: Callable, schema) -> DataFrame:
    """rows.mapInArrow(function, schema), with the session's Arrow batches cut at about ``BATCH`` bytes, or less if it says so.

    The plan may run later, so the session keeps that setting; one row is never cut.
    """
    spark = rows.sparkSession
    conf, most = spark.conf, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_BYTES))
    if not 0 < most <= BATCH:
        conf.set(_BATCH_BYTES, str(BATCH))
    return rows.mapInArrow(function, schema)


def once_a_worker(load: Callable) -> Callable:
    """``load``, whose last result stays in the worker until a task reads texts for something else (see batch_blocks)."""
    one = lru_cache(1)(load)
    _LOADERS.append(one)
    return one


def let_go(but: Callable | None = None) -> None:
    """Drop what earlier tasks have left in this worker, but for what ``but`` loads."""
    old = [x for x in _LOADERS if x is not but and x.cache_info().currsize]
    for x in old:
        x.cache_clear()
    if old:
        give_back()


def give_back() -> None:
    """Return what a Python worker has freed to the system: it is used again by later stages, which need not hold it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def batch_blocks(batches: Iterable, column: str, size: int = 1_000_000, keep: Callable | None = None) -> Iterator[tuple]:
    """Cut Arrow batches into (batch slice, its texts) of about ``size`` bytes of text; one long text is a block of its own.

    At the end of a partition its worker gives freed memory back. Of what earlier tasks loaded it keeps only what ``keep`` loads.
    """
    import numpy as np
    import pyarrow.compute as pc

    let_go(keep)
    for batch in batches:
        texts = batch.column(column)
        lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = np.cumsum(lengths + 1) // size
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
        for i, j in zip(edges, edges[1:]):
            part = batch.slice(i, j - i)
            yield part, part.column(column).to_pylist()
    give_back()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components as (u, v): v is the smallest node reachable from u. Smallest nodes and nodes without links are not returned.

    Alternating large-star and small-star steps, each written to the shared folder, until every component is a star. The
    joins bring one number to each link; AQE splits those of nodes with very many links.
    """
    edges = materialise(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v"), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        small = materialise(small.filter("u <> v").distinct(), "small")
        discard(edges, large)
        edges = small
        if edges.join(edges.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            return edges
