"""Exact deduplication by a log-structured merge index, in DataFrame operations alone.

* memtable: the documents are dealt into memtables by a hash of the id; within one, equal digests meet in a partial
  aggregate before anything is shuffled, so a group of a third of all rows costs a row a task.
* flush: every memtable becomes a run of (digest, id, rows), sorted by digest, written with Parquet bloom filters on the
  digest, so a later probe for single digests skips row groups.
* compaction: runs merge into one level; of each digest the smallest (or largest) identifier stays.
* verification: digests with more than one row are hits. Hits are grouped by digest together with their normalised
  bytes; a digest with two different texts is split by text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspan.llm.common import discard, join_by_key, materialise, without

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of a block of the hit filter, and its blocks: at most 2048 blocks of 4 KiB, 8 MiB, are broadcast.
FILTER_BITS, FILTER_BLOCKS = 32768, 2048
_BLOOM = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.max.bytes": "1048576", "parquet.bloom.filter.adaptive.enabled": "true"}


def normalised(text):
    """Lower-cases A-Z only; null counts as empty. ASCII texts take the JVM's fast path, which changes the same letters."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _better(keep: str):
    return {"smallest": F.min, "largest": F.max}[keep]


def flush_runs(digests: DataFrame, memtables: int, keep: str = "smallest") -> DataFrame:
    """Level 0: a sorted run of (digest, id, rows) for each memtable."""
    dealt = digests.withColumn("run", F.pmod(F.xxhash64("id"), F.lit(memtables)).cast("int"))
    run = dealt.groupBy("run", "digest").agg(_better(keep)("id").alias("id"), F.count(F.lit(1)).alias("rows"))
    return materialise(run.sortWithinPartitions("run", "digest"), "runs", **_BLOOM)


def compact(runs: DataFrame, keep: str = "smallest") -> DataFrame:
    """Level 1: one row a digest with the identifier that stays and the rows of the group."""
    level = runs.groupBy("digest").agg(_better(keep)("id").alias("id"), F.sum("rows").alias("rows"))
    return materialise(level.sortWithinPartitions("digest"), "level", **_BLOOM)


def _filter_bit():
    """Where a digest falls in the hit filter: block and bit from its first ten hex digits."""
    n = F.conv(F.substring("digest", 1, 10), 16, 10).cast("long")
    return F.pmod(n, F.lit(FILTER_BLOCKS)).alias("block"), F.pmod(F.floor(n / FILTER_BLOCKS), F.lit(FILTER_BITS)).alias("bit")


def hit_filter(level: DataFrame) -> DataFrame:
    """Bitmaps of the digests with more than one row. Its size is fixed; when it fills up, more rows than needed are verified."""
    block, bit = _filter_bit()
    return level.filter("rows > 1").select(block, bit).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def _may_hit(rows: DataFrame, filter_: DataFrame) -> DataFrame:
    block, bit = _filter_bit()
    probed = rows.withColumns({"block": block, "bit": bit}).join(F.broadcast(filter_), "block")
    byte = F.conv(F.hex(F.expr("substring(bitmap, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return probed.withColumn("byte", byte).filter("shiftright(byte, cast(bit % 8 as int)) & 1 = 1").drop("block", "bit", "bitmap", "byte")


def exact_duplicates(docs: DataFrame, keep: str = "smallest", memtables: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text equals the empty text. Of equal texts the smallest or
    largest id stays; rows that repeat an id and text are each counted in group_size and all carry kept = true if
    theirs is the id that stays. A null id never stays while another id has the text. An empty table gives no rows;
    other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("norm"))
    digests = materialise(rows.select("id", F.sha2("norm", 256).alias("digest")), "digests")
    runs = flush_runs(digests, memtables, keep)
    level = compact(runs, keep)
    discard(runs)
    total = digests.count()

    hits = _may_hit(rows.withColumn("digest", F.sha2("norm", 256)), hit_filter(level))
    variants = hits.groupBy("digest", "norm").agg(_better(keep)("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    clashing = materialise(variants.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest"), "clashes")

    found = join_by_key(digests, level.select("digest", F.col("id").alias("keep_id"), F.col("rows").alias("group_size")), ["digest"], "group_size", total)
    if not clashing.isEmpty():  # two texts share a SHA-256 digest: these are told apart by their bytes
        apart = rows.withColumn("digest", F.sha2("norm", 256)).join(clashing, "digest")
        by_text = apart.join(variants, ["digest", "norm"]).select("digest", "id", "keep_id", "group_size")
        found = found.join(clashing, "digest", "left_anti").unionByName(by_text)
    kept = F.coalesce(F.col("id").eqNullSafe(F.col("keep_id")), F.lit(False))
    return found.select(F.col("id").alias("doc_id"), "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), F.col("digest").alias("text_sha256"))


def keep_one(docs: DataFrame, keep: str = "smallest", memtables: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text another row keeps. Rows that repeat both the kept id and text all stay.

    Null counts as the empty text and a null id never stays while another id has the text; where only null ids have it, all
    of them stay. An empty table stays empty; other columns may have any name.
    """
    dropped = materialise(exact_duplicates(docs, keep, memtables, id_col, text_col).filter("not kept").select("doc_id", "text_sha256").distinct(), "dropped")
    return without(docs, dropped, [F.col(id_col).cast("long"), F.sha2(normalised(F.col(text_col)), 256)])
