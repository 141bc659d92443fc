"""The window archive: JSON lines {ts, report, prev, seq, hash}, one chain of hashes for each writer, kept as files that only grow.

An archive is a folder. A batch of windows is one folder below it with one file a chain; a chain goes on from batch to batch.
Lines are read as they stand, so what was written can be verified, and each has its true number in its chain however the files
are split. Archives of other writers are single files; there each file is a chain of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattspan.functions.times import epoch_ms
from wattspan.operators.periodic import SEED, chain_windows

_REPORT = (
    "report struct<requests:bigint,io_ops:bigint,energy_kwh:double,operational_g:double,embodied_g:double,transport_g:double,models:array<string>,"
    "per_service:array<struct<service:string,io_ops:bigint,energy_kwh:double,co2_g:double,measured_ratio:double>>>"
)
_LINE = f"ts string, prev string, seq long, hash string, {_REPORT}, _bad string"
#: Below the archive's folder; the reader skips names that begin with an underscore.
_HEADS = "_heads"


def _from_path(name: str) -> Column:
    """The value of a folder name=value in the file's path, null where the path has none."""
    found = F.regexp_extract(F.col("path"), f"/{name}=([^/]*)", 1)
    decoded = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    # the path is a URI, and the folder's name is escaped itself
    return F.when(found != "", decoded(decoded(found)))


def read_archive_lines(spark: SparkSession, path: str) -> DataFrame:
    """file (the chain), batch, line (from 0 in its chain), body (as it stands) and the parsed fields of every line that is not blank.

    Lines are counted in two steps: within each split of a file, then over the splits, of which a chain has few.
    """
    raw = spark.read.option("recursiveFileLookup", "true").text(path)
    rows = raw.select(F.col("value").alias("body"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    rows = rows.filter(F.trim("body") != "")
    chain = F.coalesce(_from_path("chain"), F.col("path"))
    rows = rows.select("body", chain.alias("file"), F.coalesce(_from_path("batch").cast("long"), F.lit(0)).alias("batch"), "path", "split", "at")
    parts = ["file", "batch", "path", "split"]
    own = rows.withColumn("local", F.row_number().over(Window.partitionBy(*parts).orderBy("at")) - 1)
    before = F.sum("n").over(Window.partitionBy("file").orderBy("batch", "path", "split")) - F.col("n")
    splits = rows.groupBy(*parts).agg(F.count(F.lit(1)).alias("n")).withColumn("before", before)
    parsed = F.from_json("body", _LINE, {"columnNameOfCorruptRecord": "_bad"})
    out = own.join(splits, parts).select("file", "batch", (F.col("before") + F.col("local")).alias("line"), "body", parsed.alias("p"))
    return out.select("file", "batch", "line", "body", epoch_ms(F.col("p.ts")).alias("ts_ms"), "p.prev", "p.seq", "p.hash", "p.report", F.col("p._bad").isNotNull().alias("broken"))


def read_window_archive(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Window rows of an archive, and its malformed lines (no JSON, or without a time) with their text."""
    lines = read_archive_lines(spark, path)
    broken = F.col("broken") | F.col("ts_ms").isNull()
    good = lines.filter(~broken).select("file", "line", "ts_ms", "body", "prev", "seq", "hash", "report.*")
    return good, lines.filter(broken).select("file", "line", F.col("body").alias("text"))


def window_body(ts: Column, report: Column) -> Column:
    """A window's line before it is chained."""
    return F.to_json(F.struct(ts.alias("ts"), report.alias("report")))


def _heads(spark: SparkSession, path: str, batch: int) -> DataFrame | None:
    """file, hash and seq of each chain's last line before a batch; None where nothing was appended before."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{_HEADS}")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    names = (s.getPath().getName().partition("=") for s in fs.listStatus(folder))
    numbers = [int(n) for key, _, n in names if key == "batch" and int(n) < batch]
    return spark.read.schema("file string, hash string, seq long").parquet(f"{path}/{_HEADS}/batch={max(numbers):012d}") if numbers else None


def append_window_archive(windows: DataFrame, path: str, batch: int, seed: str = SEED) -> None:
    """Append a batch of windows (file: the chain, line: their order, body: JSON of ts and report) to an archive.

    Each chain goes on from its last line of the batches before, or from ``seed``. A batch that is appended again replaces
    itself, so a retried micro-batch leaves no line twice; batches are appended in order. Bodies that are no JSON object are
    left out. A chain's lines of one batch are hashed one after the other in one task, as each holds the hash before it.
    """
    spark, path = windows.sparkSession, path.rstrip("/")
    heads = _heads(spark, path, batch)
    chained = chain_windows(windows, seed, heads).filter("hash is not null")
    lines = chained.select("text", F.col("file").alias("chain"), "seq")
    folder = f"{path}/batch={batch:012d}"
    lines.repartition("chain").sortWithinPartitions("chain", "seq").select("text", "chain").write.mode("overwrite").partitionBy("chain").text(folder)
    # the heads come from what was written, and last: a batch without them is not gone on from
    written = read_archive_lines(spark, folder).groupBy("file").agg(F.max_by(F.struct("hash", "seq"), "line").alias("last")).select("file", "last.hash", "last.seq")
    if heads is not None:
        written = written.unionByName(heads.join(written.select("file"), "file", "left_anti"))
    written.write.mode("overwrite").parquet(f"{path}/{_HEADS}/batch={batch:012d}")
