"""Pairs of findings of different services that follow each other, over a table of findings and over micro-batches."""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattspan.functions.times import epoch_ms

#: The trailing window of live correlations, ten minutes, and the pairs that are followed at once.
WINDOW_MS, MAX_PAIRS = 600_000, 10_000
_WHO = ("gk", "gv", "a")
_PAIR = ("gk", "gv", "a", "b")


def correlation_input(findings: DataFrame) -> DataFrame:
    """ts_ms, trace_id, service, type, template, gk, gv of findings as the detectors give them."""
    first = lambda half: F.coalesce(F.get("grouping", 0)[half], F.lit(""))
    ts = epoch_ms(F.col("last_timestamp")).alias("ts_ms")
    return findings.select(ts, "trace_id", "service", "type", F.col("pattern.template").alias("template"), first("key").alias("gk"), first("value").alias("gv"))


def _first_followers(findings: DataFrame, lag_ms: int) -> DataFrame:
    """(gk, gv, a, b, ta, n, trace_a, lag): the n findings of identity a at ta, and how long after the first one of b came.

    Time is cut into buckets of the lag. In a bucket, findings of one identity are one list of at most ``lag_ms`` distinct
    times, and first findings of one identity and time are one row, so a busy moment costs a row for each of its times and
    each identity that follows, not for each pair of findings.
    """
    who = F.concat_ws("|", "service", "type", "template")
    base = findings.select("gk", "gv", "ts_ms", "trace_id", "service", who.alias("who"), F.floor(F.col("ts_ms") / lag_ms).alias("bucket"))
    a = base.groupBy("gk", "gv", F.col("who").alias("a"), F.col("service").alias("sa"), F.col("ts_ms").alias("ta"), "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("trace_id").alias("trace_a"))
    a = a.withColumn("bucket", F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)))
    b = base.groupBy("gk", "gv", "bucket", F.col("service").alias("sb"), F.col("who").alias("b")).agg(F.collect_set("ts_ms").alias("times"))
    after = F.array_min(F.filter("times", lambda t: t >= F.col("ta")))
    near = a.join(b, ["gk", "gv", "bucket"]).filter(F.col("sa") != F.col("sb")).withColumn("lag", after - F.col("ta")).filter(F.col("lag") <= lag_ms)
    return near.groupBy(*_PAIR, "ta", "n", "trace_a").agg(F.min("lag").alias("lag"))


def _totals(findings: DataFrame) -> DataFrame:
    who = F.concat_ws("|", "service", "type", "template")
    return findings.groupBy("gk", "gv", who.alias("a")).agg(F.count(F.lit(1)).alias("total"))


def _correlated(followers: DataFrame, totals: DataFrame, min_count: int, min_confidence: float) -> DataFrame:
    pairs = followers.groupBy(*_PAIR).agg(
        F.sum("n").alias("count"), F.percentile("lag", F.lit(0.5), F.col("n")).alias("median_lag_ms"), F.min("ta").alias("first_seen"), F.max("ta").alias("last_seen"),
        F.min_by("trace_a", F.struct("ta", "trace_a")).alias("sample_trace"),
    )
    out = pairs.join(totals, list(_WHO)).withColumn("confidence", F.least(F.col("count") / F.col("total"), F.lit(1.0)))
    return out.filter((F.col("count") >= min_count) & (F.col("confidence") >= min_confidence))


def _since(newest: int | Column, window_ms: int):
    return F.col("ts_ms") >= newest - window_ms


def cross_trace_correlations(findings: DataFrame, lag_ms: int = 5_000, min_count: int = 5, min_confidence: float = 0.7, max_pairs: int | None = None, window_ms: int | None = None) -> DataFrame:
    """Pairs of findings of different services that follow each other within the lag; each first finding counts once a pair.

    findings: ts_ms, trace_id, service, type, template, gk, gv. ``window_ms`` looks at the time before the newest finding only.
    """
    if window_ms is not None:
        newest = findings.agg(F.max("ts_ms").alias("newest"))
        findings = findings.crossJoin(F.broadcast(newest)).filter(_since(F.col("newest"), window_ms)).drop("newest")
    out = _correlated(_first_followers(findings, lag_ms), _totals(findings), min_count, min_confidence)
    return out if max_pairs is None else top_pairs(out, max_pairs)


def top_pairs(pairs: DataFrame, n: int = MAX_PAIRS) -> DataFrame:
    """The n most frequent pairs."""
    return pairs.orderBy(F.desc("count"), "a", "b").limit(n)


class LiveCorrelations:
    """Correlations of the trailing window over micro-batches, with their state as tables below ``folder``.

    The state of a batch is what the batch before left and what came since: the findings of the window, and for each first
    finding its followers. Both expire by event time, ``window_ms`` before the newest finding. A batch joins its findings
    only with those of the window that lie within the lag of them. Where more than ``max_pairs`` pairs are followed, the
    least frequent go, down to nine tenths of it; a pair that comes back starts anew.

    ``update`` may be called again for the last batch (a retry): it starts from the state of the batch before, so it gives the
    same pairs. States before that are deleted.
    """

    def __init__(self, spark: SparkSession, folder: str, lag_ms: int = 5_000, min_count: int = 5, min_confidence: float = 0.7, window_ms: int = WINDOW_MS, max_pairs: int = MAX_PAIRS):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.lag_ms, self.min_count, self.min_confidence, self.window_ms, self.max_pairs = lag_ms, min_count, min_confidence, window_ms, max_pairs

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _states(self) -> list[int]:
        """The batches whose state is whole, ascending."""
        path, fs = self._fs()
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        done = [int(n.partition("=")[2]) for n in names if n.startswith("batch=")]
        child = lambda n: self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batch={n}/followers/_SUCCESS")
        return sorted(n for n in done if fs.exists(child(n)))

    def _write(self, df: DataFrame, batch: int, name: str) -> DataFrame:
        path = f"{self.folder}/batch={batch}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _read(self, batch: int, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/batch={batch}/{name}")

    def update(self, findings: DataFrame, batch: int) -> DataFrame:
        """The pairs after a batch of findings (see ``correlation_input``); a batch without findings leaves the state as it is."""
        before = [n for n in self._states() if n < batch]
        new = findings.select("ts_ms", "trace_id", "service", "type", "template", "gk", "gv").filter("ts_ms is not null")
        # the files of this batch are written first, so that a retried batch or a lost executor reads the same rows
        new = self._write(new, batch, "new")
        low, high = new.agg(F.min("ts_ms"), F.max("ts_ms")).first()
        window = new if not before else self._read(before[-1], "window").unionByName(new)
        newest = window.agg(F.max("ts_ms")).first()[0]
        window = self._write(window if newest is None else window.filter(_since(newest, self.window_ms)), batch, "window")
        near = window if low is None else window.filter(F.col("ts_ms").between(low - self.lag_ms, high + self.lag_ms))
        found = _first_followers(near if low is not None else window.limit(0), self.lag_ms)
        if before:
            found = self._read(before[-1], "followers").unionByName(found)
        # a later batch can bring a nearer follower, or more findings at a time
        merged = found.groupBy(*_PAIR, "ta").agg(F.max("n").alias("n"), F.min("trace_a").alias("trace_a"), F.min("lag").alias("lag"))
        if newest is not None:
            merged = merged.filter(F.col("ta") >= newest - self.window_ms)
        followers = self._write(self._within_cap(merged), batch, "followers")
        for n in before[:-1]:
            self._drop(n)
        return _correlated(followers, _totals(window), self.min_count, self.min_confidence)

    def _within_cap(self, followers: DataFrame) -> DataFrame:
        counts = followers.groupBy(*_PAIR).agg(F.sum("n").alias("count"))
        if counts.count() <= self.max_pairs:
            return followers
        kept = counts.orderBy(F.desc("count"), *_PAIR).limit(self.max_pairs - self.max_pairs // 10)
        return followers.join(kept.select(*_PAIR), list(_PAIR), "left_semi")

    def _drop(self, batch: int) -> None:
        _, fs = self._fs()
        with contextlib.suppress(FileNotFoundError):
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batch={batch}"), True)
