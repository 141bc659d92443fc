"""Streaming forms: traces are assembled by processing time, then the batch operators run on each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspan.functions.normalize import normalize_spans
from wattspan.operators.detect import detect_all
from wattspan.operators.energy import with_last_known
from wattspan.schema import AVOIDABLE, Thresholds
from wattspan.streaming.correlate import LiveCorrelations, correlation_input
from wattspan.streaming.window import MAX_SPANS, MAX_TRACES, TTL_MS, assemble_traces, trace_spans


def detect_stream(
    stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, thresholds: Thresholds | None = None, ttl_ms: int = TTL_MS, max_spans: int = MAX_SPANS, max_traces: int = MAX_TRACES,
    correlations: LiveCorrelations | None = None, pairs_sink: Callable[[DataFrame, int], None] | None = None,
):
    """A started query that gives the findings of each batch of given-out traces to ``sink``.

    With ``correlations`` each batch's findings also go into the trailing window, and its pairs to ``pairs_sink``.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        # the findings of a batch are computed once, from traces that are computed once
        spans = normalize_spans(trace_spans(batch)).persist()
        findings = detect_all(spans, thresholds or Thresholds(), dealt=True).persist()
        try:
            sink(findings, epoch)
            if correlations is not None:
                pairs = correlations.update(correlation_input(findings), epoch)
                if pairs_sink is not None:
                    pairs_sink(pairs, epoch)
        finally:
            findings.unpersist()
            spans.unpersist()

    return assemble_traces(stream, ttl_ms, max_spans, max_traces).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(each).start()


def sticky(figures: DataFrame, value: str, ttl_ms: int, key: str = "service") -> DataFrame:
    """figures with the last value that isn't null, for as long as ttl_ms. A key's history is dealt over days."""
    held = with_last_known(figures, key, value)
    return held.withColumn(f"sticky_{value}", F.when(F.col("ts_ms") - F.col("_last.ts_ms") <= ttl_ms, F.col(f"_last.{value}"))).drop("_last")


def live_totals(spans: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Cumulative ops, traces and microseconds by service. Of a stream, for update or complete mode, traces are approximate.

    With the findings so far (a batch) also avoidable ops and their ratio; of one template of a trace and endpoint the
    largest finding counts.
    """
    traces = F.approx_count_distinct("trace_id") if spans.isStreaming else F.countDistinct("trace_id")
    totals = spans.groupBy("service").agg(F.count(F.lit(1)).alias("io_ops"), traces.alias("traces"), F.sum("duration_us").alias("busy_us"))
    if findings is None:
        return totals
    extra = F.max(F.greatest(F.col("pattern.occurrences") - 1, F.lit(0))).alias("ops")
    each = findings.filter(F.col("type").isin(*AVOIDABLE)).groupBy("service", "trace_id", F.col("pattern.template").alias("template"), "source_endpoint").agg(extra)
    avoidable = each.groupBy("service").agg(F.sum("ops").alias("avoidable"))
    return totals.join(avoidable, "service", "left").fillna(0, ["avoidable"]).withColumn("io_waste_ratio", F.col("avoidable") / F.col("io_ops"))
