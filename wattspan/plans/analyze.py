"""The whole batch run: normalise, detect, score, stamp, sign, gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattspan.functions.normalize import normalize_spans
from wattspan.operators import detect, reports, score
from wattspan.operators.suggestions import enrich_suggestions
from wattspan.plans.detection import ALL_SQL, LIMITS, normalized
from wattspan.plans.registry import register
from wattspan.schema import Thresholds
from wattspan.sources.derived import SPANS_SQL


@dataclass
class Report:
    findings: DataFrame
    green: score.GreenSummary
    endpoints: DataFrame
    gate: DataFrame


def analyze(spans: DataFrame, thresholds: Thresholds | None = None, confidence: str = "ci_batch", dealt: bool = False, **context) -> Report:
    """Findings with impact, fix, confidence and signature, the green summary, endpoint counts and the gate. ``dealt``: the spans are dealt by trace."""
    n = normalize_spans(spans)
    kept = detect.kept_spans(n, dealt)
    raw = detect.detect_all(kept, thresholds or Thresholds(), dealt=True)
    # a row for each endpoint; once they are counted, Spark knows how few they are and copies them to the findings
    stats = score.endpoint_stats(kept).persist()
    stats.count()
    findings = reports.finding_signature(reports.stamp_confidence(enrich_suggestions(score.enrich_findings_with_iis(raw, stats)), confidence))
    return Report(detect.sort_findings(findings), score.green_summary(n, raw, **context), stats, reports.quality_gate(raw, score.io_waste(kept, raw)))


@register("enrich_suggestions", SPANS_SQL.rstrip() + """
SELECT trace_id, 'kafka' AS framework, 'publish one batch a request: a producer with linger and batches' AS recommendation FROM normalized WHERE event_type = 'messaging' GROUP BY trace_id HAVING count(*) >= 2""")  # fmt: skip
def _suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = enrich_suggestions(detect.detect_n_plus_one(normalized(spark, sf_dir).filter("event_type = 'messaging'"), 2, 10_000))
    return found.select("trace_id", F.col("suggested_fix.framework").alias("framework"), F.col("suggested_fix.recommendation").alias("recommendation"))


@register("analyze", ALL_SQL + """SELECT type, severity, trace_id, service, source_endpoint, 'ci_batch' AS confidence, type || ':' || service || ':' || translate(source_endpoint, '/ ', '__') || ':' || substr(sha256(template), 1, 32) AS signature,
       CAST(CASE WHEN type LIKE 'n_plus_one%' OR type LIKE 'redundant%' THEN occurrences - 1 ELSE 0 END AS BIGINT) AS extra_io_ops FROM found""")
def _analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wattspan.sources.derived import order_spans

    return analyze(order_spans(spark, sf_dir), LIMITS, dealt=True).findings.select("type", "severity", "trace_id", "service", "source_endpoint", "confidence", "signature", F.col("green_impact.estimated_extra_io_ops").alias("extra_io_ops"))
