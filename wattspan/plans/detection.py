"""Registered queries of normalisation and detection over the derived spans, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattspan.functions.normalize import normalize_spans, template_rollup
from wattspan.operators import detect as d
from wattspan.plans.registry import register
from wattspan.schema import Thresholds
from wattspan.sources.derived import SPANS_SQL, order_spans

#: Thresholds at which the derived spans show every pattern.
LIMITS = Thresholds(n_plus_one=5, window_ms=500, slow_ms=25, slow_min=3, fanout=8, chatty=2, pool=3, serialized=3)


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_spans(order_spans(spark, sf_dir))


def flat(findings: DataFrame) -> DataFrame:
    """The plain columns of findings."""
    p = F.col("pattern")
    return findings.select("type", "severity", "trace_id", "service", "source_endpoint", p["template"].alias("template"), p["occurrences"].alias("occurrences"), p["distinct_params"].alias("distinct_params"), p["window_ms"].alias("window_ms"))


def _kind(prefix: str) -> str:
    return f"'{prefix}_' || CASE event_type WHEN 'http_out' THEN 'http' ELSE event_type END"


_REP = "min_by(service, ord) AS service, min_by(endpoint, ord) AS source_endpoint, max(ts_ms) - min(ts_ms) AS window_ms"
#: Groups that the direct rule or, for URLs, the spread of durations makes an N+1 finding.
_N1 = SPANS_SQL + f""", g AS (
  SELECT trace_id, event_type, template, count(*) AS n, count(DISTINCT params) AS dp, {_REP}, round(1000 * stddev_pop(duration_us) / avg(duration_us)) AS cv
  FROM normalized GROUP BY trace_id, event_type, template
), n1 AS (
  SELECT * FROM g WHERE n >= 5 AND window_ms <= 500 AND (event_type = 'messaging' OR dp >= 5 OR (event_type = 'http_out' AND cv > 500))
)
"""


@register("normalize_spans", SPANS_SQL + "SELECT span_id, event_type, template, params FROM normalized")
def _normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(spark, sf_dir).select("span_id", "event_type", "template", F.array_join("params", ",").alias("params"))


@register("template_rollup", SPANS_SQL + """
SELECT event_type, service, template, count(*) AS calls, count(DISTINCT params) AS distinct_params, CAST(sum(duration_us) AS BIGINT) AS total_us, avg(duration_us) AS mean_us,
       max(duration_us) AS max_us, count(DISTINCT trace_id) AS traces FROM normalized GROUP BY ALL""")  # fmt: skip
def _rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_rollup(normalized(spark, sf_dir))


_N1_SELECT = f"""
SELECT {_kind("n_plus_one")} AS type, CASE WHEN n >= 10 THEN 'critical' ELSE 'warning' END AS severity, trace_id, service, source_endpoint, template, n AS occurrences,
       CASE WHEN event_type = 'messaging' THEN 1 ELSE dp END AS distinct_params, window_ms FROM n1"""


@register("detect_n_plus_one", _N1 + _N1_SELECT)
def _n_plus_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = LIMITS
    return flat(d.detect_n_plus_one(normalized(spark, sf_dir), t.n_plus_one, t.window_ms, t.sanitizer))


@register("detect_n_plus_one_strict", _N1.replace("n >= 5", "n >= 3").replace("dp >= 5", "dp >= 3") + _N1_SELECT)
def _n_plus_one_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(d.detect_n_plus_one(normalized(spark, sf_dir), 3, 500, "strict"))


@register("sequential_siblings", SPANS_SQL + """, w AS (
  SELECT *, lag(ts_ms * 1000 + duration_us) OVER (PARTITION BY trace_id, event_type, template ORDER BY ts_ms, ord) AS prev FROM normalized
)
SELECT trace_id, event_type, template, count(*) >= 3 AND bool_and(coalesce(prev <= ts_ms * 1000, true)) AND count(parent_span_id) = count(*) AND min(parent_span_id) = max(parent_span_id) AS sequential
FROM w GROUP BY ALL""")  # fmt: skip
def _sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.sequential_siblings(normalized(spark, sf_dir)).select("trace_id", "event_type", "template", "sequential")


_REDUNDANT = f"""
SELECT {_kind("redundant")} AS type, CASE WHEN count(*) >= 5 THEN 'warning' ELSE 'info' END AS severity, trace_id, min_by(service, ord) AS service, min_by(endpoint, ord) AS source_endpoint, template,
       count(*) AS occurrences, 1 AS distinct_params, max(ts_ms) - min(ts_ms) AS window_ms
FROM normalized WHERE event_type <> 'messaging' AND (trace_id, template) NOT IN (SELECT (trace_id, template) FROM n1)
GROUP BY trace_id, event_type, template, params HAVING count(*) >= 2"""


@register("detect_redundant", _N1 + _REDUNDANT)
def _redundant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(d.detect_repeats(normalized(spark, sf_dir), LIMITS.n_plus_one, LIMITS.window_ms, n_plus_one=False))


@register("redundant_spans", _N1 + """, r AS (
  SELECT trace_id, event_type, template, params FROM normalized WHERE event_type <> 'messaging' AND (trace_id, template) NOT IN (SELECT (trace_id, template) FROM n1)
  GROUP BY ALL HAVING count(*) >= 2
)
SELECT n.trace_id, n.span_id FROM normalized n JOIN r ON n.trace_id = r.trace_id AND n.event_type = r.event_type AND n.template = r.template AND n.params = r.params""")  # fmt: skip
def _redundant_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.redundant_spans(normalized(spark, sf_dir), threshold=LIMITS.n_plus_one, window_ms=LIMITS.window_ms).select("trace_id", "span_id")


_SLOW = f"""
SELECT {_kind("slow")} AS type, CASE WHEN max(duration_us) > 125000 THEN 'critical' ELSE 'warning' END AS severity, trace_id, min_by(service, ord) AS service, min_by(endpoint, ord) AS source_endpoint, template,
       count(*) AS occurrences, count(DISTINCT params) AS distinct_params, max(ts_ms) - min(ts_ms) AS window_ms
FROM normalized WHERE duration_us > 25000 GROUP BY trace_id, event_type, template HAVING count(*) >= 3"""


@register("detect_slow", SPANS_SQL + _SLOW)
def _slow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(d.detect_slow(normalized(spark, sf_dir), LIMITS.slow_ms, LIMITS.slow_min))


_CROSS = f"""
SELECT {_kind("slow")} AS type, CASE WHEN quantile_disc(duration_us, 0.99) > 125000 THEN 'critical' ELSE 'warning' END AS severity,
       arg_min(trace_id, (-duration_us, trace_id, span_id)) AS trace_id, arg_min(service, (-duration_us, trace_id, span_id)) AS service, arg_min(endpoint, (-duration_us, trace_id, span_id)) AS source_endpoint,
       template, count(*) AS occurrences, 0 AS distinct_params, max(ts_ms) - min(ts_ms) AS window_ms, quantile_disc(duration_us, 0.5) AS p50, quantile_disc(duration_us, 0.99) AS p99
FROM normalized WHERE duration_us > 25000 GROUP BY event_type, template HAVING count(*) >= 3 AND count(DISTINCT trace_id) >= 2 AND quantile_disc(duration_us, 0.99) > 25000"""


@register("detect_slow_cross_trace", SPANS_SQL + _CROSS)
def _slow_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = d.detect_slow_cross_trace(normalized(spark, sf_dir), LIMITS.slow_ms, LIMITS.slow_min)
    return flat(found.withColumns({"p50": F.col("pattern.span_duration_us_p50"), "p99": F.col("pattern.span_duration_us_p99")})).join(
        found.select("type", "trace_id", F.col("pattern.template").alias("template"), F.col("pattern.span_duration_us_p50").alias("p50"), F.col("pattern.span_duration_us_p99").alias("p99")), ["type", "trace_id", "template"]
    )


_FAN_CTE = """, c AS (
  SELECT trace_id, parent_span_id, count(*) AS n, max(ts_ms) - min(ts_ms) AS window_ms FROM normalized WHERE parent_span_id IS NOT NULL GROUP BY ALL HAVING count(*) > 8
)
"""
_FAN = """SELECT 'excessive_fanout' AS type, CASE WHEN n > 24 THEN 'critical' ELSE 'warning' END AS severity, c.trace_id, p.service, p.endpoint AS source_endpoint, p.template, n AS occurrences, n AS distinct_params, window_ms
FROM c JOIN normalized p ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id"""


@register("detect_fanout", SPANS_SQL.rstrip() + _FAN_CTE + _FAN)
def _fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(d.detect_fanout(normalized(spark, sf_dir), LIMITS.fanout))


_CHATTY = """
SELECT 'chatty_service' AS type, CASE WHEN count(*) > 6 THEN 'critical' ELSE 'warning' END AS severity, trace_id, min_by(service, ord) AS service, min_by(endpoint, ord) AS source_endpoint, min_by(endpoint, ord) AS template,
       count(*) AS occurrences, count(DISTINCT template) AS distinct_params, max(ts_ms) - min(ts_ms) AS window_ms
FROM normalized WHERE event_type = 'http_out' GROUP BY trace_id HAVING count(*) > 2"""


@register("detect_chatty", SPANS_SQL + _CHATTY)
def _chatty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(d.detect_chatty(normalized(spark, sf_dir), LIMITS.chatty))


_OPEN_CTE = """, e AS (
  SELECT trace_id, service, ts_ms * 1000 AS t, 1 AS d FROM normalized WHERE event_type = 'sql'
  UNION ALL SELECT trace_id, service, ts_ms * 1000 + duration_us, -1 FROM normalized WHERE event_type = 'sql'
), s AS (
  SELECT *, sum(d) OVER w AS s FROM e WINDOW w AS (PARTITION BY trace_id, service ORDER BY t, d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), x AS (
  SELECT *, s - least(0, min(s) OVER w) AS open FROM s WINDOW w AS (PARTITION BY trace_id, service ORDER BY t, d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), peak AS (
  SELECT trace_id, service, CAST(max(open) AS BIGINT) AS peak FROM x GROUP BY ALL HAVING max(open) >= 3
)
"""


_OPEN = SPANS_SQL.rstrip() + _OPEN_CTE
_POOL = """
SELECT 'pool_saturation' AS type, 'warning' AS severity, n.trace_id, n.service, min_by(endpoint, ord) AS source_endpoint, n.service AS template, peak AS occurrences, count(*) AS distinct_params, max(ts_ms) - min(ts_ms) AS window_ms
FROM normalized n JOIN peak p ON n.trace_id = p.trace_id AND n.service = p.service WHERE event_type = 'sql' GROUP BY n.trace_id, n.service, peak"""


@register("detect_pool_saturation", _OPEN + _POOL)
def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(d.detect_pool_saturation(normalized(spark, sf_dir), LIMITS.pool))


@register("pool_peak_spans", _OPEN + """, t AS (
  SELECT x.trace_id, x.service, min(t) AS t FROM x JOIN peak p ON x.trace_id = p.trace_id AND x.service = p.service AND x.open = p.peak GROUP BY ALL
)
SELECT n.trace_id, n.service, span_id FROM normalized n JOIN t ON n.trace_id = t.trace_id AND n.service = t.service
WHERE event_type = 'sql' AND duration_us > 0 AND ts_ms * 1000 <= t AND t < ts_ms * 1000 + duration_us""")  # fmt: skip
def _pool_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.pool_peak_spans(normalized(spark, sf_dir), LIMITS.pool)


#: The longest chain of siblings that do not overlap, by dynamic programming over spans in order of their ends: ``best`` of
#: the first i spans, then the way back, where a span is taken if it is no worse than leaving it out.
_SERIAL_CTE = """, kids AS (
  SELECT trace_id, parent_span_id, span_id, template, ts_ms, duration_us, ord, service, endpoint, ts_ms * 1000 AS t0, ts_ms * 1000 + duration_us AS t1 FROM normalized WHERE parent_span_id IS NOT NULL
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY trace_id, parent_span_id ORDER BY t1, t0, ord, span_id) AS i FROM kids
), sized AS (
  SELECT trace_id, parent_span_id, count(*) AS n FROM placed GROUP BY ALL HAVING count(*) >= 3 AND count(DISTINCT template) >= 2
), steps AS (
  SELECT a.trace_id, a.parent_span_id, a.i, least(count(b.i), a.i - 1) AS before
  FROM placed a JOIN sized USING (trace_id, parent_span_id) LEFT JOIN placed b ON a.trace_id = b.trace_id AND a.parent_span_id = b.parent_span_id AND b.t1 <= a.t0 GROUP BY a.trace_id, a.parent_span_id, a.i
), best AS (
  SELECT trace_id, parent_span_id, 0 AS i, [0] AS best FROM sized
  UNION ALL
  SELECT s.trace_id, s.parent_span_id, b.i + 1, list_append(b.best, greatest(b.best[b.i + 1], b.best[CAST(s.before AS INTEGER) + 1] + 1)) FROM best b JOIN steps s ON b.trace_id = s.trace_id AND b.parent_span_id = s.parent_span_id AND s.i = b.i + 1
), way AS (
  SELECT b.trace_id, b.parent_span_id, b.i AS i, b.best, CAST(NULL AS BIGINT) AS taken FROM best b JOIN sized z ON b.trace_id = z.trace_id AND b.parent_span_id = z.parent_span_id AND b.i = z.n
  UNION ALL
  SELECT w.trace_id, w.parent_span_id, CAST(CASE WHEN w.best[CAST(s.before AS INTEGER) + 1] + 1 >= w.best[CAST(w.i AS INTEGER) + 1] THEN s.before ELSE w.i - 1 END AS INTEGER), w.best,
    CASE WHEN w.best[CAST(s.before AS INTEGER) + 1] + 1 >= w.best[CAST(w.i AS INTEGER) + 1] THEN s.i END
  FROM way w JOIN steps s ON w.trace_id = s.trace_id AND w.parent_span_id = s.parent_span_id AND s.i = w.i
), chain AS (
  SELECT p.* FROM way w JOIN placed p ON w.trace_id = p.trace_id AND w.parent_span_id = p.parent_span_id AND w.taken = p.i
), serial AS (
  SELECT trace_id, parent_span_id, min_by(service, ord) AS service, min_by(endpoint, ord) AS source_endpoint, min_by(template, ord) AS template, count(*) AS n, count(DISTINCT template) AS dp, max(ts_ms) - min(ts_ms) AS window_ms
  FROM chain GROUP BY ALL HAVING count(*) >= 3 AND count(DISTINCT template) >= 2
)
"""
_SERIAL = "SELECT 'serialized_calls' AS type, 'info' AS severity, trace_id, service, source_endpoint, template, n AS occurrences, dp AS distinct_params, window_ms FROM serial"


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@register("detect_serialized", recursive(SPANS_SQL.rstrip() + _SERIAL_CTE + _SERIAL))
def _serialized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(d.detect_serialized(normalized(spark, sf_dir), LIMITS.serialized, None))


@register("finding_evidence", recursive(SPANS_SQL.rstrip() + _FAN_CTE + _SERIAL_CTE + """
SELECT 'excessive_fanout' AS type, k.trace_id, p.endpoint AS source_endpoint, p.template, k.span_id FROM c JOIN normalized p ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id JOIN normalized k ON k.trace_id = c.trace_id AND k.parent_span_id = c.parent_span_id
UNION ALL SELECT 'serialized_calls', s.trace_id, s.source_endpoint, s.template, h.span_id FROM serial s JOIN chain h ON s.trace_id = h.trace_id AND s.parent_span_id = h.parent_span_id"""))
def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = normalized(spark, sf_dir)
    return d.finding_evidence(d.detect_fanout(n, LIMITS.fanout).unionByName(d.detect_serialized(n, LIMITS.serialized, None)))


@register("timing_stats", SPANS_SQL + """
SELECT trace_id, template, count(*) AS n, quantile_disc(duration_us, 0.5) AS p50, quantile_disc(duration_us, 0.99) AS p99,
       CAST(CASE WHEN count(*) > 1 AND avg(duration_us) > 0 THEN round(1000 * stddev_pop(duration_us) / avg(duration_us)) ELSE 0 END AS INTEGER) AS cv
FROM normalized GROUP BY trace_id, template""")  # fmt: skip
def _timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(spark, sf_dir).groupBy("trace_id", "template").agg(F.count(F.lit(1)).alias("n"), *d.timing_stats())


#: All findings, one row each.
ALL_SQL = recursive(_N1.rstrip() + _FAN_CTE + _OPEN_CTE + _SERIAL_CTE) + ", found AS (" + "\nUNION ALL BY NAME ".join(
    [_N1_SELECT, _REDUNDANT, _SLOW, _FAN, _CHATTY, _POOL, _SERIAL, f"SELECT * EXCLUDE (p50, p99) FROM ({_CROSS})"]
) + ")\n"


@register("detect_all", ALL_SQL + "SELECT * FROM found")
def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(d.sort_findings(d.detect_all(d.kept_spans(normalized(spark, sf_dir), dealt=True), LIMITS, dealt=True)))
