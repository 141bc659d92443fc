"""Registered queries of scoring, carbon, telemetry, reports, periodic aggregation and correlation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattspan.functions.times import iso_ms
from wattspan.operators import detect as d
from wattspan.operators import energy as e
from wattspan.operators import ingest, periodic, reports
from wattspan.operators import score as s
from wattspan.operators import stitch
from wattspan.plans.detection import _N1, LIMITS, normalized
from wattspan.plans.registry import register
from wattspan.sources import archive
from wattspan.sources.derived import SPANS_SQL, order_spans, read_tables
from wattspan.sources.reference_tables import region_rows
from wattspan.sources.shared import shared_folder, written
from wattspan.streaming.correlate import cross_trace_correlations, top_pairs
from wattspan.streaming.live import live_totals, sticky

#: Findings of the direct rules that count as avoidable.
_AVOID = _N1 + """, r AS (
  SELECT trace_id, template, min_by(endpoint, ord) AS source_endpoint, count(*) AS n, event_type FROM normalized
  WHERE event_type <> 'messaging' AND (trace_id, template) NOT IN (SELECT (trace_id, template) FROM n1) GROUP BY trace_id, event_type, template, params HAVING count(*) >= 2
), f AS (
  SELECT trace_id, template, source_endpoint, n, event_type, service FROM n1 UNION ALL SELECT trace_id, template, source_endpoint, n, event_type, NULL FROM r
), av AS (
  SELECT trace_id, template, source_endpoint, max(n) - 1 AS ops, arg_max(event_type, n) AS event_type FROM f GROUP BY ALL
), avoid AS (
  SELECT CAST(sum(ops) AS BIGINT) AS avoidable, CAST(coalesce(sum(ops) FILTER (WHERE event_type = 'sql'), 0) AS BIGINT) AS avoidable_sql, CAST(coalesce(sum(ops) FILTER (WHERE event_type = 'messaging'), 0) AS BIGINT) AS avoidable_messaging FROM av
)
"""
_STATS = "SELECT service, endpoint AS source_endpoint, count(*) AS io_ops, count(DISTINCT trace_id) AS invocations, count(*) / count(DISTINCT trace_id) AS io_intensity FROM normalized GROUP BY service, endpoint"
_VALUES = ", ".join(f"('{r}', {i}, {p})" for r, i, _, p in region_rows())
_SCORED = f""", grid(region, intensity, pue) AS (VALUES {_VALUES}), sc AS (
  SELECT n.*, coalesce(g.intensity, 0.0) AS intensity, coalesce(g.pue, 1.5) AS pue,
    1e-7 * CASE event_type WHEN 'sql' THEN 0.5 WHEN 'http_out' THEN CASE WHEN response_size_bytes < 10240 THEN 0.8 WHEN response_size_bytes <= 1048576 THEN 1.2 ELSE 2.0 END ELSE 1.0 END AS energy_kwh
  FROM normalized n LEFT JOIN grid g ON n.cloud_region = g.region
), scored AS (
  SELECT *, CASE WHEN cloud_region IS NOT NULL THEN energy_kwh * intensity * pue END AS co2_grams,
    CASE WHEN event_type = 'http_out' AND cloud_region IS NOT NULL AND cloud_region <> 'us-east-1' THEN response_size_bytes * 4e-11 * intensity * pue ELSE 0.0 END AS transport_grams FROM sc
)
"""
HOSTS = {"supplier-svc": "us-east-1"}


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = normalized(spark, sf_dir)
    return n, d.detect_repeats(n, LIMITS.n_plus_one, LIMITS.window_ms)


def _found_once(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Findings for what reads them several times: they are few, so they are written, with what gates and waste read of them."""
    n, f = _found(spark, sf_dir)
    pattern = F.struct("pattern.template", "pattern.occurrences").alias("pattern")
    return n, written(f.select("type", "severity", "trace_id", "service", "source_endpoint", pattern), "findings")


def _r(c: str, digits: int = 9):
    return F.round(c, digits).alias(c)


@register("endpoint_stats", SPANS_SQL.rstrip() + _STATS)
def _endpoint_stats(spark, sf_dir):
    return s.endpoint_stats(order_spans(spark, sf_dir))


@register("avoidable_io_ops", _AVOID + "SELECT * FROM avoid")
def _avoidable(spark, sf_dir):
    return s.avoidable_io_ops(_found(spark, sf_dir)[1])


@register("io_waste", _AVOID + """
SELECT t.n AS total_io_ops, avoid.*, avoidable / t.n AS io_waste_ratio, CASE WHEN avoidable / t.n >= 0.5 THEN 'critical' WHEN avoidable / t.n >= 0.3 THEN 'high' WHEN avoidable / t.n >= 0.1 THEN 'moderate' ELSE 'healthy' END AS io_waste_band
FROM avoid, (SELECT count(*) AS n FROM normalized) t""")  # fmt: skip
def _waste(spark, sf_dir):
    n, f = _found(spark, sf_dir)
    return s.io_waste(n, f)


@register("enrich_findings_with_iis", _N1 + f""", st AS ({_STATS})
SELECT trace_id, template, n1.service, n1.source_endpoint, n - 1 AS extra_ops, io_intensity, CASE WHEN io_intensity >= 10 THEN 'critical' WHEN io_intensity >= 5 THEN 'high' WHEN io_intensity >= 2 THEN 'moderate' ELSE 'healthy' END AS band
FROM n1 JOIN st ON n1.service = st.service AND n1.source_endpoint = st.source_endpoint""")  # fmt: skip
def _iis(spark, sf_dir):
    n = normalized(spark, sf_dir)
    out = s.enrich_findings_with_iis(d.detect_n_plus_one(n, LIMITS.n_plus_one, LIMITS.window_ms), s.endpoint_stats(n))
    g = F.col("green_impact")
    return out.select("trace_id", F.col("pattern.template").alias("template"), "service", "source_endpoint", g["estimated_extra_io_ops"].alias("extra_ops"), g["io_intensity_score"].alias("io_intensity"), g["io_intensity_band"].alias("band"))


@register("top_offenders", SPANS_SQL.rstrip() + f", st AS ({_STATS}) SELECT *, io_ops * 1e-7 * 41.5 * 1.15 AS co2_grams FROM st ORDER BY io_intensity DESC, service, source_endpoint LIMIT 10")
def _offenders(spark, sf_dir):
    return s.top_offenders(s.endpoint_stats(order_spans(spark, sf_dir)), 10, "eu-west-3")


def _scored(spark, sf_dir, **context) -> DataFrame:
    return s.scored_spans(normalized(spark, sf_dir), host_regions=HOSTS, **context)


@register("span_carbon", SPANS_SQL.rstrip() + ", normalized2 AS (SELECT 1)" + _SCORED + "SELECT span_id, cloud_region AS region, round(energy_kwh * 1e9, 6) AS energy, round(co2_grams * 1e6, 6) AS co2, round(transport_grams * 1e6, 6) AS transport FROM scored")
def _span_carbon(spark, sf_dir):
    r = lambda c, k, n: F.round(F.col(c) * k, 6).alias(n)
    return _scored(spark, sf_dir).select("span_id", "region", r("energy_kwh", 1e9, "energy"), r("co2_grams", 1e6, "co2"), r("transport_grams", 1e6, "transport"))


@register("region_breakdown", SPANS_SQL.rstrip() + _SCORED + """
SELECT coalesce(cloud_region, 'unknown') AS region, count(*) AS io_ops, round(coalesce(sum(co2_grams), 0), 9) AS co2_grams, round(avg(intensity), 6) AS mean_intensity,
       CASE WHEN cloud_region IS NULL THEN 'none' ELSE 'annual' END AS intensity_source, CASE WHEN cloud_region IS NULL THEN 'unresolved' ELSE 'known' END AS status FROM scored GROUP BY cloud_region""")  # fmt: skip
def _regions(spark, sf_dir):
    return s.region_breakdown(_scored(spark, sf_dir)).select("region", "io_ops", _r("co2_grams"), _r("mean_intensity", 6), "intensity_source", "status")


@register("service_breakdown", SPANS_SQL.rstrip() + _SCORED + """
SELECT service, count(*) AS io_ops, round(sum(energy_kwh), 12) AS energy_kwh, round(coalesce(sum(co2_grams), 0), 9) AS co2_grams, arg_min(cloud_region, (ts_ms, trace_id, ord)) FILTER (WHERE cloud_region IS NOT NULL) AS region,
       'io_proxy' AS energy_model, CAST(0 AS DOUBLE) AS measured_ratio FROM scored GROUP BY service""")  # fmt: skip
def _services(spark, sf_dir):
    return s.service_breakdown(_scored(spark, sf_dir)).select("service", "io_ops", _r("energy_kwh", 12), _r("co2_grams"), "region", "energy_model", "measured_ratio")


@register("carbon_report", _AVOID.rstrip() + _SCORED + """, t AS (
  SELECT count(DISTINCT trace_id) AS traces, count(*) AS io_ops, count(cloud_region) AS accounted_ops, sum(co2_grams) AS op, sum(transport_grams) AS tr FROM scored
)
SELECT traces, io_ops, accounted_ops, avoidable, round(op, 9) AS operational_g, round(tr, 9) AS transport_g, round(traces * 0.001, 9) AS embodied_g, round(op + traces * 0.001 + tr, 9) AS total_g,
       round(op * least(avoidable / accounted_ops, 1.0), 9) AS avoidable_g, round((op + traces * 0.001 + tr) * 0.5, 9) AS low_g, round((op + traces * 0.001 + tr) * 2, 9) AS high_g, round((op + traces * 0.001 + tr) / traces, 12) AS g_per_trace, 'io_proxy_v1' AS model FROM t, avoid""")  # fmt: skip
def _carbon(spark, sf_dir):
    f = _found(spark, sf_dir)[1]
    out = s.carbon_report(_scored(spark, sf_dir), f)
    return out.select("traces", "io_ops", "accounted_ops", "avoidable", *(_r(c) for c in ("operational_g", "transport_g", "embodied_g", "total_g", "avoidable_g", "low_g", "high_g")), _r("g_per_trace", 12), "model")


@register("workload_waste", _AVOID.rstrip() + _SCORED + """
SELECT count(*) AS ops, any_value(avoidable_sql) AS avoidable, any_value(avoidable_sql) / count(*) AS ratio, round(sum(energy_kwh) * any_value(avoidable_sql) / count(*), 12) AS waste_kwh,
       round(sum(co2_grams) * any_value(avoidable_sql) / count(*), 9) AS waste_g, 'estimated' AS provenance FROM scored, avoid WHERE event_type = 'sql'""")  # fmt: skip
def _workload(spark, sf_dir):
    return s.workload_waste(_scored(spark, sf_dir), _found(spark, sf_dir)[1], "sql").select("ops", "avoidable", "ratio", _r("waste_kwh", 12), _r("waste_g"), "provenance")


_TIERS = _AVOID.rstrip() + _SCORED + """, cn1 AS (
  SELECT * FROM g WHERE n >= 2 AND window_ms <= 500 AND (event_type = 'messaging' OR dp >= 2 OR (event_type = 'http_out' AND cv > 500 AND n >= 3))
), cr AS (
  SELECT trace_id, template, min_by(endpoint, ord) AS source_endpoint, count(*) AS n FROM normalized
  WHERE event_type <> 'messaging' AND (trace_id, template) NOT IN (SELECT (trace_id, template) FROM cn1) GROUP BY trace_id, event_type, template, params HAVING count(*) >= 2
), cav AS (
  SELECT max(n) - 1 AS ops FROM (SELECT trace_id, template, source_endpoint, n FROM cn1 UNION ALL SELECT * FROM cr) GROUP BY trace_id, template, source_endpoint
), both_tiers AS (
  SELECT 'canonical' AS tier, CAST(sum(ops) AS BIGINT) AS avoidable FROM cav UNION ALL SELECT 'operational', avoidable FROM avoid
), tot AS (
  SELECT count(*) AS ops, sum(energy_kwh) AS kwh, sum(co2_grams) AS g FROM scored
), tiers AS (
  SELECT tier, ops AS io_ops, avoidable, least(avoidable / ops, 1.0) AS ratio, round(kwh * least(avoidable / ops, 1.0), 12) AS avoidable_kwh, round(tot.g * least(avoidable / ops, 1.0), 9) AS avoidable_g FROM both_tiers, tot
)
"""


def _both_tiers(spark, sf_dir) -> DataFrame:
    tiers = s.canonical_tiers(normalized(spark, sf_dir), _scored(spark, sf_dir), LIMITS.n_plus_one, LIMITS.window_ms)
    return tiers.select("tier", "io_ops", "avoidable", "ratio", _r("avoidable_kwh", 12), _r("avoidable_g"))


@register("canonical_tiers", _TIERS + "SELECT tier, avoidable, ratio, avoidable_kwh, avoidable_g FROM tiers")
def _tiers(spark, sf_dir):
    return _both_tiers(spark, sf_dir).select("tier", "avoidable", "ratio", "avoidable_kwh", "avoidable_g")


@register("green_summary", _AVOID.rstrip() + _SCORED + """, t AS (
  SELECT count(DISTINCT trace_id) AS traces, count(*) AS io_ops, count(cloud_region) AS accounted_ops, sum(co2_grams) AS op, sum(transport_grams) AS tr FROM scored
), m AS (SELECT *, op + traces * 0.001 + tr AS total, avoidable / io_ops AS r FROM t, avoid)
SELECT io_ops AS total_io_ops, avoidable, avoidable_sql, avoidable_messaging, r AS io_waste_ratio, CASE WHEN r >= 0.5 THEN 'critical' WHEN r >= 0.3 THEN 'high' WHEN r >= 0.1 THEN 'moderate' ELSE 'healthy' END AS io_waste_band,
       traces, accounted_ops, round(op, 9) AS operational_g, round(tr, 9) AS transport_g, round(traces * 0.001, 9) AS embodied_g, round(total, 9) AS total_g, round(op * least(avoidable / accounted_ops, 1.0), 9) AS avoidable_g,
       round(total / traces, 12) AS g_per_trace, round(total * 0.5, 9) AS low_g, round(total * 2, 9) AS high_g, 'io_proxy_v1' AS model FROM m""")  # fmt: skip
def _summary(spark, sf_dir):
    n, f = _found(spark, sf_dir)
    totals = s.green_summary(n, f, host_regions=HOSTS).totals
    rounded = {c: F.round(c, 12 if c == "g_per_trace" else 9) for c in totals.columns if c.startswith("g_") or c.endswith("_g")}
    return totals.withColumns(rounded)


def _events(spark, sf_dir) -> DataFrame:
    """Energy samples from the events: one a row, of eight services."""
    (events,) = read_tables(spark, sf_dir, "events")
    return events.select(F.concat(F.lit("svc-"), F.col("user_id") % 8).alias("service"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.abs("value").alias("watts"), F.col("event_id").alias("id"))


_EVENTS = "WITH p AS (SELECT 'svc-' || (user_id % 8) AS service, epoch_us(ts) // 1000 AS ts_ms, abs(value) AS watts, event_id AS id FROM events)"
_HOUR = ", h AS (SELECT service, ts_ms // 3600000 * 3600000 AS ts_ms, count(*) AS ops, avg(watts) AS watts, sum(watts) AS total FROM p GROUP BY ALL)"


def _hourly(spark, sf_dir) -> DataFrame:
    p = _events(spark, sf_dir)
    hour = (F.floor(F.col("ts_ms") / 3_600_000) * 3_600_000).cast("long").alias("ts_ms")
    return p.groupBy("service", hour).agg(F.count(F.lit(1)).alias("ops"), F.avg("watts").alias("watts"), F.sum("watts").alias("total"))


@register("ops_per_interval", SPANS_SQL.rstrip() + " SELECT service, ts_ms // 60000 * 60000 AS ts_ms, count(*) AS ops FROM spans GROUP BY ALL")
def _ops(spark, sf_dir):
    return e.ops_per_interval(order_spans(spark, sf_dir), 60)


@register("attribute_counter_joules", _EVENTS + _HOUR + """, c AS (SELECT *, sum(total) OVER (PARTITION BY service ORDER BY ts_ms) AS joules FROM h), l AS (SELECT *, joules - lag(joules) OVER (PARTITION BY service ORDER BY ts_ms) AS delta FROM c)
SELECT service, ts_ms, round(delta / 3.6e6 / ops, 12) AS kwh_per_op, 'kepler_ebpf' AS backend FROM l WHERE delta > 0""")  # fmt: skip
def _counter(spark, sf_dir):
    from pyspark.sql import Window

    h = _hourly(spark, sf_dir)
    c = h.withColumn("joules", F.sum("total").over(Window.partitionBy("service").orderBy("ts_ms")))
    return e.attribute_counter_joules(c.select("service", "ts_ms", "joules"), h.select("service", "ts_ms", "ops")).select("service", "ts_ms", _r("kwh_per_op", 12), "backend")


@register("attribute_interval_joules", _EVENTS + _HOUR + " SELECT service, ts_ms, round(total / 60 * 3600 / 3.6e6 / ops, 12) AS kwh_per_op, 'alumet_rapl' AS backend FROM h")
def _interval(spark, sf_dir):
    h = _hourly(spark, sf_dir)
    return e.attribute_interval_joules(h.select("service", "ts_ms", F.col("total").alias("joules")), h.select("service", "ts_ms", "ops"), 60, 3600).select("service", "ts_ms", _r("kwh_per_op", 12), "backend")


@register("attribute_chassis_power", _EVENTS + _HOUR + """, c AS (SELECT *, CAST(substr(service, 5) AS INTEGER) % 2 AS chassis FROM h), w AS (SELECT chassis, ts_ms, max(watts) AS cw, sum(ops) AS all_ops FROM c GROUP BY ALL)
SELECT c.service, c.ts_ms, round(cw * 3600 / 3.6e6 / all_ops, 12) AS kwh_per_op, 'redfish_bmc' AS backend FROM c JOIN w ON c.chassis = w.chassis AND c.ts_ms = w.ts_ms""")  # fmt: skip
def _chassis(spark, sf_dir):
    h = _hourly(spark, sf_dir).withColumn("chassis", F.substring("service", 5, 9).cast("int") % 2)
    watts = h.groupBy("chassis", "ts_ms").agg(F.max("watts").alias("watts"))
    return e.attribute_chassis_power(watts, h.select("chassis", "service").distinct(), h.select("service", "ts_ms", "ops"), 3600).select("service", "ts_ms", _r("kwh_per_op", 12), "backend")


@register("attribute_cpu_power", _EVENTS + _HOUR + """
SELECT service, ts_ms, round((2.8 + (16.3 - 2.8) * least(greatest(watts, 0), 100) / 100) * 3600 / 3.6e6 / ops, 12) AS kwh_per_op, 'cloud_specpower' AS backend FROM h""")  # fmt: skip
def _cpu(spark, sf_dir):
    h = _hourly(spark, sf_dir)
    cpu = h.select("service", "ts_ms", F.lit("m5.xlarge").alias("instance_type"), F.lit("aws").alias("provider"), F.col("watts").alias("cpu_percent"))
    return e.attribute_cpu_power(cpu, h.select("service", "ts_ms", "ops"), 3600).select("service", "ts_ms", _r("kwh_per_op", 12), "backend")


#: A rule for each service; that of svc-3 fits every process, so it counts only in an hour with one.
_RULES = [(f"svc-{i}", "/svc-" if i == 3 else f"/svc-{i}") for i in range(8)]


@register("attribute_process_power", _EVENTS + _HOUR + f""", rl(service, part) AS (VALUES {", ".join(map(str, _RULES))}),
m AS (SELECT rl.service, h.ts_ms, max(total) AS uw FROM h JOIN rl ON contains('/bin/' || h.service, part) GROUP BY ALL HAVING count(*) = 1)
SELECT m.service, m.ts_ms, round(uw / 1e6 * 3600 / 3.6e6 / ops, 15) AS kwh_per_op, 'scaphandre_rapl' AS backend FROM m JOIN h ON m.service = h.service AND m.ts_ms = h.ts_ms""")
def _process(spark, sf_dir):
    h = _hourly(spark, sf_dir)
    power = h.select("ts_ms", F.concat(F.lit("/bin/"), "service").alias("exe"), F.lit("").alias("cmdline"), F.col("total").alias("microwatts"))
    rules = spark.createDataFrame([(service, part, None) for service, part in _RULES], "service string, exe_part string, cmdline_part string")
    return e.attribute_process_power(power, rules, h.select("service", "ts_ms", "ops"), 3600).select("service", "ts_ms", _r("kwh_per_op", 15), "backend")


@register("measured_energy_snapshot", _EVENTS + _HOUR + """, m AS (SELECT service, ts_ms, round(total, 9) AS kwh_per_op, CASE WHEN ops % 2 = 0 THEN 'kepler_ebpf' ELSE 'redfish_bmc' END AS backend FROM h), t AS (SELECT max(ts_ms) AS now FROM m)
SELECT service, ts_ms, kwh_per_op, backend FROM m, t WHERE now - ts_ms <= 86400000 QUALIFY row_number() OVER (PARTITION BY service ORDER BY backend, ts_ms DESC, kwh_per_op) = 1""")  # fmt: skip
def _snapshot(spark, sf_dir):
    h = _hourly(spark, sf_dir)
    rows = h.select("service", "ts_ms", F.round("total", 9).alias("kwh_per_op"), F.when(F.col("ops") % 2 == 0, "kepler_ebpf").otherwise("redfish_bmc").alias("backend"))
    now = rows.agg(F.max("ts_ms")).first()[0] or 0
    return e.measured_energy_snapshot(rows, now, 86_400_000)


@register("asof_grid_intensity", _EVENTS + """, q AS (SELECT service AS region, ts_ms, id FROM p WHERE id % 2 = 0), r AS (SELECT service AS region, ts_ms, max(watts) AS intensity, max(watts) > 50 AS estimated FROM p WHERE id % 2 = 1 GROUP BY ALL)
SELECT q.id, q.region, q.ts_ms, CASE WHEN q.ts_ms - r.ts_ms <= 3600000 THEN intensity END AS intensity, CASE WHEN q.ts_ms - r.ts_ms <= 3600000 THEN estimated END AS estimated FROM q ASOF LEFT JOIN r ON q.region = r.region AND q.ts_ms >= r.ts_ms""")  # fmt: skip
def _asof(spark, sf_dir):
    p = _events(spark, sf_dir)
    points = p.filter("id % 2 = 0").select("id", F.col("service").alias("region"), "ts_ms")
    readings = p.filter("id % 2 = 1").groupBy(F.col("service").alias("region"), "ts_ms").agg(F.max("watts").alias("intensity"), (F.max("watts") > 50).alias("estimated"))
    return e.asof_grid_intensity(points, readings, 3_600_000).select("id", "region", "ts_ms", "intensity", "estimated")


@register("power_to_energy", _EVENTS + """, u AS (SELECT service, ts_ms, max(watts) AS watts FROM p GROUP BY ALL), l AS (SELECT *, lag(ts_ms) OVER w AS t0, lag(watts) OVER w AS w0 FROM u WINDOW w AS (PARTITION BY service ORDER BY ts_ms))
SELECT service, ts_ms, round((w0 + watts) / 2 * ((ts_ms - t0) / 1000) / 3.6e6, 15) AS kwh FROM l WHERE t0 IS NOT NULL""")  # fmt: skip
def _trapezoid(spark, sf_dir):
    u = _events(spark, sf_dir).groupBy("service", "ts_ms").agg(F.max("watts").alias("watts"))
    return e.power_to_energy(u).select("service", "ts_ms", _r("kwh", 15))


_CAL = SPANS_SQL.rstrip() + """, rd AS (SELECT 'svc-' || (user_id % 8) AS service, 1752156000000 + (epoch_us(ts) // 1000 % 43200000) AS ts_ms, abs(value) / 1000 AS kwh FROM events), b AS (SELECT min(ts_ms) AS lo, max(ts_ms) AS hi FROM rd),
o AS (SELECT service, count(*) AS ops FROM spans, b WHERE ts_ms BETWEEN lo AND hi GROUP BY service), k AS (SELECT service, sum(kwh) AS kwh FROM rd GROUP BY service) """  # fmt: skip


def _factors(spark, sf_dir) -> DataFrame:
    readings = _events(spark, sf_dir).select("service", (F.lit(1_752_156_000_000) + F.col("ts_ms") % 43_200_000).alias("ts_ms"), (F.col("watts") / 1000).alias("kwh"))
    return e.calibrate(order_spans(spark, sf_dir), readings)


@register("calibrate", _CAL + "SELECT k.service, round(kwh, 9) AS kwh, ops, round(kwh / ops / 1e-7, 3) AS factor FROM k JOIN o ON k.service = o.service")
def _calibrate(spark, sf_dir):
    return _factors(spark, sf_dir).select("service", _r("kwh"), "ops", _r("factor", 3))


@register("validate_calibration", _CAL + "SELECT k.service, round(kwh, 9) AS kwh, ops, round(kwh / ops / 1e-7, 3) AS factor FROM k JOIN o ON k.service = o.service WHERE kwh / ops / 1e-7 > 10 OR kwh / ops / 1e-7 > 0 AND kwh / ops / 1e-7 < 0.1")
def _validate(spark, sf_dir):
    return e.validate_calibration(_factors(spark, sf_dir)).select("service", _r("kwh"), "ops", _r("factor", 3))


@register("declared_cluster_energy", _EVENTS + _HOUR + """, tk AS (SELECT ts_ms, max(CASE WHEN ops > 3 THEN total / 1000 END) AS measured FROM h GROUP BY ts_ms), l AS (
  SELECT *, last_value(CASE WHEN measured IS NOT NULL THEN ts_ms END IGNORE NULLS) OVER (ORDER BY ts_ms ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_ms, least(greatest((ts_ms - lag(ts_ms) OVER (ORDER BY ts_ms)) / 1000, 1.0), 3600.0) AS elapsed_s FROM tk
), m AS (SELECT *, coalesce(ts_ms - last_ms <= 7200000, false) AS recent FROM l)
SELECT ts_ms, round(measured, 9) AS measured_kwh, elapsed_s, round(coalesce(measured, CASE WHEN NOT recent THEN elapsed_s * 750 / 3.6e6 END), 9) AS kwh,
       CASE WHEN measured IS NOT NULL THEN 'measured' WHEN NOT recent THEN 'declared' END AS provenance FROM m""")  # fmt: skip
def _declared(spark, sf_dir):
    ticks = _hourly(spark, sf_dir).groupBy("ts_ms").agg(F.max(F.when(F.col("ops") > 3, F.col("total") / 1000)).alias("measured_kwh"))
    return e.declared_cluster_energy(ticks, 3, 250.0, 7_200_000).select("ts_ms", _r("measured_kwh"), "elapsed_s", _r("kwh"), "provenance")


@register("quality_gate", _AVOID + """, c AS (SELECT CAST(count(*) FILTER (WHERE event_type = 'sql' AND n >= 10) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE event_type = 'http_out') AS DOUBLE) AS b, CAST(count(*) FILTER (WHERE event_type = 'messaging') AS DOUBLE) AS m FROM n1),
w AS (SELECT avoidable / (SELECT count(*) FROM normalized) AS r FROM avoid)
SELECT 'n_plus_one_sql_critical_max' AS rule, CAST(0 AS DOUBLE) AS threshold, a AS actual, a <= 0 AS passed FROM c UNION ALL SELECT 'n_plus_one_http_warning_max', 3, b, b <= 3 FROM c
UNION ALL SELECT 'n_plus_one_messaging_warning_max', 3, m, m <= 3 FROM c UNION ALL SELECT 'io_waste_ratio_max', 0.3, r, r <= 0.3 FROM w""")  # fmt: skip
def _gate(spark, sf_dir):
    n, f = _found_once(spark, sf_dir)
    return reports.quality_gate(f, s.io_waste(n, f))


def _runs(spark, sf_dir, slow_ms: float = LIMITS.slow_ms) -> tuple[DataFrame, DataFrame]:
    """Findings of orders with odd and with even keys, as the runs before and after."""
    n = normalized(spark, sf_dir)
    odd = F.substring("trace_id", 2, 20).cast("long") % 2 == 1
    found = d.detect_slow(n, slow_ms, LIMITS.slow_min)
    return found.filter(odd), found.filter(~odd)


_DIFF = SPANS_SQL.rstrip() + """, sl AS (
  SELECT CAST(substr(trace_id, 2) AS BIGINT) % 2 AS odd, 'slow_' || CASE event_type WHEN 'http_out' THEN 'http' ELSE event_type END AS type, min_by(service, ord) AS service, min_by(endpoint, ord) AS source_endpoint, template,
    CASE WHEN max(duration_us) > 125000 THEN 1 ELSE 2 END AS sev, count(*) AS n FROM normalized WHERE duration_us > 25000 GROUP BY trace_id, event_type, template HAVING count(*) >= 3
), i AS (SELECT odd, type, service, source_endpoint, template, min(sev) AS sev, sum(n) AS n FROM sl GROUP BY ALL),
d AS (SELECT coalesce(a.type, b.type) AS type, coalesce(a.service, b.service) AS service, coalesce(a.source_endpoint, b.source_endpoint) AS source_endpoint, coalesce(a.template, b.template) AS template, CAST(a.n AS BIGINT) AS occurrences_before, CAST(b.n AS BIGINT) AS occurrences_after,
  CASE WHEN a.type IS NULL THEN 'new' WHEN b.type IS NULL THEN 'resolved' WHEN b.sev < a.sev THEN 'regressed' WHEN b.sev > a.sev THEN 'improved' ELSE 'same' END AS change
  FROM (SELECT * FROM i WHERE odd = 1) a FULL JOIN (SELECT * FROM i WHERE odd = 0) b ON a.type = b.type AND a.service = b.service AND a.source_endpoint = b.source_endpoint AND a.template = b.template)
"""


def _changes(df: DataFrame) -> DataFrame:
    return df.select("type", "service", "source_endpoint", "template", "occurrences_before", "occurrences_after", "change")


@register("compared_findings", _DIFF + "SELECT * FROM d")
def _compared(spark, sf_dir):
    return _changes(reports.compared_findings(*_runs(spark, sf_dir)))


@register("diff_findings", _DIFF + "SELECT * FROM d WHERE change IN ('new', 'resolved')")
def _diff(spark, sf_dir):
    return _changes(reports.diff_findings(*_runs(spark, sf_dir)))


@register("severity_changes", _DIFF.replace("> 125000", "> 49500").replace("> 25000", "> 9900") + "SELECT * FROM d WHERE change IN ('regressed', 'improved')")
def _severity(spark, sf_dir):
    """With a limit of 9.9 ms only the longest calls are critical, so some identities are so in one run alone."""
    return _changes(reports.severity_changes(*_runs(spark, sf_dir, 9.9)))


@register("endpoint_deltas", SPANS_SQL.rstrip() + """, c AS (SELECT service, endpoint AS source_endpoint, count(*) FILTER (WHERE l_orderkey % 2 = 1) AS ops_before, count(*) FILTER (WHERE l_orderkey % 2 = 0) AS ops_after FROM spans GROUP BY ALL)
SELECT *, ops_after - ops_before AS delta FROM c WHERE ops_after <> ops_before""")  # fmt: skip
def _deltas(spark, sf_dir):
    spans = order_spans(spark, sf_dir)
    odd = F.substring("trace_id", 2, 20).cast("long") % 2 == 1
    return reports.endpoint_deltas(s.endpoint_stats(spans.filter(odd)), s.endpoint_stats(spans.filter(~odd)))


def _signed(spark, sf_dir, maximum: int = LIMITS.fanout) -> DataFrame:
    return reports.finding_signature(reports.stamp_confidence(d.detect_fanout(normalized(spark, sf_dir), maximum)))


_SIGNED = SPANS_SQL.rstrip() + """, c AS (SELECT trace_id, parent_span_id, count(*) AS n, min(ts_ms) AS lo, max(ts_ms) AS hi FROM normalized WHERE parent_span_id IS NOT NULL GROUP BY ALL HAVING count(*) > 8), sg AS (
  SELECT c.trace_id, c.n, lo, hi, service, endpoint, 'excessive_fanout:' || service || ':' || translate(endpoint, '/ ', '__') || ':' || substr(sha256(template), 1, 32) AS signature FROM c JOIN normalized p ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id)
"""


@register("finding_signature", _SIGNED + "SELECT trace_id, signature FROM sg")
def _signature(spark, sf_dir):
    return _signed(spark, sf_dir).select("trace_id", "signature")


def _number(signature):
    """A number of a signature that SQL can form as well."""
    return F.conv(F.substring(F.sha2(signature, 256), 1, 6), 16, 10).cast("int")


def _acks(signed: DataFrame) -> DataFrame:
    """Every third signature is acknowledged, some no longer."""
    own = signed.select("signature", "service", F.col("source_endpoint").alias("endpoint")).distinct().filter(_number("signature") % 3 == 0)
    return own.withColumn("expires_at", F.when(_number("signature") % 2 == 0, "2025-01-01").otherwise("2027-01-01"))


_ACKS = _SIGNED.rstrip() + """, num AS (SELECT *, CAST('0x' || substr(sha256(signature), 1, 6) AS INTEGER) AS k FROM sg),
ack AS (SELECT DISTINCT signature, service, endpoint, CASE WHEN k % 2 = 0 THEN '2025-01-01' ELSE '2027-01-01' END AS expires_at, k FROM num WHERE k % 3 = 0)
"""


@register("apply_acknowledgments", _ACKS + "SELECT signature, trace_id, k % 3 = 0 AND k % 2 = 1 AS acknowledged FROM num")
def _apply(spark, sf_dir):
    signed = _signed(spark, sf_dir)
    left, done = reports.apply_acknowledgments(signed, _acks(signed), "2026-01-01")
    return left.select("signature", "trace_id", F.lit(False).alias("acknowledged")).unionByName(done.select("signature", "trace_id", F.lit(True).alias("acknowledged")))


@register("unmatched_acknowledgments", _ACKS + "SELECT signature, service, endpoint, expires_at, 'likely_fixed' AS status FROM ack WHERE k % 2 = 1 AND k % 9 = 3")
def _unmatched(spark, sf_dir):
    signed = _signed(spark, sf_dir)
    return reports.unmatched_acknowledgments(signed.filter(_number("signature") % 9 != 3), _acks(signed), "2026-01-01", s.endpoint_stats(order_spans(spark, sf_dir)))


_ISO = "strftime(epoch_ms({}), '%Y-%m-%dT%H:%M:%S.%gZ')"


@register("coalesce_findings", _SIGNED.rstrip() + f""" SELECT '' AS gk, '' AS gv, signature, count(*) AS seen_count, {_ISO.format("min(lo)")} AS first_seen, {_ISO.format("max(hi)")} AS last_seen,
CASE WHEN bool_or(n > 24) THEN 'critical' ELSE 'warning' END AS severity FROM sg GROUP BY signature""")
def _coalesce(spark, sf_dir):
    signed = _signed(spark, sf_dir)
    stored = signed.select("signature", F.lit("").alias("gk"), F.lit("").alias("gv"), "severity", F.lit(1).cast("long").alias("seen_count"), F.col("first_timestamp").alias("first_seen"), F.col("last_timestamp").alias("last_seen"))
    return reports.coalesce_findings(stored)


@register("query_findings", _SIGNED.replace("sg AS (", "sg0 AS (") + "SELECT 'excessive_fanout' AS type, p.trace_id, n AS occurrences FROM c JOIN normalized p ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id WHERE service = 'svc-1'")
def _query(spark, sf_dir):
    found = reports.query_findings(_signed(spark, sf_dir), service="svc-1", kind="excessive_fanout")
    return found.select("type", "trace_id", F.col("pattern.occurrences").alias("occurrences"))


@register("explain_tree", SPANS_SQL.rstrip() + " SELECT trace_id, span_id, CASE WHEN parent_span_id IS NULL THEN 0 ELSE 1 END AS depth, coalesce(parent_span_id || '/', '') || span_id AS path FROM spans")
def _tree(spark, sf_dir):
    n = normalized(spark, sf_dir)
    return reports.explain_tree(n, d.detect_fanout(n, LIMITS.fanout)).select("trace_id", "span_id", "depth", F.array_join("path", "/").alias("path"))


def _statements(spark, sf_dir) -> DataFrame:
    """Statement statistics of the derived spans: one row a statement and kind of part."""
    n = normalized(spark, sf_dir).filter("event_type = 'sql'")
    part = F.regexp_extract("target", r"p_partkey = (\d+)", 1).cast("long") % 50
    return n.groupBy(F.concat("template", F.lit(" /* "), part.cast("string"), F.lit(" */")).alias("query"), "template").agg(
        F.count(F.lit(1)).alias("calls"), (F.sum("duration_us") / 1000).alias("total_exec_time_ms"), (F.avg("duration_us") / 1000).alias("mean_exec_time_ms"), F.sum("response_size_bytes").alias("shared_blks_hit"), F.max("response_size_bytes").alias("shared_blks_read"), F.min("duration_us").alias("rows_examined")
    )


_STMT = SPANS_SQL.rstrip() + """, st AS (SELECT template || ' /* ' || (CAST(regexp_extract(target, 'p_partkey = ([0-9]+)', 1) AS BIGINT) % 50) || ' */' AS query, count(*) AS calls, sum(duration_us) / 1000 AS total, avg(duration_us) / 1000 AS mean,
  sum(response_size_bytes) + max(response_size_bytes) AS blocks, min(duration_us) AS examined FROM normalized WHERE event_type = 'sql' GROUP BY ALL), k AS (
  SELECT 'total_time' AS ranking, query, total AS v FROM st UNION ALL SELECT 'calls', query, calls FROM st UNION ALL SELECT 'mean_time', query, mean FROM st UNION ALL SELECT '{last}', query, {column} FROM st)
SELECT ranking, query, row_number() OVER (PARTITION BY ranking ORDER BY v DESC, query) AS rank FROM k QUALIFY rank <= 10"""  # fmt: skip


@register("rank_pg_statements", _STMT.replace("{last}", "io_blocks").replace("{column}", "blocks"))
def _pg(spark, sf_dir):
    return reports.rank_pg_statements(_statements(spark, sf_dir), 10).select("ranking", "query", "rank")


@register("rank_mysql_digests", _STMT.replace("{last}", "rows_examined").replace("{column}", "examined"))
def _mysql(spark, sf_dir):
    return reports.rank_mysql_digests(_statements(spark, sf_dir), 10).select("ranking", "query", "rank")


@register("cross_reference_pg", _AVOID + "SELECT template, count(*) AS spans, template IN (SELECT template FROM f) AS seen_in_traces FROM normalized GROUP BY template")
def _xref(spark, sf_dir):
    n, f = _found(spark, sf_dir)
    stats = n.groupBy("template").agg(F.count(F.lit(1)).alias("spans"))
    return reports.cross_reference_pg(stats, f)


@register("cross_reference_mysql", _AVOID + "SELECT template, count(*) AS spans, template IN (SELECT template FROM f) AS seen_in_traces FROM normalized WHERE event_type = 'sql' GROUP BY template")
def _xref_mysql(spark, sf_dir):
    n, f = _found(spark, sf_dir)
    digests = n.filter("event_type = 'sql'").groupBy("template").agg(F.count(F.lit(1)).alias("spans")).withColumn("digest", F.regexp_replace(F.regexp_replace("template", r"\bpart\b", "`part`"), "=", " = "))
    return reports.cross_reference_mysql(digests.withColumnsRenamed({"template": "plain", "digest": "template"}), f).select(F.col("plain").alias("template"), "spans", "seen_in_traces")


@register("evidence_traces", _SIGNED.rstrip() + """, sz AS (SELECT trace_id, max(ts_ms) AS newest, sum(octet_length(CAST(target AS BLOB)) + octet_length(CAST(span_id AS BLOB)) + 64) AS bytes FROM spans WHERE trace_id IN (SELECT trace_id FROM c) GROUP BY trace_id),
tt AS (SELECT trace_id, sum(bytes) OVER (ORDER BY newest DESC, trace_id ROWS UNBOUNDED PRECEDING) AS total FROM sz)
SELECT trace_id, span_id FROM spans WHERE trace_id IN (SELECT trace_id FROM tt WHERE total <= 50000)""")
def _evidence(spark, sf_dir):
    n = normalized(spark, sf_dir)
    return reports.evidence_traces(n, d.detect_fanout(n, LIMITS.fanout), 50_000).select("trace_id", "span_id")


_FAN = ", c AS (SELECT trace_id, parent_span_id, count(*) AS n FROM normalized WHERE parent_span_id IS NOT NULL GROUP BY ALL HAVING count(*) > 8)"


@register("metrics_rollup", _AVOID.rstrip() + _FAN + """
SELECT 'findings' AS metric, 'excessive_fanout' AS label, CASE WHEN n > 24 THEN 'critical' ELSE 'warning' END AS kind, CAST(count(*) AS DOUBLE) AS value FROM c GROUP BY ALL
UNION ALL SELECT 'io_ops', service, '', count(*) FROM spans GROUP BY ALL
UNION ALL SELECT 'slow_duration_bucket', CAST(le AS VARCHAR), event_type, count(*) FROM spans, (VALUES (100), (250), (500), (1000), (2500), (5000), (10000)) t(le) WHERE duration_us > 25000 AND duration_us <= le * 1000 GROUP BY le, event_type
UNION ALL SELECT 'io_ops_total', '', '', count(*) FROM spans UNION ALL SELECT 'avoidable_io_ops_total', '', '', avoidable FROM avoid
UNION ALL SELECT 'io_waste_ratio', '', '', avoidable / (SELECT count(*) FROM spans) FROM avoid""")  # fmt: skip
def _metrics(spark, sf_dir):
    n, f = _found(spark, sf_dir)
    return reports.metrics_rollup(n, d.detect_fanout(n, LIMITS.fanout), 25, waste=s.io_waste(n, f))


@register("gate_after_acknowledgments", _AVOID.rstrip() + """, nk AS (
  SELECT event_type, n, CAST('0x' || substr(sha256('n_plus_one_' || CASE event_type WHEN 'http_out' THEN 'http' ELSE event_type END || ':' || service || ':' || translate(source_endpoint, '/ ', '__') || ':' || substr(sha256(template), 1, 32)), 1, 6) AS INTEGER) AS k FROM n1
), op AS (SELECT * FROM nk WHERE NOT (k % 3 = 0 AND k % 2 = 1)),
c AS (SELECT CAST(count(*) FILTER (WHERE event_type = 'sql' AND n >= 10) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE event_type = 'http_out') AS DOUBLE) AS b, CAST(count(*) FILTER (WHERE event_type = 'messaging') AS DOUBLE) AS m FROM op),
w AS (SELECT avoidable / (SELECT count(*) FROM normalized) AS r FROM avoid)
SELECT 'n_plus_one_sql_critical_max' AS rule, CAST(0 AS DOUBLE) AS threshold, a AS actual, a <= 0 AS passed FROM c UNION ALL SELECT 'n_plus_one_http_warning_max', 3, b, b <= 3 FROM c
UNION ALL SELECT 'n_plus_one_messaging_warning_max', 3, m, m <= 3 FROM c UNION ALL SELECT 'io_waste_ratio_max', 0.3, r, r <= 0.3 FROM w""")  # fmt: skip
def _gate_open(spark, sf_dir):
    n, f = _found_once(spark, sf_dir)
    signed = reports.finding_signature(f)
    return reports.gate_after_acknowledgments(signed, _acks(signed), "2026-01-01", s.io_waste(n, f))


@register("query_coalesced", _SIGNED.replace("> 8)", "> 3)").rstrip() + " SELECT signature, count(*) AS seen_count FROM sg GROUP BY signature HAVING bool_or(n > 9)")
def _query_coalesced(spark, sf_dir):
    """Parents of more than three children, critical from ten on: a signature is as severe as its worst finding."""
    signed = _signed(spark, sf_dir, 3)
    stored = signed.select("signature", F.lit("").alias("gk"), F.lit("").alias("gv"), "severity", F.lit(1).cast("long").alias("seen_count"), F.col("first_timestamp").alias("first_seen"), F.col("last_timestamp").alias("last_seen"))
    return reports.query_coalesced(stored, "critical").select("signature", "seen_count")


@register("sarif_results", _SIGNED.rstrip() + """ SELECT 'excessive_fanout' AS "ruleId", CASE WHEN n > 24 THEN 'error' ELSE 'warning' END AS level, CAST(30 AS DOUBLE) AS rank,
'excessive_fanout in ' || endpoint || ' of ' || service || ' (' || n || ' times): Bundle the children of one operation, or bound how many start at once.' AS text, signature FROM sg""")
def _sarif(spark, sf_dir):
    return reports.sarif_results(_signed(spark, sf_dir)).select("ruleId", "level", "rank", F.col("message.text").alias("text"), F.col("partialFingerprints.findingSignature").alias("signature"))


def _windows(spark, sf_dir) -> DataFrame:
    """Hourly windows of the derived spans as an archive: a file for each day of three hours."""
    spans = s.scored_spans(order_spans(spark, sf_dir), host_regions=HOSTS)
    hour = (F.floor(F.col("ts_ms") / 3_600_000) * 3_600_000).cast("long")
    by = spans.groupBy(hour.alias("ts_ms"), "service").agg(F.count(F.lit(1)).alias("io_ops"), F.countDistinct("trace_id").alias("requests"), F.sum("energy_kwh").alias("kwh"), F.coalesce(F.sum("co2_grams"), F.lit(0.0)).alias("g"), F.sum("transport_grams").alias("t"))
    runtime = F.col("service").isin("svc-0", "svc-1") & (F.col("ts_ms") % 7_200_000 == 0)
    own = F.struct("service", "io_ops", F.when(runtime, F.col("kwh")).alias("energy_kwh"), F.when(runtime, F.col("g")).alias("co2_g"), F.when(runtime, 1.0).otherwise(0.0).alias("measured_ratio"))
    out = by.groupBy("ts_ms").agg(F.sum("requests").alias("requests"), F.sum("io_ops").alias("io_ops"), F.sum("kwh").alias("energy_kwh"), F.sum("g").alias("operational_g"), (F.sum("requests") * 0.001).alias("embodied_g"), F.sum("t").alias("transport_g"), F.sort_array(F.collect_list(own)).alias("per_service"))
    return out.withColumns({"file": F.concat(F.lit("f"), F.floor(F.col("ts_ms") / 10_800_000).cast("string")), "line": F.col("ts_ms"), "models": F.array(F.lit("io_proxy_v1+cal"), F.lit("io_proxy_v1"))})


_PERIOD = ("2025-07-10", "2025-07-12")
_WIN = SPANS_SQL.rstrip() + ", normalized3 AS (SELECT 1)" + _SCORED + """, bs AS (SELECT ts_ms // 3600000 * 3600000 AS ts_ms, service, count(*) AS io_ops, count(DISTINCT trace_id) AS requests, sum(energy_kwh) AS kwh, coalesce(sum(co2_grams), 0) AS g, sum(transport_grams) AS t FROM scored GROUP BY ALL),
win AS (SELECT ts_ms, sum(requests) AS requests, sum(io_ops) AS io_ops, sum(kwh) AS kwh, sum(g) AS g, sum(requests) * 0.001 AS emb, sum(t) AS t FROM bs GROUP BY ALL) """  # fmt: skip


@register("period_totals", _WIN + "SELECT count(*) AS windows, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(io_ops) AS BIGINT) AS io_ops, round(sum(kwh), 12) AS energy_kwh, round(sum(g + emb + t) / 1000, 9) AS carbon_kg FROM win")
def _totals(spark, sf_dir):
    return periodic.period_totals(periodic.windows_in_period(_windows(spark, sf_dir), *_PERIOD)).select("windows", "requests", "io_ops", _r("energy_kwh", 12), _r("carbon_kg"))


@register("archive_time_range", _WIN + "SELECT min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM win")
def _range(spark, sf_dir):
    return periodic.archive_time_range(_windows(spark, sf_dir))


@register("attribute_services", _WIN + """, a AS (SELECT bs.service, round(win.requests * bs.io_ops / win.io_ops) AS rq, bs.io_ops,
  CASE WHEN bs.ts_ms % 7200000 = 0 THEN CASE WHEN bs.service IN ('svc-0', 'svc-1') THEN bs.kwh ELSE 0 END ELSE win.kwh * bs.io_ops / win.io_ops END AS kwh, CASE WHEN bs.ts_ms % 7200000 = 0 THEN CASE WHEN bs.service IN ('svc-0', 'svc-1') THEN bs.g ELSE 0 END ELSE win.g * bs.io_ops / win.io_ops END AS g FROM bs JOIN win ON bs.ts_ms = win.ts_ms)
SELECT service, CAST(sum(rq) AS BIGINT) AS requests, CAST(sum(io_ops) AS BIGINT) AS io_ops, round(sum(kwh), 12) AS energy_kwh, round(sum(g), 9) AS co2_g FROM a GROUP BY service""")  # fmt: skip
def _attribute(spark, sf_dir):
    return periodic.attribute_services(_windows(spark, sf_dir)).select("service", "requests", "io_ops", _r("energy_kwh", 12), _r("co2_g"))


@register("antipattern_rollup", _SIGNED.replace("sg AS (", "sg0 AS (") + "SELECT service, 'excessive_fanout' AS type, count(*) AS findings, CAST(sum(n - 1) AS BIGINT) AS avoidable, min(lo) AS first_seen, max(lo) AS last_seen FROM c JOIN normalized p ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id GROUP BY service")
def _rollup(spark, sf_dir):
    from wattspan.functions.times import epoch_ms

    f = _signed(spark, sf_dir).select("service", "type", epoch_ms(F.col("first_timestamp")).alias("ts_ms"), (F.col("pattern.occurrences") - 1).alias("avoidable"))
    return periodic.antipattern_rollup(f)


@register("endpoints_seen", SPANS_SQL.rstrip() + " SELECT service, count(DISTINCT endpoint) AS endpoints FROM spans GROUP BY service")
def _endpoints(spark, sf_dir):
    return periodic.endpoints_seen(order_spans(spark, sf_dir).select("service", F.col("source.endpoint").alias("source_endpoint")))


@register("waste_tiers", _TIERS + "SELECT tier, io_ops, avoidable, avoidable_kwh, avoidable_g, ratio, 100 - 100 * ratio AS efficiency FROM tiers")
def _waste_tiers(spark, sf_dir):
    return periodic.waste_tiers(_both_tiers(spark, sf_dir))


@register("workload_waste_rollup", _AVOID.rstrip() + _SCORED + """, w AS (SELECT count(*) FILTER (WHERE event_type = 'sql') AS sq, count(*) FILTER (WHERE event_type = 'messaging') AS me, sum(energy_kwh) FILTER (WHERE event_type = 'sql') AS kwh FROM scored)
SELECT 'database' AS kind, CAST(1 AS BIGINT) AS windows, CAST(0 AS BIGINT) AS measured, CAST(0 AS BIGINT) AS declared, CAST(1 AS BIGINT) AS estimated, round(kwh * least(avoidable_sql / sq, 1.0), 12) AS waste_kwh, CAST(0 AS DOUBLE) AS waste_g FROM w, avoid
UNION ALL SELECT 'messaging', 1, 0, 1, 0, round(0.5 * least(avoidable_messaging / me, 1.0), 12), round(0.5 * 41.5 * 1.15 * least(avoidable_messaging / me, 1.0), 9) FROM w, avoid""")
def _waste_rollup(spark, sf_dir):
    scored, f = _scored(spark, sf_dir), _found(spark, sf_dir)[1]
    blocks = s.workload_waste(scored, f, "sql").withColumn("kind", F.lit("database")).unionByName(s.workload_waste(scored, f, "messaging", 0.5, 41.5, 1.15).withColumn("kind", F.lit("messaging")))
    return periodic.workload_waste_rollup(blocks).withColumns({"waste_kwh": F.round("waste_kwh", 12), "waste_g": F.round("waste_g", 9)})


@register("temporal_coverage", _EVENTS + """, dd AS (SELECT DISTINCT ts_ms // 86400000 AS day FROM p), b AS (SELECT min(day) - 2 AS lo, max(day) + 3 AS hi FROM dd), al AS (SELECT day FROM dd UNION ALL SELECT lo - 1 FROM b UNION ALL SELECT hi + 1 FROM b), g AS (SELECT day - lag(day) OVER (ORDER BY day) - 1 AS gap FROM al)
SELECT CAST(max(gap) AS INTEGER) AS largest_gap_days, (SELECT count(*) FROM dd) AS observed_days, CAST((SELECT hi - lo + 1 FROM b) AS INTEGER) AS period_days FROM g""")  # fmt: skip
def _temporal(spark, sf_dir):
    p = _events(spark, sf_dir)
    lo, hi = p.agg(F.date_sub(F.to_date(F.timestamp_millis(F.min("ts_ms"))), 2).cast("string"), F.date_add(F.to_date(F.timestamp_millis(F.max("ts_ms"))), 3).cast("string")).first()
    return periodic.temporal_coverage(p, lo, hi).select("largest_gap_days", "observed_days", "period_days")


@register("period_coverage", _WIN + "SELECT avg(CASE WHEN ts_ms % 7200000 = 0 THEN 1.0 ELSE 0.0 END) AS period_coverage FROM win")
def _coverage(spark, sf_dir):
    return periodic.period_coverage(_windows(spark, sf_dir))


@register("methodology_sets", _WIN + "SELECT string_agg(DISTINCT m, ',') AS models, bool_or(cal) AS calibrated, string_agg(DISTINCT 'v' || (ts_ms // 3600000 % 2), ',' ORDER BY 'v' || (ts_ms // 3600000 % 2)) AS versions FROM win, (VALUES ('io_proxy_v1', true), ('io_proxy_v1', false)) x(m, cal)")
def _methods(spark, sf_dir):
    windows = _windows(spark, sf_dir).withColumn("version", F.concat(F.lit("v"), (F.floor(F.col("ts_ms") / 3_600_000) % 2).cast("string")))
    return periodic.methodology_sets(windows).select(F.array_join("models", ",").alias("models"), "calibrated", F.array_join("versions", ",").alias("versions"))


@register("measured_ratios", _WIN + "SELECT service, avg(CASE WHEN service IN ('svc-0', 'svc-1') AND ts_ms % 7200000 = 0 THEN 1.0 ELSE 0.0 END) AS measured_ratio FROM bs GROUP BY service")
def _ratios(spark, sf_dir):
    return periodic.measured_ratios(_windows(spark, sf_dir))


@register("carbon_breakdown", _WIN + "SELECT round(sum(g) / 1000, 12) AS operational_kg, round(sum(emb) / 1000, 12) AS embodied_kg, round(sum(t) / 1000, 12) AS transport_kg, round(sum(t) / 1000 * 0.25, 12) AS transport_low_kg, round(sum(t) / 1000 * 1.625, 12) AS transport_high_kg FROM win")
def _breakdown(spark, sf_dir):
    return periodic.carbon_breakdown(_windows(spark, sf_dir)).select(*(_r(c, 12) for c in ("operational_kg", "embodied_kg", "transport_kg", "transport_low_kg", "transport_high_kg")))


@register("verify_archive_chain", _WIN + """SELECT 'f' || (ts_ms // 10800000) AS file, count(*) AS windows, count(*) FILTER (WHERE (ts_ms // 3600000) % 7 <> 0) AS verified, count(*) FILTER (WHERE (ts_ms // 3600000) % 7 = 0) AS breaks,
count(*) FILTER (WHERE (ts_ms // 3600000) % 7 = 0 AND ts_ms < 1752192000000) AS breaks_in_period, count(*) FILTER (WHERE (ts_ms // 3600000) % 7 = 0 AND ts_ms >= 1752192000000) AS breaks_outside, CAST(0 AS BIGINT) AS unchained FROM win GROUP BY ALL""")
def _chain(spark, sf_dir):
    """Chained windows, of which every seventh hour's is changed afterwards."""
    w = _windows(spark, sf_dir).select("file", "line", F.to_json(F.struct("ts_ms", "requests", "io_ops")).alias("body"))
    changed = F.when(F.floor(F.col("line") / 3_600_000) % 7 == 0, F.replace(F.col("body"), F.lit("requests"), F.lit("request"))).otherwise(F.col("body"))
    return periodic.verify_archive_chain(periodic.chain_windows(w).withColumns({"body": changed, "ts_ms": F.col("line")}), "2025-07-10", "2025-07-10")


@register("archive_round_trip", _WIN + """SELECT 'f' || (ts_ms // 10800000) AS file, count(*) AS windows, count(*) FILTER (WHERE (ts_ms // 3600000) % 7 <> 0) AS verified, count(*) FILTER (WHERE (ts_ms // 3600000) % 7 = 0) AS breaks,
  count(*) FILTER (WHERE (ts_ms // 3600000) % 7 = 0 AND ts_ms < 1752192000000) AS breaks_in_period, count(*) FILTER (WHERE (ts_ms // 3600000) % 7 = 0 AND ts_ms >= 1752192000000) AS breaks_outside,
  CAST(0 AS BIGINT) AS unchained, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(io_ops) AS BIGINT) AS io_ops, max(ts_ms) AS last_ms FROM win GROUP BY ALL""")
def _round_trip(spark, sf_dir):
    """Windows are appended to an archive in three batches, the last of them twice, and read back; then every seventh hour's
    line is changed, and the chains that go over three files are verified."""
    path = shared_folder(spark, "archive")
    report = F.struct("requests", "io_ops", "energy_kwh", "operational_g", "embodied_g", "transport_g", "models", "per_service")
    windows = _windows(spark, sf_dir).withColumn("body", archive.window_body(iso_ms(F.col("ts_ms")), report))
    for batch in (0, 1, 2, 2):
        archive.append_window_archive(windows.filter(F.floor(F.col("ts_ms") / 3_600_000) % 3 == batch), path, batch)
    lines = archive.read_archive_lines(spark, path)
    changed = F.when(F.floor(F.col("ts_ms") / 3_600_000) % 7 == 0, F.replace("body", F.lit('"io_ops":'), F.lit('"io_ops":1'))).otherwise(F.col("body"))
    checked = periodic.verify_archive_chain(lines.withColumn("body", changed), "2025-07-10", "2025-07-10")
    good, _ = archive.read_window_archive(spark, path)
    return checked.join(good.groupBy("file").agg(F.sum("requests").alias("requests"), F.sum("io_ops").alias("io_ops"), F.max("ts_ms").alias("last_ms")), "file")


@register("validate_disclosure", _WIN + """, agg AS (SELECT sum(requests) AS requests, sum(kwh) AS kwh, sum(g + emb + t) / 1000 AS kg, avg(CASE WHEN ts_ms % 7200000 = 0 THEN 1.0 ELSE 0.0 END) AS cov, count(DISTINCT ts_ms // 86400000) AS days FROM win), v AS (
  SELECT unnest([CASE WHEN requests < 0 THEN 'requests is negative' END, CASE WHEN kwh < 0 THEN 'energy is not finite or negative' END, CASE WHEN kg < 0 THEN 'carbon is not finite or negative' END,
    CASE WHEN cov NOT BETWEEN 0 AND 1 THEN 'period coverage is outside 0 to 1' END, CASE WHEN cov < 0.75 THEN 'period coverage is too low' END, CASE WHEN days > 31 THEN 'more days observed than the period has' END, 'canonical threshold is not the fixed one']) AS violation FROM agg)
SELECT violation FROM v WHERE violation IS NOT NULL""")  # fmt: skip
def _disclosure(spark, sf_dir):
    w = _windows(spark, sf_dir)
    totals = periodic.period_totals(w).crossJoin(periodic.period_coverage(w)).crossJoin(periodic.temporal_coverage(w, "2025-07-01", "2025-07-31"))
    return periodic.validate_disclosure(totals.withColumns({"ratio": F.lit(0.2), "efficiency": F.lit(80.0), "potential_kg": F.col("carbon_kg") * 0.2, "canonical_threshold": F.lit(5)}))


def _pair_input(spark, sf_dir) -> DataFrame:
    from wattspan.functions.times import epoch_ms

    f = d.detect_slow(normalized(spark, sf_dir), LIMITS.slow_ms, LIMITS.slow_min)
    return f.select(epoch_ms(F.col("last_timestamp")).alias("ts_ms"), "trace_id", "service", "type", F.col("pattern.template").alias("template"), F.lit("").alias("gk"), F.lit("").alias("gv"))


def _pairs(lag: int, confidence: float) -> str:
    return SPANS_SQL.rstrip() + f""", f AS (SELECT max(ts_ms) AS ts, trace_id, min_by(service, ord) AS service, min_by(service, ord) || '|slow_' || CASE event_type WHEN 'http_out' THEN 'http' ELSE event_type END || '|' || template AS who
  FROM normalized WHERE duration_us > 25000 GROUP BY trace_id, event_type, template HAVING count(*) >= 3),
x AS (SELECT a.who AS a, b.who AS b, a.ts, a.trace_id, min(b.ts - a.ts) AS lag FROM f a JOIN f b ON b.ts BETWEEN a.ts AND a.ts + {lag} AND a.service <> b.service GROUP BY ALL), t AS (SELECT who, count(*) AS total FROM f GROUP BY who),
pairs AS (SELECT x.a, x.b, count(*) AS count, total, median(lag) AS median_lag_ms, min(ts) AS first_seen, max(ts) AS last_seen, arg_min(trace_id, (ts, trace_id)) AS sample_trace, count(*) / total AS confidence
  FROM x JOIN t ON x.a = t.who GROUP BY x.a, x.b, total HAVING count(*) >= 2 AND count(*) / total >= {confidence})
"""


@register("cross_trace_correlations", _pairs(5, 0.02) + "SELECT * FROM pairs")
def _correlations(spark, sf_dir):
    return cross_trace_correlations(_pair_input(spark, sf_dir), lag_ms=5, min_count=2, min_confidence=0.02).drop("gk", "gv")


@register("top_pairs", _pairs(50, 0.0) + "SELECT * FROM pairs ORDER BY count DESC, a, b LIMIT 20")
def _top_pairs(spark, sf_dir):
    return top_pairs(cross_trace_correlations(_pair_input(spark, sf_dir), lag_ms=50, min_count=2, min_confidence=0.0), 20).drop("gk", "gv")


@register("sticky_figures", _EVENTS + _HOUR + """, v AS (SELECT *, CASE WHEN ops > 2 THEN total END AS value FROM h), l AS (
  SELECT *, last_value(CASE WHEN value IS NOT NULL THEN ts_ms END IGNORE NULLS) OVER w AS known_ms, last_value(value IGNORE NULLS) OVER w AS held FROM v WINDOW w AS (PARTITION BY service ORDER BY ts_ms ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT service, ts_ms, ops, round(value, 9) AS value, CASE WHEN ts_ms - known_ms <= 7200000 THEN round(held, 9) END AS sticky_value FROM l""")  # fmt: skip
def _sticky(spark, sf_dir):
    held = sticky(_hourly(spark, sf_dir).withColumn("value", F.when(F.col("ops") > 2, F.col("total"))), "value", 7_200_000)
    return held.select("service", "ts_ms", "ops", _r("value"), _r("sticky_value"))


@register("live_totals", _AVOID + """, la AS (SELECT service, max(n) - 1 AS ops FROM (SELECT trace_id, template, source_endpoint, n, service FROM n1
  UNION ALL SELECT trace_id, template, min_by(endpoint, ord), count(*), min_by(service, ord) FROM normalized WHERE event_type <> 'messaging' AND (trace_id, template) NOT IN (SELECT (trace_id, template) FROM n1) GROUP BY trace_id, event_type, template, params HAVING count(*) >= 2)
  GROUP BY service, trace_id, template, source_endpoint), lb AS (SELECT service, CAST(sum(ops) AS BIGINT) AS avoidable FROM la GROUP BY service),
lt AS (SELECT service, count(*) AS io_ops, count(DISTINCT trace_id) AS traces, CAST(sum(duration_us) AS BIGINT) AS busy_us FROM spans GROUP BY service)
SELECT lt.*, coalesce(avoidable, 0) AS avoidable, coalesce(avoidable, 0) / io_ops AS io_waste_ratio FROM lt LEFT JOIN lb ON lt.service = lb.service""")  # fmt: skip
def _live(spark, sf_dir):
    return live_totals(*_found(spark, sf_dir))


@register("ancestors", SPANS_SQL.rstrip() + " SELECT trace_id, span_id, 1 AS hop, parent_span_id AS ancestor FROM spans WHERE parent_span_id IS NOT NULL")
def _ancestors(spark, sf_dir):
    return ingest.ancestors(order_spans(spark, sf_dir), 3)


@register("sanitize_spans", SPANS_SQL.rstrip() + " SELECT span_id, target, endpoint FROM spans")
def _sanitize(spark, sf_dir):
    return ingest.sanitize_spans(order_spans(spark, sf_dir)).select("span_id", "target", F.col("source.endpoint").alias("endpoint"))


@register("sample_traces", SPANS_SQL.rstrip() + """, h AS (
  SELECT trace_id, count(*) AS spans, list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), list_transform(string_split(trace_id, ''), lambda c: CAST(ascii(c) AS HUGEINT))),
    lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616) AS hash
  FROM spans GROUP BY trace_id
)
SELECT trace_id, spans FROM h WHERE CAST(hash AS DOUBLE) / 18446744073709551616 < 0.25""")
def _sample(spark, sf_dir):
    return ingest.sample_traces(order_spans(spark, sf_dir), 0.25).groupBy("trace_id").agg(F.count(F.lit(1)).alias("spans"))


@register("last_spans", SPANS_SQL.rstrip() + " SELECT trace_id, span_id FROM spans QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY ts_ms DESC, ord DESC) <= 3")
def _last(spark, sf_dir):
    return ingest.last_spans(order_spans(spark, sf_dir), 3).select("trace_id", "span_id")


@register("stitch_split_spans", SPANS_SQL.rstrip() + """, k AS (SELECT trace_id, span_id, parent_span_id, ts_ms, target, ord, ord % 5 = 0 AS orphan FROM spans WHERE event_type = 'sql'),
o5 AS (SELECT o.trace_id, max(d.ord) AS pick FROM k o JOIN k d ON d.trace_id = o.trace_id AND d.ord < 5 WHERE o.ord = 5 GROUP BY o.trace_id),
o10 AS (SELECT o.trace_id, coalesce(max(d.ord) FILTER (WHERE d.ord IS DISTINCT FROM o5.pick), max(o5.pick)) AS pick FROM k o JOIN k d ON d.trace_id = o.trace_id AND d.ord < 10 AND d.ord <> 5 LEFT JOIN o5 ON o5.trace_id = o.trace_id WHERE o.ord = 10 GROUP BY o.trace_id),
pk AS (SELECT trace_id, 5 AS ord, pick FROM o5 UNION ALL SELECT trace_id, 10, pick FROM o10)
SELECT k.trace_id, k.span_id, k.parent_span_id, k.ts_ms, CASE WHEN k.orphan THEN d.target ELSE k.target END AS target, k.orphan
FROM k LEFT JOIN pk ON k.trace_id = pk.trace_id AND k.ord = pk.ord LEFT JOIN k d ON d.trace_id = pk.trace_id AND d.ord = pk.pick
WHERE NOT EXISTS (SELECT 1 FROM pk u WHERE u.trace_id = k.trace_id AND u.pick = k.ord)""")  # fmt: skip
def _stitch(spark, sf_dir):
    spans = order_spans(spark, sf_dir).filter("event_type = 'sql'")
    split = spans.select("trace_id", "span_id", "parent_span_id", "ts_ms", F.when(F.col("ord") % 5 != 0, F.col("target")).alias("target"), (F.col("ord") % 5 == 0).alias("orphan"))
    return stitch.stitch_split_spans(split)


@register("suppress_layered_duplicates", SPANS_SQL.rstrip() + """ SELECT c.span_id FROM spans c LEFT JOIN spans p ON c.parent_span_id = p.span_id AND c.trace_id = p.trace_id AND p.event_type = 'sql' AND c.event_type = 'sql' AND p.target = c.target WHERE p.span_id IS NULL""")
def _suppress(spark, sf_dir):
    return ingest.suppress_layered_duplicates(order_spans(spark, sf_dir), 2).select("span_id")


@register("resolve_producer_link", SPANS_SQL.rstrip() + """, k AS (SELECT *, 't' || (l_orderkey % 7) AS link FROM spans WHERE event_type = 'messaging' AND parent_span_id IS NOT NULL)
SELECT s.span_id, arg_max(k.link, (k.ts_ms, k.span_id)) AS producer_trace FROM spans s LEFT JOIN k ON s.trace_id = k.trace_id AND s.parent_span_id = k.parent_span_id AND k.ts_ms <= s.ts_ms AND k.span_id <> s.span_id GROUP BY s.span_id""")  # fmt: skip
def _link(spark, sf_dir):
    spans = order_spans(spark, sf_dir).withColumns({"kind": F.when((F.col("event_type") == "messaging") & F.col("parent_span_id").isNotNull(), "CONSUMER").otherwise("CLIENT"), "link_trace_id": F.concat(F.lit("t"), (F.substring("trace_id", 2, 20).cast("long") % 7).cast("string"))})
    return ingest.resolve_producer_link(spans).select("span_id", "producer_trace")
