"""I/O intensity, waste, energy and carbon of spans and findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattspan.functions.times import utc_hour, utc_month
from wattspan.operators.detect import repeats_by_tier
from wattspan.schema import AVOIDABLE, Thresholds
from wattspan.sources.reference_tables import region_intensity

# The carbon model's constants.
ENERGY_PER_OP_KWH = 1e-7
TRANSPORT_KWH_PER_BYTE = 4e-11
EMBODIED_G_PER_REQUEST = 0.001
UNCERTAINTY = (0.5, 2.0)
UNKNOWN_PUE = 1.5
SQL_VERBS = {"SELECT": 0.5, "INSERT": 1.5, "UPDATE": 1.5, "DELETE": 1.2}
WASTE_BANDS = (0.10, 0.30, 0.50)
INTENSITY_BANDS = (2.0, 5.0, 10.0)
BANDS = ("healthy", "moderate", "high", "critical")
#: Measured energy backends, best first; proxies come after them.
BACKENDS = ("alumet_rapl", "scaphandre_rapl", "kepler_ebpf", "redfish_bmc", "cloud_specpower")
MAX_REGIONS = 256
_CANONICAL_THRESHOLD = 2


def band(value: Column, limits: tuple[float, float, float]) -> Column:
    """healthy, moderate, high or critical; NaN and null are healthy."""
    out = F.lit(BANDS[0])
    for limit, name in zip(limits, BANDS[1:], strict=True):
        out = F.when((value >= limit) & ~F.isnan(value), F.lit(name)).otherwise(out)
    return out


def endpoint_stats(spans: DataFrame) -> DataFrame:
    """service, source_endpoint, io_ops, invocations (distinct traces) and io_intensity."""
    out = spans.groupBy("service", F.col("source.endpoint").alias("source_endpoint")).agg(F.count(F.lit(1)).alias("io_ops"), F.countDistinct("trace_id").alias("invocations"))
    return out.withColumn("io_intensity", io_intensity_score(F.col("io_ops"), F.col("invocations")))


def io_intensity_score(ops: Column, invocations: Column) -> Column:
    return ops / F.greatest(invocations, F.lit(1))


def avoidable_io_ops(findings: DataFrame) -> DataFrame:
    """One row: avoidable, avoidable_sql, avoidable_messaging. Of one template of a trace and endpoint the largest finding counts."""
    p = F.col("pattern")
    each = findings.filter(F.col("type").isin(*AVOIDABLE)).groupBy("trace_id", p["template"].alias("template"), "source_endpoint")
    most = each.agg(F.max(F.struct(F.greatest(p["occurrences"] - 1, F.lit(0)).alias("ops"), "type")).alias("m")).select("m.ops", "m.type")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("ops"))), F.lit(0)).cast("long")
    return most.agg(total(F.lit(True)).alias("avoidable"), total(F.col("type").endswith("_sql")).alias("avoidable_sql"), total(F.col("type").endswith("_messaging")).alias("avoidable_messaging"))


def avoidable_by_tier(findings: DataFrame, tiers: tuple[str, ...]) -> DataFrame:
    """One row a tier: tier and avoidable, counted as by ``avoidable_io_ops``. findings have a tier."""
    p = F.col("pattern")
    each = findings.filter(F.col("type").isin(*AVOIDABLE)).groupBy("tier", "trace_id", p["template"].alias("template"), "source_endpoint").agg(F.max(F.greatest(p["occurrences"] - 1, F.lit(0))).alias("ops"))
    total = lambda t: F.coalesce(F.sum(F.when(F.col("tier") == t, F.col("ops"))), F.lit(0)).cast("long")
    sums = each.agg(*(total(t).alias(f"_{i}") for i, t in enumerate(tiers)))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(t).alias("tier"), F.col(f"_{i}").alias("avoidable")) for i, t in enumerate(tiers)))))


def io_waste(spans: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: total_io_ops, avoidable ops, io_waste_ratio and its band."""
    return with_waste(spans.agg(F.count(F.lit(1)).alias("total_io_ops")).crossJoin(avoidable_io_ops(findings)))


def with_waste(totals: DataFrame) -> DataFrame:
    """totals (total_io_ops, avoidable) with io_waste_ratio and its band."""
    ratio = F.when(F.col("total_io_ops") > 0, F.col("avoidable") / F.col("total_io_ops")).otherwise(0.0)
    return totals.withColumn("io_waste_ratio", ratio).withColumn("io_waste_band", band(F.col("io_waste_ratio"), WASTE_BANDS))


def enrich_findings_with_iis(findings: DataFrame, stats: DataFrame) -> DataFrame:
    """findings with green_impact: extra ops of avoidable types, and the endpoint's intensity with its band."""
    own = stats.select("service", "source_endpoint", "io_intensity")
    score = F.coalesce("io_intensity", F.lit(0.0))
    extra = F.when(F.col("type").isin(*AVOIDABLE), F.greatest(F.col("pattern.occurrences") - 1, F.lit(0))).otherwise(0)
    out = findings.join(own, ["service", "source_endpoint"], "left")
    return out.withColumn("green_impact", F.struct(extra.cast("long").alias("estimated_extra_io_ops"), score.alias("io_intensity_score"), band(score, INTENSITY_BANDS).alias("io_intensity_band"))).drop("io_intensity")


def top_offenders(stats: DataFrame, n: int | None = None, region: str | None = None, regions: DataFrame | None = None) -> DataFrame:
    """Endpoints by intensity; grams only where one region stands for all spans."""
    out = stats.orderBy(F.desc("io_intensity"), "service", "source_endpoint")
    out = out if n is None else out.limit(n)
    if region is None:
        return out.withColumn("co2_grams", F.lit(None).cast("double"))
    grid = F.broadcast((regions or region_intensity(stats.sparkSession)).filter(F.col("region") == region.lower()).select("intensity", "pue"))
    return out.crossJoin(grid).withColumn("co2_grams", F.col("io_ops") * ENERGY_PER_OP_KWH * F.col("intensity") * F.col("pue")).drop("intensity", "pue")


def energy_coefficient() -> Column:
    """Relative energy of an operation: SQL by its verb, HTTP by the size of the answer, publishes 1."""
    verb = F.upper(F.regexp_extract("target", r"^\s*(\S+)", 1))
    sql = F.lit(1.0)
    for name, weight in SQL_VERBS.items():
        sql = F.when(verb == name, F.lit(weight)).otherwise(sql)
    size = F.col("response_size_bytes")
    http = F.when(size.isNull(), 1.0).when(size < 10 * 1024, 0.8).when(size <= 1024 * 1024, 1.2).otherwise(2.0)
    return F.when(F.col("event_type") == "sql", sql).when(F.col("event_type") == "http_out", http).otherwise(1.0)


def span_energy(spans: DataFrame, calibration: DataFrame | None = None, measured: DataFrame | None = None) -> DataFrame:
    """spans with energy_kwh, the model that gave it and whether it is calibrated.

    calibration: service, factor. measured: service, kwh_per_op, backend. Both hold a row a service and are joined by it.
    """
    out = spans
    out = out.join(calibration.select("service", "factor"), "service", "left") if calibration is not None else out.withColumn("factor", F.lit(None).cast("double"))
    out = out.join(measured.select("service", "kwh_per_op", "backend"), "service", "left") if measured is not None else out.withColumns({"kwh_per_op": F.lit(None).cast("double"), "backend": F.lit(None).cast("string")})
    proxy = ENERGY_PER_OP_KWH * energy_coefficient() * F.coalesce("factor", F.lit(1.0))
    return out.withColumns({"energy_kwh": F.coalesce("kwh_per_op", proxy), "energy_model": F.coalesce("backend", F.lit("io_proxy")), "calibrated": F.col("kwh_per_op").isNull() & F.col("factor").isNotNull()}).drop("factor", "kwh_per_op", "backend")


def resolve_region(spans: DataFrame, service_regions: dict[str, str] | None = None, default: str | None = None, max_regions: int | None = None) -> DataFrame:
    """spans with region: of the span, of its service, or the default, in lower case; null is unknown.

    With ``max_regions`` (MAX_REGIONS for live totals) only the regions that are seen first keep their name.
    """
    by_service = F.create_map(*[F.lit(x) for kv in (service_regions or {}).items() for x in (kv[0].lower(), kv[1])]) if service_regions else None
    known = [F.col("cloud_region"), *([by_service[F.lower("service")]] if by_service is not None else []), F.lit(default)]
    out = spans.withColumn("region", F.lower(F.coalesce(*known)))
    if max_regions is None:
        return out
    seen = out.filter("region is not null").groupBy("region").agg(F.min(F.struct("ts_ms", "trace_id", "span_id")).alias("first")).orderBy("first").limit(max_regions).select("region", F.lit(True).alias("_named"))
    return out.join(F.broadcast(seen), "region", "left").withColumn("region", F.when(F.col("_named"), F.col("region"))).drop("_named")


def grid_intensity(spans: DataFrame, regions: DataFrame | None = None, profiles: DataFrame | None = None, realtime: DataFrame | None = None) -> DataFrame:
    """spans with intensity, pue and intensity_source: real time, then the hourly profile of the month, then annual.

    profiles: region, month (null: all), hour, intensity. realtime: region, intensity. Regions outside all tables have none.
    """
    annual = (regions if regions is not None else region_intensity(spans.sparkSession)).select("region", F.col("intensity").alias("_annual"), F.col("pue").alias("_pue"))
    # the built-in table is small; tables of the user are broadcast only if Spark finds them small
    out = spans.join(F.broadcast(annual) if regions is None else annual, "region", "left")
    hour, month = utc_hour(F.col("ts_ms")), utc_month(F.col("ts_ms"))
    if profiles is not None:
        p = profiles.select(F.lower("region").alias("region"), F.explode(F.when(F.col("month").isNull(), F.sequence(F.lit(1), F.lit(12))).otherwise(F.array(F.col("month").cast("int")))).alias("_month"), F.col("hour").alias("_hour"), F.col("intensity").alias("_hourly"))
        out = out.withColumns({"_month": month, "_hour": hour}).join(p, ["region", "_month", "_hour"], "left").drop("_month", "_hour")
    else:
        out = out.withColumn("_hourly", F.lit(None).cast("double"))
    out = out.join(realtime.select(F.lower("region").alias("region"), F.col("intensity").alias("_now")), "region", "left") if realtime is not None else out.withColumn("_now", F.lit(None).cast("double"))
    source = F.when(F.col("_now").isNotNull(), "real_time").when(F.col("_hourly").isNotNull(), "hourly").when(F.col("_annual").isNotNull(), "annual")
    out = out.withColumns({"intensity": F.coalesce("_now", "_hourly", "_annual", F.lit(0.0)), "pue": F.coalesce("_pue", F.lit(UNKNOWN_PUE)), "intensity_source": source})
    return out.drop("_annual", "_pue", "_hourly", "_now")


def span_carbon(spans: DataFrame) -> DataFrame:
    """spans with co2_grams; a span without a region has none."""
    return spans.withColumn("co2_grams", F.when(F.col("region").isNotNull(), F.col("energy_kwh") * F.col("intensity") * F.col("pue")))


def transport_carbon(spans: DataFrame, host_regions: dict[str, str]) -> DataFrame:
    """spans with transport_grams: bytes of an answer from a known host in another region."""
    hosts = F.create_map(*[F.lit(x) for kv in host_regions.items() for x in (kv[0].lower(), kv[1].lower())]) if host_regions else None
    host = F.lower(F.regexp_extract("target", r"(?i)^https?://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    callee = hosts[host] if hosts is not None else F.lit(None)
    applies = (F.col("event_type") == "http_out") & F.col("response_size_bytes").isNotNull() & callee.isNotNull() & F.col("region").isNotNull() & (callee != F.col("region"))
    return spans.withColumn("transport_grams", F.when(applies, F.col("response_size_bytes") * TRANSPORT_KWH_PER_BYTE * F.col("intensity") * F.col("pue")).otherwise(0.0))


def scored_spans(spans: DataFrame, *, service_regions: dict[str, str] | None = None, default_region: str | None = None, host_regions: dict[str, str] | None = None, calibration: DataFrame | None = None, measured: DataFrame | None = None, regions: DataFrame | None = None, profiles: DataFrame | None = None, realtime: DataFrame | None = None) -> DataFrame:
    """spans with region, energy, intensity, grams and transport."""
    out = span_energy(resolve_region(spans, service_regions, default_region), calibration, measured)
    return transport_carbon(span_carbon(grid_intensity(out, regions, profiles, realtime)), host_regions or {})


def region_breakdown(scored: DataFrame) -> DataFrame:
    """Ops and grams of each region, largest first, and a row for spans without a region."""
    rank = F.when(F.col("intensity_source") == "real_time", 3).when(F.col("intensity_source") == "hourly", 2).when(F.col("intensity_source") == "annual", 1).otherwise(0)
    source = F.get(F.array(*map(F.lit, ("none", "annual", "hourly", "real_time"))), F.max(rank))
    status = F.when(F.col("region").isNull(), "unresolved").when(F.max(rank) > 0, "known").otherwise("out_of_table")
    out = scored.groupBy("region").agg(F.count(F.lit(1)).alias("io_ops"), F.coalesce(F.sum("co2_grams"), F.lit(0.0)).alias("co2_grams"), F.avg("intensity").alias("mean_intensity"), source.alias("intensity_source"), status.alias("status"))
    return out.withColumn("region", F.coalesce("region", F.lit("unknown"))).orderBy(F.desc("co2_grams"), "region")


def service_breakdown(scored: DataFrame) -> DataFrame:
    """Energy, grams, first known region, best energy model and measured share of each service."""
    order = F.array(*map(F.lit, (*BACKENDS, "io_proxy")))
    best = F.get(order, (F.min(F.array_position(order, F.col("energy_model"))) - 1).cast("int"))
    measured = (F.col("energy_model") != "io_proxy").cast("int")
    return scored.groupBy("service").agg(
        F.count(F.lit(1)).alias("io_ops"), F.sum("energy_kwh").alias("energy_kwh"), F.coalesce(F.sum("co2_grams"), F.lit(0.0)).alias("co2_grams"), F.min_by("region", F.when(F.col("region").isNotNull(), F.struct("ts_ms", "trace_id", "ord"))).alias("region"),
        best.alias("energy_model"), F.avg(measured).alias("measured_ratio"),
    )


def model_tag() -> Column:
    """The tag of a scored table's best model: real time, a measured backend, or a proxy by its profile, with +cal."""
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    tag = F.when(any_(F.col("intensity_source") == "hourly"), "io_proxy_v2").otherwise("io_proxy_v1")
    for b in BACKENDS[::-1]:
        tag = F.when(any_(F.col("energy_model") == b), F.lit(b)).otherwise(tag)
    tag = F.when(any_(F.col("intensity_source") == "real_time"), "electricity_maps_api").otherwise(tag)
    return F.concat(tag, F.when(any_(F.col("calibrated")), "+cal").otherwise(""))


def carbon_report(scored: DataFrame, findings: DataFrame, embodied_g: float = EMBODIED_G_PER_REQUEST) -> DataFrame:
    """One row: operational, embodied, transport, total and avoidable grams, a trace's share, and the bracket."""
    total = scored.agg(
        F.countDistinct("trace_id").alias("traces"), F.count(F.lit(1)).alias("io_ops"), F.count("region").alias("accounted_ops"), F.coalesce(F.sum("co2_grams"), F.lit(0.0)).alias("operational_g"),
        F.coalesce(F.sum("transport_grams"), F.lit(0.0)).alias("transport_g"), model_tag().alias("model"),
    )
    out = total.crossJoin(avoidable_io_ops(findings)).withColumn("embodied_g", F.col("traces") * embodied_g)
    out = out.withColumn("total_g", F.col("operational_g") + F.col("embodied_g") + F.col("transport_g"))
    share = F.when(F.col("accounted_ops") > 0, F.least(F.col("avoidable") / F.col("accounted_ops"), F.lit(1.0))).otherwise(0.0)
    per_trace = F.when(F.col("traces") > 0, F.col("total_g") / F.col("traces")).otherwise(0.0)
    return out.withColumns({"avoidable_g": F.col("operational_g") * share, "g_per_trace": per_trace, "low_g": F.col("total_g") * UNCERTAINTY[0], "high_g": F.col("total_g") * UNCERTAINTY[1]})


def workload_waste(scored: DataFrame, findings: DataFrame, kind: str, declared_kwh: float | None = None, intensity: float = 0.0, pue: float = 1.0) -> DataFrame:
    """One row for databases (kind sql) or brokers (kind messaging): avoidable share of declared, else modelled, energy and grams."""
    own = scored.filter(F.col("event_type") == kind).agg(F.count(F.lit(1)).alias("ops"), F.coalesce(F.sum("energy_kwh"), F.lit(0.0)).alias("modelled_kwh"), F.coalesce(F.sum("co2_grams"), F.lit(0.0)).alias("modelled_g"))
    ratio = F.when(F.col("ops") > 0, F.least(F.col(f"avoidable_{kind}") / F.col("ops"), F.lit(1.0))).otherwise(0.0)
    out = own.crossJoin(avoidable_io_ops(findings)).withColumn("ratio", ratio)
    kwh = F.col("modelled_kwh") if declared_kwh is None else F.lit(declared_kwh)
    grams = F.col("modelled_g") if declared_kwh is None else F.lit(declared_kwh * intensity * pue)
    return out.select("ops", F.col(f"avoidable_{kind}").alias("avoidable"), "ratio", (kwh * F.col("ratio")).alias("waste_kwh"), (grams * F.col("ratio")).alias("waste_g"), F.lit("estimated" if declared_kwh is None else "declared").alias("provenance"))


def canonical_tiers(normalized: DataFrame, scored: DataFrame, threshold: int = Thresholds().n_plus_one, window_ms: int = Thresholds().window_ms) -> DataFrame:
    """Two rows, canonical (every repeat from the second on) and operational (from ``threshold`` on): ops, avoidable ops, ratio, and
    their kWh and grams. The repeats of both are found in one pass over the spans."""
    tiers = {"canonical": _CANONICAL_THRESHOLD, "operational": threshold}
    both = avoidable_by_tier(repeats_by_tier(normalized, tiers, window_ms), tuple(tiers))
    total = scored.agg(F.count(F.lit(1)).alias("io_ops"), F.coalesce(F.sum("energy_kwh"), F.lit(0.0)).alias("kwh"), F.coalesce(F.sum("co2_grams"), F.lit(0.0)).alias("g"))
    ratio = F.when(F.col("io_ops") > 0, F.least(F.col("avoidable") / F.col("io_ops"), F.lit(1.0))).otherwise(0.0)
    return both.crossJoin(total).withColumn("ratio", ratio).select("tier", "io_ops", "avoidable", "ratio", (F.col("kwh") * F.col("ratio")).alias("avoidable_kwh"), (F.col("g") * F.col("ratio")).alias("avoidable_g"))


@dataclass
class GreenSummary:
    """The parts of a summary: one-row totals and long tables instead of maps."""

    totals: DataFrame
    regions: DataFrame
    services: DataFrame
    offenders: DataFrame


def green_summary(spans: DataFrame, findings: DataFrame, enabled: bool = True, offenders: int = 10, **context) -> GreenSummary:
    """Waste and carbon of a batch; disabled, only the number of ops."""
    if not enabled:
        none = spans.limit(0)
        totals = spans.agg(F.count(F.lit(1)).alias("total_io_ops"))
        return GreenSummary(totals, none, none, none)
    scored = scored_spans(spans, **context)
    # one pass over the scored spans and one over the findings
    totals = with_waste(carbon_report(scored, findings).withColumnRenamed("io_ops", "total_io_ops"))
    first = ["total_io_ops", "avoidable", "avoidable_sql", "avoidable_messaging", "io_waste_ratio", "io_waste_band"]
    totals = totals.select(*first, *(c for c in totals.columns if c not in first))
    return GreenSummary(totals, region_breakdown(scored), service_breakdown(scored), top_offenders(endpoint_stats(spans), offenders))

