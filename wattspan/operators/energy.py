"""Energy telemetry as table jobs: samples and op counts become energy per operation.

The common shape is telemetry joined with ops a service and interval; the result is service, ts, kwh_per_op, backend.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattspan.operators.score import BACKENDS, ENERGY_PER_OP_KWH
from wattspan.sources.reference_tables import with_instance_power

J_PER_KWH = 3.6e6


def ops_per_interval(spans: DataFrame, seconds: int) -> DataFrame:
    """service, ts_ms (start of the interval) and ops of each interval that has any."""
    start = F.floor(F.col("ts_ms") / (seconds * 1000)) * seconds * 1000
    return spans.groupBy("service", start.cast("long").alias("ts_ms")).agg(F.count(F.lit(1)).alias("ops"))


DAY_MS = 86_400_000
#: Rules that may name processes; the table is broadcast.
MAX_RULES = 10_000


def with_previous(samples: DataFrame, key: str, value: str, ts: str = "ts_ms") -> DataFrame:
    """samples with ``_previous`` (ts, value): the key's sample before. A key's history is dealt over days: each day's first
    sample takes the last one of the day before that has any, found in a window of one row a day."""
    sample = F.struct(ts, value)
    own = samples.withColumn("_day", F.floor(F.col(ts) / DAY_MS))
    last = own.groupBy(key, "_day").agg(F.max_by(sample, ts).alias("_end"))
    before = last.select(key, "_day", F.lag("_end").over(Window.partitionBy(key).orderBy("_day")).alias("_carried"))
    lag = F.lag(sample).over(Window.partitionBy(key, "_day").orderBy(ts))
    return own.withColumn("_previous", lag).join(before, [key, "_day"]).withColumn("_previous", F.coalesce("_previous", "_carried")).drop("_carried", "_day")


def with_last_known(samples: DataFrame, key: str, value: str, ts: str = "ts_ms") -> DataFrame:
    """samples with ``_last`` (ts, value): the key's last sample so far whose value isn't null, its own included; by days as above."""
    known = F.when(F.col(value).isNotNull(), F.struct(ts, value))
    own = samples.withColumn("_day", F.floor(F.col(ts) / DAY_MS))
    last = own.groupBy(key, "_day").agg(F.max_by(F.struct(ts, value), F.when(F.col(value).isNotNull(), F.col(ts))).alias("_end"))
    earlier = Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    before = last.select(key, "_day", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    upto = Window.partitionBy(key, "_day").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    return own.withColumn("_last", F.last(known, ignorenulls=True).over(upto)).join(before, [key, "_day"]).withColumn("_last", F.coalesce("_last", "_carried")).drop("_carried", "_day")


def counter_deltas(samples: DataFrame, key: str, value: str, ts: str = "ts_ms") -> DataFrame:
    """samples with the increase since the key's previous sample; resets, first samples and zeros are dropped."""
    delta = F.greatest(F.col(value) - F.col(f"_previous.{value}"), F.lit(0))
    return with_previous(samples, key, value, ts).withColumn("delta", delta).drop("_previous").filter("delta > 0")


def _per_op(df: DataFrame, kwh: Column, backend: str) -> DataFrame:
    usable = (F.col("ops") > 0) & kwh.isNotNull() & ~F.isnan(kwh) & (kwh >= 0) & (kwh < float("inf"))
    return df.filter(usable).select("service", "ts_ms", (kwh / F.col("ops")).alias("kwh_per_op"), F.lit(backend).alias("backend"))


def attribute_process_power(power: DataFrame, processes: DataFrame, ops: DataFrame, seconds: float) -> DataFrame:
    """power: ts_ms, exe, cmdline, microwatts. processes: service, exe_part, cmdline_part (null: any); at most MAX_RULES rows,
    else ValueError, so every task can hold them.

    A service takes the power of a process only if exactly one process of that time matches it.
    """
    if processes.limit(MAX_RULES + 1).count() > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} process rules")
    fits = F.col("exe").contains(F.col("exe_part")) & (F.col("cmdline_part").isNull() | F.col("cmdline").contains(F.col("cmdline_part")))
    only = power.join(F.broadcast(processes), fits).groupBy("service", "ts_ms").agg(F.count(F.lit(1)).alias("n"), F.max("microwatts").alias("uw")).filter("n = 1")
    return _per_op(only.join(ops, ["service", "ts_ms"]), F.col("uw") / 1e6 * seconds / J_PER_KWH, "scaphandre_rapl")


def attribute_counter_joules(samples: DataFrame, ops: DataFrame) -> DataFrame:
    """samples: ts_ms, service, joules (cumulative)."""
    return _per_op(counter_deltas(samples, "service", "joules").join(ops, ["service", "ts_ms"]), F.col("delta") / J_PER_KWH, "kepler_ebpf")


def interval_kwh(joules: Column, energy_seconds: float, scrape_seconds: float) -> Column:
    """Energy of a scrape interval from joules of an energy interval."""
    return joules / energy_seconds * scrape_seconds / J_PER_KWH


def attribute_interval_joules(samples: DataFrame, ops: DataFrame, energy_seconds: float, scrape_seconds: float) -> DataFrame:
    """samples: ts_ms, service, joules (of one energy interval)."""
    return _per_op(samples.join(ops, ["service", "ts_ms"]), interval_kwh(F.col("joules"), energy_seconds, scrape_seconds), "alumet_rapl")


def attribute_chassis_power(watts: DataFrame, services: DataFrame, ops: DataFrame, seconds: float) -> DataFrame:
    """watts: ts_ms, chassis, watts. services: chassis, service. All services of a chassis get the same energy an op."""
    joined = watts.join(services, "chassis").join(ops, ["service", "ts_ms"]).filter("ops > 0")
    total = F.sum("ops").over(Window.partitionBy("chassis", "ts_ms"))
    return _per_op(joined.withColumn("ops", total), F.col("watts") * seconds / J_PER_KWH, "redfish_bmc")


def interpolated_watts(cpu_percent: Column) -> Column:
    """Between idle_watts and max_watts; a percentage that is not finite counts as idle."""
    finite = cpu_percent.isNotNull() & ~F.isnan(cpu_percent) & (F.abs(cpu_percent) < float("inf"))
    share = F.when(finite, F.least(F.greatest(cpu_percent, F.lit(0.0)), F.lit(100.0))).otherwise(0.0) / 100
    return F.col("idle_watts") + (F.col("max_watts") - F.col("idle_watts")) * share


def attribute_cpu_power(cpu: DataFrame, ops: DataFrame, seconds: float) -> DataFrame:
    """cpu: ts_ms, service, instance_type, provider, cpu_percent."""
    rows = with_instance_power(cpu).withColumn("watts", interpolated_watts(F.col("cpu_percent")))
    return _per_op(rows.join(ops, ["service", "ts_ms"]), F.col("watts") * seconds / J_PER_KWH, "cloud_specpower")


def measured_energy_snapshot(energy: DataFrame, now_ms: int, staleness_ms: int) -> DataFrame:
    """Of each service the row of the best backend that is fresh enough, and of that backend the newest."""
    rank = F.array_position(F.array(*map(F.lit, BACKENDS)), F.col("backend"))
    fresh = energy.filter((F.col("ts_ms") <= now_ms) & (F.lit(now_ms) - F.col("ts_ms") <= staleness_ms) & (rank > 0))
    best = fresh.groupBy("service").agg(F.min_by(F.struct("ts_ms", "kwh_per_op", "backend"), F.struct(rank, -F.col("ts_ms"), "kwh_per_op")).alias("b"))
    return best.select("service", "b.ts_ms", "b.kwh_per_op", "b.backend")


def declared_cluster_energy(ticks: DataFrame, nodes: int, max_watts: float, staleness_ms: int) -> DataFrame:
    """ticks: ts_ms, measured_kwh (null: no sample). A tick bills either its measured energy or, while no recent sample
    exists, nodes x max_watts for the time since the previous tick, between a second and an hour. Ticks are dealt over days."""
    one = ticks.select("ts_ms", "measured_kwh", F.lit(0).alias("_cluster"))
    seen = with_previous(with_last_known(one, "_cluster", "measured_kwh"), "_cluster", "measured_kwh")
    elapsed = F.least(F.greatest((F.col("ts_ms") - F.col("_previous.ts_ms")) / 1000, F.lit(1.0)), F.lit(3600.0))
    recent = F.coalesce(F.col("ts_ms") - F.col("_last.ts_ms") <= staleness_ms, F.lit(False))
    declared = F.when(~recent, elapsed * (nodes * max_watts) / J_PER_KWH)
    out = {"elapsed_s": elapsed, "kwh": F.coalesce("measured_kwh", declared), "provenance": F.when(F.col("measured_kwh").isNotNull(), "measured").when(declared.isNotNull(), "declared")}
    return seen.withColumns(out).drop("_cluster", "_previous", "_last")


def asof_grid_intensity(points: DataFrame, readings: DataFrame, staleness_ms: int) -> DataFrame:
    """points (region, ts_ms) with the newest reading (region, ts_ms, intensity, estimated) that is not staler than the limit.

    One sort a region and hour-of-staleness bucket: readings are copied to the bucket after their own, so a region's history is dealt
    over tasks.
    """
    width = max(staleness_ms, 1)
    bucket = F.floor(F.col("ts_ms") / width)
    given = readings.select("region", "ts_ms", "intensity", "estimated", F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    asked = points.withColumn("bucket", bucket).withColumn("_ask", F.lit(1))
    both = asked.unionByName(given.withColumn("_ask", F.lit(0)), allowMissingColumns=True)
    upto = Window.partitionBy("region", "bucket").orderBy("ts_ms", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    got = F.last(F.when(F.col("_ask") == 0, F.struct("ts_ms", "intensity", "estimated")), ignorenulls=True).over(upto)
    out = both.withColumn("_got", got).filter("_ask = 1").drop("intensity", "estimated")
    fresh = F.col("ts_ms") - F.col("_got.ts_ms") <= staleness_ms
    return out.select(*points.columns, F.when(fresh, F.col("_got.intensity")).alias("intensity"), F.when(fresh, F.col("_got.estimated")).alias("estimated"))


def power_to_energy(power: DataFrame) -> DataFrame:
    """service, ts_ms, watts to service, ts_ms, kwh: the trapezoid since the previous sample; intervals that are not positive are dropped."""
    seconds = (F.col("ts_ms") - F.col("_previous.ts_ms")) / 1000
    kwh = (F.col("_previous.watts") + F.col("watts")) / 2 * seconds / J_PER_KWH
    return with_previous(power, "service", "watts").withColumns({"kwh": kwh, "_s": seconds}).filter("_s > 0").select("service", "ts_ms", "kwh")


def calibrate(spans: DataFrame, readings: DataFrame) -> DataFrame:
    """service, kwh, ops, factor: energy an op over the proxy's, within the time of the readings; services without ops are dropped."""
    bounds = readings.agg(F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi"))
    ops = spans.crossJoin(F.broadcast(bounds)).filter("ts_ms between lo and hi").groupBy("service").agg(F.count(F.lit(1)).alias("ops"))
    kwh = readings.groupBy("service").agg(F.sum("kwh").alias("kwh"))
    return kwh.join(ops, "service").withColumn("factor", F.col("kwh") / F.col("ops") / ENERGY_PER_OP_KWH)


def validate_calibration(factors: DataFrame) -> DataFrame:
    """Services whose factor is above 10, or positive and below 0.1."""
    return factors.filter((F.col("factor") > 10) | ((F.col("factor") > 0) & (F.col("factor") < 0.1)))


def sum_by_label(samples: DataFrame) -> DataFrame:
    """ts, source, label, value: positive, finite values of one label summed."""
    v = F.col("value")
    return samples.filter((v > 0) & ~F.isnan(v) & (v < float("inf"))).groupBy("ts", "source", "label").agg(F.sum("value").alias("value"))
