"""Aggregation of an archive of window reports over a period.

A window row has: file, line, ts_ms, requests, io_ops, energy_kwh (null: not measured), operational_g, embodied_g, transport_g,
models, and per_service arrays of (service, io_ops, energy_kwh, co2_g, measured_ratio). Each operator is one aggregation.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattspan.operators.score import ENERGY_PER_OP_KWH
from wattspan.schema import FINDING_TYPES

DAY_MS = 86_400_000
UNATTRIBUTED = "_unattributed"


def _day_ms(day: str) -> Column:
    return F.unix_millis(F.lit(f"{day} 00:00:00").cast("timestamp"))


def _finite(c: str) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(True))


def _usable() -> Column:
    return _finite("operational_g") & _finite("embodied_g") & _finite("transport_g")


def windows_in_period(windows: DataFrame, first: str, last: str) -> DataFrame:
    """Windows from the first day to the end of the last; windows with carbon that is not finite are dropped (see ``period_counts``)."""
    inside = (F.col("ts_ms") >= _day_ms(first)) & (F.col("ts_ms") < _day_ms(last) + DAY_MS)
    return windows.filter(inside & _usable())


def period_counts(windows: DataFrame, first: str, last: str) -> DataFrame:
    """One row: windows kept and dropped in the period; ``empty`` says that none is left, which no disclosure may have."""
    inside = (F.col("ts_ms") >= _day_ms(first)) & (F.col("ts_ms") < _day_ms(last) + DAY_MS)
    out = windows.filter(inside).agg(F.count_if(_usable()).alias("kept"), F.count_if(~_usable()).alias("dropped"))
    return out.withColumn("empty", F.col("kept") == 0)


def archive_time_range(windows: DataFrame) -> DataFrame:
    return windows.agg(F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))


def window_energy() -> Column:
    return F.coalesce("energy_kwh", F.col("io_ops") * ENERGY_PER_OP_KWH)


def period_totals(windows: DataFrame) -> DataFrame:
    carbon = F.coalesce("operational_g", F.lit(0.0)) + F.coalesce("embodied_g", F.lit(0.0)) + F.coalesce("transport_g", F.lit(0.0))
    return windows.agg(F.count(F.lit(1)).alias("windows"), F.sum("requests").alias("requests"), F.sum("io_ops").alias("io_ops"), F.sum(window_energy()).alias("energy_kwh"), (F.sum(carbon) / 1000).alias("carbon_kg"))


def attribute_services(windows: DataFrame, max_services: int | None = None) -> DataFrame:
    """Requests, ops, energy and grams of each service. Windows with energy by service give it as it is; those with ops by
    service share out energy and grams by ops; others go to one unattributed row. Requests always go by ops. With ``max_services`` the services of fewest ops share the unattributed row, as a live view may want."""
    n = F.when(F.col("per_service").isNull(), 0).otherwise(F.size("per_service"))
    grams = F.coalesce("operational_g", F.lit(0.0))
    total = F.aggregate("per_service", F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x["io_ops"], F.lit(0)))
    each = windows.filter(n > 0).select("requests", window_energy().alias("w_kwh"), grams.alias("w_g"), total.alias("w_ops"), F.exists("per_service", lambda x: x["energy_kwh"].isNotNull()).alias("runtime"), F.explode("per_service").alias("s"))
    share = F.when(F.col("w_ops") > 0, F.col("s.io_ops") / F.col("w_ops")).otherwise(0.0)
    own = each.select(
        F.col("s.service").alias("service"), F.round(F.col("requests") * share).cast("long").alias("requests"), F.col("s.io_ops").alias("io_ops"),
        F.when(F.col("runtime"), F.coalesce("s.energy_kwh", F.lit(0.0))).otherwise(F.col("w_kwh") * share).alias("energy_kwh"), F.when(F.col("runtime"), F.coalesce("s.co2_g", F.lit(0.0))).otherwise(F.col("w_g") * share).alias("co2_g"),
    )
    rest = windows.filter(n <= 0).select(F.lit(UNATTRIBUTED).alias("service"), "requests", "io_ops", window_energy().alias("energy_kwh"), grams.alias("co2_g"))
    sums = own.unionByName(rest).groupBy("service").agg(*(F.sum(c).alias(c) for c in ("requests", "io_ops", "energy_kwh", "co2_g")))
    if max_services is None:
        return sums
    named = sums.filter(F.col("service") != UNATTRIBUTED).orderBy(F.desc("io_ops"), "service").limit(max_services).select("service", F.lit(True).alias("_named"))
    folded = sums.join(F.broadcast(named), "service", "left").groupBy(F.when(F.col("_named"), F.col("service")).otherwise(UNATTRIBUTED).alias("service"))
    return folded.agg(*(F.sum(c).alias(c) for c in ("requests", "io_ops", "energy_kwh", "co2_g")))


def antipattern_rollup(findings: DataFrame) -> DataFrame:
    """findings: service, type, ts_ms, avoidable."""
    return findings.groupBy("service", "type").agg(F.count(F.lit(1)).alias("findings"), F.sum("avoidable").alias("avoidable"), F.min("ts_ms").alias("first_seen"), F.max("ts_ms").alias("last_seen"))


def endpoints_seen(endpoints: DataFrame) -> DataFrame:
    return endpoints.groupBy("service").agg(F.countDistinct("source_endpoint").alias("endpoints"))


def waste_tiers(tiers: DataFrame) -> DataFrame:
    """tiers: tier, io_ops, avoidable, avoidable_kwh, avoidable_g. Ratio between 0 and 1, and efficiency of 100."""
    ratio = F.when(F.col("io_ops") > 0, F.least(F.greatest(F.col("avoidable") / F.col("io_ops"), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    sums = tiers.groupBy("tier").agg(*(F.sum(c).alias(c) for c in ("io_ops", "avoidable", "avoidable_kwh", "avoidable_g")))
    return sums.withColumn("ratio", ratio).withColumn("efficiency", 100 - 100 * F.col("ratio"))


def workload_waste_rollup(blocks: DataFrame) -> DataFrame:
    """blocks: kind, provenance, waste_kwh, waste_g. Estimated energy is not counted in grams."""
    is_ = lambda p: F.count_if(F.col("provenance") == p)
    grams = F.coalesce(F.sum(F.when(F.col("provenance") != "estimated", F.col("waste_g"))), F.lit(0.0))
    return blocks.groupBy("kind").agg(F.count(F.lit(1)).alias("windows"), is_("measured").alias("measured"), is_("declared").alias("declared"), is_("estimated").alias("estimated"), F.sum("waste_kwh").alias("waste_kwh"), grams.alias("waste_g"))


def temporal_coverage(windows: DataFrame, first: str, last: str) -> DataFrame:
    """Observed days, days of the period, their ratio, and the longest run of days without a window, edges included."""
    lo, hi = (F.datediff(F.lit(d).cast("date"), F.lit("1970-01-01").cast("date")) for d in (first, last))
    days = windows.select(F.floor(F.col("ts_ms") / DAY_MS).cast("int").alias("day")).filter((F.col("day") >= lo) & (F.col("day") <= hi)).distinct()
    one = windows.sparkSession.range(1)
    edges = days.unionByName(one.select((lo - 1).alias("day"))).unionByName(one.select((hi + 1).alias("day")))
    gap = F.col("day") - F.lag("day").over(Window.orderBy("day")) - 1  # one row a day of the period
    gaps = edges.withColumn("gap", gap).agg(F.max("gap").alias("largest_gap_days"), (F.count(F.lit(1)) - 2).alias("observed_days"))
    return gaps.withColumn("period_days", hi - lo + 1).withColumn("coverage", F.col("observed_days") / F.col("period_days"))


def period_coverage(windows: DataFrame) -> DataFrame:
    """Share of windows with energy by service; 1 without windows."""
    runtime = F.coalesce(F.exists("per_service", lambda x: x["energy_kwh"].isNotNull()), F.lit(False))
    return windows.agg(F.coalesce(F.avg(runtime.cast("double")), F.lit(1.0)).alias("period_coverage"))


def methodology_sets(windows: DataFrame) -> DataFrame:
    """Distinct models without their calibration suffix and whether any had it; and the distinct versions, methodologies and
    coefficients of windows that have such columns."""
    out = windows.agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform("models", lambda m: F.regexp_replace(m, r"\+cal$", "")))))).alias("models"),
        F.coalesce(F.bool_or(F.exists("models", lambda m: m.endswith("+cal"))), F.lit(False)).alias("calibrated"),
        *(F.sort_array(F.collect_set(c)).alias(f"{c}s") for c in ("version", "methodology", "coefficient") if c in windows.columns),
    )
    return out


def measured_ratios(windows: DataFrame) -> DataFrame:
    return windows.select(F.explode("per_service").alias("s")).groupBy(F.col("s.service").alias("service")).agg(F.avg("s.measured_ratio").alias("measured_ratio"))


def carbon_breakdown(windows: DataFrame, low: float = 0.25, high: float = 1.625, certain: bool = True) -> DataFrame:
    """Kilograms by part; transport with the bounds that the low and high coefficients give."""
    kg = lambda c: F.coalesce(F.sum(c), F.lit(0.0)) / 1000
    out = windows.agg(kg("operational_g").alias("operational_kg"), kg("embodied_g").alias("embodied_kg"), kg("transport_g").alias("transport_kg"))
    bound = lambda r: F.col("transport_kg") * r if certain else F.lit(None).cast("double")
    return out.withColumns({"transport_low_kg": bound(low), "transport_high_kg": bound(high)})


#: What a chain's first line names as its predecessor; an archive of another writer has its own.
SEED = "0" * 64
# Fixed value: the threshold of canonical figures.
CANONICAL_THRESHOLD = 2


class _Literal(str):
    """A number as it was written."""


def canonical_json(value) -> str:
    """Compact JSON with sorted keys and numbers as they were written; value is what ``parse`` gives."""
    import json

    if isinstance(value, _Literal):
        return value
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical_json(v)}" for k, v in sorted(value.items())) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def archive_hash(body: str | None, prev: str | None, seq: int | None) -> str | None:
    """sha256: and the digest of a line's canonical JSON with prev and seq, without its own hash; null for what is no object."""
    import hashlib
    import json

    try:
        line = json.loads(body or "", parse_int=_Literal, parse_float=_Literal)
    except ValueError:
        return None
    if not isinstance(line, dict):
        return None
    line.pop("hash", None)
    if prev is not None:
        line["prev"] = prev
    if seq is not None and seq == seq:
        line["seq"] = _Literal(int(seq))
    return "sha256:" + hashlib.sha256(canonical_json(line).encode("utf-8", "surrogatepass")).hexdigest()


def chain_windows(reports: DataFrame, seed: str = SEED, heads: DataFrame | None = None) -> DataFrame:
    """reports (file, line, body: JSON) with prev, seq, hash, and text, the whole line; a chain a file.

    ``heads`` (file, hash, seq) are the last lines of chains that go on. Each hash holds the one before, so the new lines of a
    file are one group; files are the unit of parallelism. A body that is no JSON object has null in all four and is skipped
    by the chain.
    """

    def run(pdf):
        import json

        pdf = pdf.sort_values("line")
        head = pdf["head"].iloc[0]
        prev, seq = (seed, 0) if head is None else (head["hash"], int(head["seq"]) + 1)
        out = []
        for body in pdf["body"]:
            digest = archive_hash(body, prev, seq)
            if digest is None:
                out.append((None, None, None, None))
                continue
            line = json.loads(body, parse_int=_Literal, parse_float=_Literal) | {"prev": prev, "seq": _Literal(seq), "hash": digest}
            out.append((prev, seq, digest, canonical_json(line)))
            prev, seq = digest, seq + 1
        columns = [pd.Series(list(c), index=pdf.index, dtype=t) for c, t in zip(zip(*out, strict=True), (object, "Int64", object, object), strict=True)]
        pdf["prev"], pdf["seq"], pdf["hash"], pdf["text"] = columns
        return pdf[["file", "line", "body", "prev", "seq", "hash", "text"]]

    rows = reports.select("file", "line", "body")
    none = F.lit(None).cast("struct<hash:string,seq:bigint>")
    rows = rows.withColumn("head", none) if heads is None else rows.join(heads.select("file", F.struct("hash", "seq").alias("head")), "file", "left")
    return rows.groupBy("file").applyInPandas(run, "file string, line long, body string, prev string, seq long, hash string, text string")


def _previous(lines: DataFrame, columns: dict[str, Column], segment: int) -> DataFrame:
    """lines (file, line) with, for each of ``columns``, its last value that is not null in the lines before of the same file.

    Lines are cut into segments of ``segment`` lines; inside one the window looks back, and its first lines take what the
    segments before leave, of which there is one row a segment.
    """
    rows = lines.withColumns({"_segment": F.floor(F.col("line") / segment)} | {f"_{n}": c for n, c in columns.items()})
    inside = Window.partitionBy("file", "_segment").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("file").orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.groupBy("file", "_segment").agg(*(F.max_by(f"_{n}", F.when(F.col(f"_{n}").isNotNull(), F.col("line"))).alias(n) for n in columns))
    left = last.select("file", "_segment", *(F.last(n, ignorenulls=True).over(over).alias(f"_{n}_left") for n in columns))
    seen = rows.withColumns({f"_{n}_in": F.last(f"_{n}", ignorenulls=True).over(inside) for n in columns}).join(left, ["file", "_segment"])
    return seen.withColumns({n: F.coalesce(f"_{n}_in", f"_{n}_left") for n in columns}).drop("_segment", *(f"_{n}{x}" for n in columns for x in ("", "_in", "_left")))


def verify_archive_chain(chained: DataFrame, first: str | None = None, last: str | None = None, seed: str = SEED, segment: int = 50_000) -> DataFrame:
    """Per file: windows, verified, breaks and unchained lines; with the days of a period (and ts_ms) also breaks in and out of it.

    chained: file, line, body (a line as it stands, or without prev, seq and hash), prev, seq, hash. A break is a line whose hash
    is not its own, or that does not follow the hash and number of the line before it (the seed and 0 at the start); after a
    break the stated ones are followed. A line without a hash is unchained while no line before it had one, later it is a
    break, and the next line is taken as it is. Lines that are no JSON object are no windows and are passed over. Lines
    without a number are in sequence. A break counts as in the period if its line or the one before is, or has no time.
    """

    @F.pandas_udf("string")
    def own_hash(body: pd.Series, prev: pd.Series, seq: pd.Series) -> pd.Series:
        return pd.Series([archive_hash(*x) for x in zip(body, prev, seq)], dtype=object)

    dated = first is not None and last is not None
    inside = F.coalesce((F.col("ts_ms") >= _day_ms(first)) & (F.col("ts_ms") < _day_ms(last) + DAY_MS), F.lit(True)) if dated else F.lit(True)
    lines = chained.withColumns({"own": own_hash("body", "prev", "seq"), "inside": inside})
    json, stated = F.col("own").isNotNull(), F.col("hash").isNotNull()
    known = {"anchor": F.when(json, F.struct("hash", "seq")), "started": F.when(json & stated, F.lit(True)), "inside_before": F.col("inside")}
    rows = _previous(lines, known, segment)
    # without an anchor a line that has its own hash is taken as it is
    lost = F.col("anchor").isNotNull() & F.col("anchor.hash").isNull() & F.col("started").isNotNull()
    fresh = F.col("started").isNull()
    follows = F.when(fresh, F.col("prev") == seed).otherwise(F.col("prev") == F.col("anchor.hash"))
    in_sequence = F.col("seq").isNull() | F.when(fresh, F.col("seq") == 0).otherwise(F.coalesce(F.col("seq") == F.col("anchor.seq") + 1, F.lit(True)))
    ok = json & stated & (F.col("own") == F.col("hash")) & (lost | F.coalesce(follows & in_sequence, F.lit(False)))
    rows = rows.withColumns({"json": json, "ok": ok, "unchained": json & ~stated & fresh}).withColumn("broken", F.col("json") & ~F.col("ok") & ~F.col("unchained"))
    counts = [F.count_if("json").alias("windows"), F.count_if("ok").alias("verified"), F.count_if("broken").alias("breaks")]
    if dated:
        scope = F.col("inside") | F.coalesce("inside_before", F.lit(False))
        counts += [F.count_if(F.col("broken") & scope).alias("breaks_in_period"), F.count_if(F.col("broken") & ~scope).alias("breaks_outside"), F.count_if("unchained").alias("unchained")]
    return rows.groupBy("file").agg(*counts)


def _bad(c: str) -> Column:
    """Not a finite number of at least 0."""
    return F.col(c).isNull() | ~_finite(c) | (F.col(c) < 0)


def _violations(rows: DataFrame, rules: dict[str, Column], prefix: Column | None = None) -> DataFrame:
    text = lambda t: F.lit(t) if prefix is None else F.concat(prefix, F.lit(f": {t}"))
    checks = F.array(*[F.when(failed, text(t)) for t, failed in rules.items()])
    return rows.select(F.explode(F.array_compact(checks)).alias("violation"))


def validate_disclosure(aggregate: DataFrame, min_coverage: float = 0.75) -> DataFrame:
    """One row a violated rule of a disclosure: aggregate has the totals, ratios and coverage columns of the operators above, and
    may have potential_kg and canonical_threshold. A value that is no finite number of at least 0 breaks that rule alone."""
    within = lambda c, hi: ~_bad(c) & (F.col(c) > hi)
    covered = ~_bad("period_coverage") & (F.col("period_coverage") <= 1)
    rules = {
        "requests is negative": _bad("requests"), "energy is not finite or negative": _bad("energy_kwh"), "carbon is not finite or negative": _bad("carbon_kg"),
        "waste ratio is not finite or negative": _bad("ratio"), "waste ratio is above 1": within("ratio", 1.0),
        "efficiency is not finite or negative": _bad("efficiency"), "efficiency is above 100": within("efficiency", 100.0),
        "period coverage is outside 0 to 1": ~covered, "period coverage is too low": covered & (F.col("period_coverage") < min_coverage),
        "more days observed than the period has": F.col("observed_days") > F.col("period_days"), "a gap is longer than the period": F.col("largest_gap_days") > F.col("period_days"),
    }
    if "coverage" in aggregate.columns:
        rules["temporal coverage is outside 0 to 1"] = _bad("coverage") | (F.col("coverage") > 1)
    if "potential_kg" in aggregate.columns:
        rules["optimisation potential is not finite or negative"] = _bad("potential_kg")
    if "canonical_threshold" in aggregate.columns:
        rules["canonical threshold is not the fixed one"] = ~F.col("canonical_threshold").eqNullSafe(F.lit(CANONICAL_THRESHOLD))
    return _violations(aggregate, rules)


def validate_tiers(tiers: DataFrame) -> DataFrame:
    """Violations of waste tiers (see ``waste_tiers``): figures that are not finite or negative, ratios outside 0 to 1."""
    rules = {"energy is not finite or negative": _bad("avoidable_kwh"), "carbon is not finite or negative": _bad("avoidable_g"), "ratio is outside 0 to 1": _bad("ratio") | (F.col("ratio") > 1)}
    return _violations(tiers, rules, F.col("tier"))


def validate_waste_blocks(blocks: DataFrame) -> DataFrame:
    """Violations of database and messaging blocks (see ``workload_waste_rollup``); windows_with_carbon is optional."""
    split = F.col("measured") + F.col("declared") + F.col("estimated")
    rules = {
        "energy is not finite or negative": _bad("waste_kwh"), "carbon is not finite or negative": _bad("waste_g"), "block without windows": F.col("windows") == 0,
        "windows by provenance do not add up": (split > 0) & (split != F.col("windows")),
    }
    if "windows_with_carbon" in blocks.columns:
        rules["more windows with carbon than windows"] = F.col("windows_with_carbon") > F.col("windows")
    return _violations(blocks, rules, F.col("kind"))


def validate_applications(patterns: DataFrame) -> DataFrame:
    """Violations of patterns by application (see ``antipattern_rollup``): no service, an unknown type, seen last before first."""
    rules = {
        "service is empty": F.coalesce(F.trim("service") == "", F.lit(True)), "pattern is unknown": ~F.coalesce(F.col("type").isin(*FINDING_TYPES), F.lit(False)),
        "seen last before it was seen first": F.col("last_seen") < F.col("first_seen"),
    }
    return _violations(patterns, rules, F.coalesce("service", F.lit("")))
