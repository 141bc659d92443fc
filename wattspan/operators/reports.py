"""Operators over findings, endpoint counts and database statement statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattspan.schema import SEVERITIES
from wattspan.sources.shared import written

_INVISIBLE = "[\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u2069\\ufeff]"


def _ordinal() -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))


def stamp_confidence(findings: DataFrame, confidence: str = "ci_batch") -> DataFrame:
    return findings.withColumn("confidence", F.lit(confidence))


def finding_signature(findings: DataFrame) -> DataFrame:
    """findings with signature: type:service:endpoint:first 16 bytes of the template's SHA-256."""
    clean = lambda c: F.regexp_replace(c, _INVISIBLE, "")
    endpoint = F.translate(clean(F.col("source_endpoint")), "/ ", "__")
    return findings.withColumn("signature", F.concat_ws(":", "type", clean(F.col("service")), endpoint, F.substring(F.sha2("pattern.template", 256), 1, 32)))


def quality_gate(findings: DataFrame, waste: DataFrame, *, max_critical_sql: int = 0, max_http: int = 3, max_messaging: int = 3, max_waste: float = 0.30, min_usable: float | None = None, usable: float | None = None) -> DataFrame:
    """rule, threshold, actual, passed (null: skipped). The gate passes if no rule failed."""
    n = lambda c: F.count_if(c).cast("double")
    counts = findings.agg(
        n((F.col("type") == "n_plus_one_sql") & (F.col("severity") == "critical")).alias("a"), n((F.col("type") == "n_plus_one_http") & (F.col("severity") != "info")).alias("b"),
        n((F.col("type") == "n_plus_one_messaging") & (F.col("severity") != "info")).alias("c"),
    ).crossJoin(waste.select(F.col("io_waste_ratio").alias("d")))
    rules = [("n_plus_one_sql_critical_max", max_critical_sql, "a"), ("n_plus_one_http_warning_max", max_http, "b"), ("n_plus_one_messaging_warning_max", max_messaging, "c"), ("io_waste_ratio_max", max_waste, "d")]
    rows = [F.struct(F.lit(name).alias("rule"), F.lit(float(limit)).alias("threshold"), F.col(c).alias("actual"), (F.col(c) <= limit).alias("passed")) for name, limit, c in rules]
    if min_usable is not None:
        got = F.lit(usable).cast("double")
        rows.append(F.struct(F.lit("usable_span_ratio_min").alias("rule"), F.lit(float(min_usable)).alias("threshold"), got.alias("actual"), (got >= min_usable).alias("passed")))
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def gate_passed(gate: DataFrame) -> DataFrame:
    return gate.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"))


_IDENTITY = ["type", "service", "gk", "gv", "source_endpoint", "template"]


def finding_identities(findings: DataFrame, with_grouping: bool = True) -> DataFrame:
    """One row an identity: the worst severity and the summed occurrences of its findings."""
    g = F.get("grouping", 0)
    half = lambda c: F.coalesce(c, F.lit("")) if with_grouping else F.lit("")
    keyed = findings.select("type", "service", half(g["key"]).alias("gk"), half(g["value"]).alias("gv"), "source_endpoint", F.col("pattern.template").alias("template"), "severity", F.col("pattern.occurrences").alias("occurrences"))
    return keyed.groupBy(*_IDENTITY).agg(F.min_by("severity", _ordinal()).alias("severity"), F.sum("occurrences").alias("occurrences"))


def compared_findings(before: DataFrame, after: DataFrame, with_grouping: bool = True) -> DataFrame:
    """Identities of both runs, side by side, and their change: new, resolved, regressed, improved or same."""
    a = finding_identities(before, with_grouping).select(*_IDENTITY, F.col("severity").alias("before"), F.col("occurrences").alias("occurrences_before"))
    b = finding_identities(after, with_grouping).select(*_IDENTITY, F.col("severity").alias("after"), F.col("occurrences").alias("occurrences_after"))
    rank = lambda c: F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col(c))
    change = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "resolved").when(rank("after") < rank("before"), "regressed").when(rank("after") > rank("before"), "improved").otherwise("same")
    return a.join(b, _IDENTITY, "full_outer").withColumn("change", change)


def diff_findings(before: DataFrame, after: DataFrame, with_grouping: bool = True) -> DataFrame:
    return compared_findings(before, after, with_grouping).filter(F.col("change").isin("new", "resolved"))


def severity_changes(before: DataFrame, after: DataFrame, with_grouping: bool = True) -> DataFrame:
    """Regressions first."""
    changed = compared_findings(before, after, with_grouping).filter(F.col("change").isin("regressed", "improved"))
    return changed.orderBy(F.desc("change"), *_IDENTITY)


def endpoint_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """Endpoints whose ops changed, largest increase first."""
    key = ["service", "source_endpoint"]
    a, b = before.select(*key, F.col("io_ops").alias("ops_before")), after.select(*key, F.col("io_ops").alias("ops_after"))
    out = a.join(b, key, "full_outer").fillna(0, ["ops_before", "ops_after"]).withColumn("delta", F.col("ops_after") - F.col("ops_before"))
    return out.filter("delta <> 0").orderBy(F.desc("delta"), *key)


def active_acknowledgments(acks: DataFrame, today: str) -> DataFrame:
    """Acks without an expiry or whose expiry day is not over."""
    return acks.filter(F.col("expires_at").isNull() | (F.to_date("expires_at") >= F.lit(today).cast("date")))


def apply_acknowledgments(findings: DataFrame, acks: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """Open and acknowledged findings; findings carry a signature."""
    signatures = active_acknowledgments(acks, today).select("signature").distinct()
    return findings.join(signatures, "signature", "left_anti"), findings.join(signatures, "signature", "left_semi")


def gate_after_acknowledgments(findings: DataFrame, acks: DataFrame, today: str, waste: DataFrame, **limits) -> DataFrame:
    """The gate over the findings that are still open; the waste ratio is that of the whole run."""
    return quality_gate(apply_acknowledgments(findings, acks, today)[0], waste, **limits)


def unmatched_acknowledgments(findings: DataFrame, acks: DataFrame, today: str, observed: DataFrame | None = None) -> DataFrame:
    """Active acks without a finding, and what that means: the endpoint was observed (likely fixed), was not (proves nothing), or
    the ack or the run doesn't say (unknown)."""
    left = active_acknowledgments(acks, today).join(findings.select("signature").distinct(), "signature", "left_anti")
    if observed is None:
        return left.withColumn("status", F.lit("unknown"))
    seen = observed.select("service", F.col("source_endpoint").alias("endpoint"), F.lit(True).alias("_seen")).distinct()
    out = left.join(seen, ["service", "endpoint"], "left")
    status = F.when(F.col("service").isNull() | F.col("endpoint").isNull(), "unknown").when(F.col("_seen"), "likely_fixed").otherwise("not_observed")
    return out.withColumn("status", status).drop("_seen")


def coalesce_findings(stored: DataFrame) -> DataFrame:
    """Stored findings (signature, gk, gv, severity, seen_count, first_seen, last_seen) folded by signature; unsigned rows stay."""
    signed = stored.filter("signature <> ''").groupBy("gk", "gv", "signature").agg(F.sum("seen_count").alias("seen_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.min_by("severity", F.struct(_ordinal(), "first_seen")).alias("severity"))
    return signed.unionByName(stored.filter("signature is null or signature = ''").select(*signed.columns))


def query_findings(findings: DataFrame, service: str | None = None, kind: str | None = None, severity: str | None = None, limit: int | None = None, order: str = "last_timestamp") -> DataFrame:
    """Newest first; ties by type, trace and endpoint."""
    for column, value in (("service", service), ("type", kind), ("severity", severity)):
        if value is not None:
            findings = findings.filter(F.col(column) == value)
    out = findings.orderBy(F.desc(order), "type", "trace_id", "source_endpoint")
    return out if limit is None else out.limit(limit)


def query_coalesced(stored: DataFrame, severity: str | None = None, limit: int | None = None) -> DataFrame:
    """Folded findings (see ``coalesce_findings``), newest first, ties by signature; the severity is that after folding."""
    folded = coalesce_findings(stored)
    kept = folded if severity is None else folded.filter(F.col("severity") == severity)
    out = kept.orderBy(F.desc("last_seen"), "signature", "gk", "gv")
    return out if limit is None else out.limit(limit)


def findings_for_trace(findings: DataFrame, trace_id: str) -> DataFrame:
    return findings.filter(F.col("trace_id") == trace_id)


def _kept(df: DataFrame) -> DataFrame:
    return written(df, "tree")


def explain_tree(spans: DataFrame, findings: DataFrame, max_depth: int = 256) -> DataFrame:
    """spans with depth, path (ids from the root) and the finding types of their template in that trace; and a row without a
    span, depth and path for each template with findings that no span of its trace in the tree has.

    A root has no parent or one outside the data. Paths grow level by level with equi-joins on (trace_id, parent) until no span is
    left, so spans on cycles, which no root reaches, are left out, as are spans below ``max_depth``. Of spans that repeat an
    id, the last by ord has the children. Levels are written to the shared folder.
    """
    last = F.row_number().over(Window.partitionBy("trace_id", "span_id").orderBy(F.desc("ord"))) == 1
    own = _kept(spans.select("trace_id", "span_id", F.col("parent_span_id").alias("parent"), "template", "ts_ms", last.alias("last")))
    known = own.select("trace_id", F.col("span_id").alias("parent")).distinct()
    shown = lambda df, depth, path: df.select("trace_id", "span_id", "template", "ts_ms", F.lit(depth).alias("depth"), path.alias("path"), "last")
    levels = [_kept(shown(own.join(known, ["trace_id", "parent"], "left_anti"), 0, F.array("span_id")))]
    while len(levels) <= max_depth:
        above = levels[-1].filter("last").select("trace_id", F.col("span_id").alias("parent"), F.col("path").alias("_path"))
        level = _kept(shown(own.join(above, ["trace_id", "parent"]), len(levels), F.concat("_path", F.array("span_id"))))
        if level.isEmpty():
            break
        levels.append(level)
    tree = reduce(DataFrame.unionByName, levels).drop("last")
    attached = _kept(findings.groupBy("trace_id", F.col("pattern.template").alias("template")).agg(F.sort_array(F.collect_set("type")).alias("findings")))
    of_trace = attached.join(tree.select("trace_id", "template").distinct(), ["trace_id", "template"], "left_anti")
    return tree.join(attached, ["trace_id", "template"], "left").unionByName(of_trace, allowMissingColumns=True)


def rank_statements(statements: DataFrame, rankings: dict[str, Column], n: int, key: str = "query") -> DataFrame:
    """The n best rows of each ranking: ranking, rank, and the statement's columns. Top-n by ranking, without a global sort."""
    best = [statements.orderBy(by.desc(), key).limit(n).withColumns({"ranking": F.lit(name), "_by": by}) for name, by in rankings.items()]
    rank = F.row_number().over(Window.partitionBy("ranking").orderBy(F.desc("_by"), key))
    return reduce(DataFrame.unionByName, best).withColumn("rank", rank).drop("_by")


def rank_pg_statements(statements: DataFrame, n: int = 10) -> DataFrame:
    c = F.col
    return rank_statements(statements, {"total_time": c("total_exec_time_ms"), "calls": c("calls"), "mean_time": c("mean_exec_time_ms"), "io_blocks": c("shared_blks_hit") + c("shared_blks_read")}, n)


def rank_mysql_digests(digests: DataFrame, n: int = 10) -> DataFrame:
    c = F.col
    return rank_statements(digests, {"total_time": c("total_exec_time_ms"), "calls": c("calls"), "mean_time": c("mean_exec_time_ms"), "rows_examined": c("rows_examined")}, n)


def cross_reference(statements: DataFrame, findings: DataFrame, key=lambda c: c, template: str = "template") -> DataFrame:
    """statements with seen_in_traces: whether a finding has the same template under ``key``."""
    known = findings.select(key(F.col("pattern.template")).alias("_key")).distinct().withColumn("_seen", F.lit(True))
    out = statements.withColumn("_key", key(F.col(template))).join(known, "_key", "left")
    return out.withColumn("seen_in_traces", F.coalesce("_seen", F.lit(False))).drop("_key", "_seen")


def cross_reference_pg(statements: DataFrame, findings: DataFrame) -> DataFrame:
    return cross_reference(statements, findings)


def comparison_key(template: Column) -> Column:
    """Without backticks and white space around punctuation, in lower case."""
    one = F.regexp_replace(F.lower(F.translate(template, "`", "")), r"\s+", " ")
    return F.trim(F.regexp_replace(one, r" ?([^\w\s]) ?", "$1"))


def cross_reference_mysql(digests: DataFrame, findings: DataFrame) -> DataFrame:
    return cross_reference(digests, findings, comparison_key)


def evidence_traces(spans: DataFrame, findings: DataFrame, max_bytes: int, keep: int = 1000) -> DataFrame:
    """Spans of traces with a finding, newest trace first while their summed size fits; a span seen again replaces the older one.

    The budget bounds how many traces can be returned, so their sizes are summed in one ordered window over traces alone.
    """
    seen = spans.join(findings.select("trace_id").distinct(), "trace_id", "left_semi")
    latest = seen.withColumn("_r", F.row_number().over(Window.partitionBy("trace_id", "span_id").orderBy(F.desc("ts_ms"), F.desc("ord")))).filter("_r = 1")
    latest = latest.withColumn("_n", F.row_number().over(Window.partitionBy("trace_id").orderBy(F.desc("ts_ms"), F.desc("ord")))).filter(F.col("_n") <= keep).drop("_r", "_n")
    size = F.octet_length("target") + F.octet_length("span_id") + 64
    sizes = latest.groupBy("trace_id").agg(F.sum(size).alias("bytes"), F.max("ts_ms").alias("newest"))
    # no more than max_bytes / 64 traces can fit
    newest = sizes.orderBy(F.desc("newest"), "trace_id").limit(max_bytes // 64 + 1)
    total = F.sum("bytes").over(Window.orderBy(F.desc("newest"), "trace_id").rowsBetween(Window.unboundedPreceding, 0))
    return latest.join(newest.withColumn("_total", total).filter(F.col("_total") <= max_bytes).select("trace_id"), "trace_id", "left_semi")


SLOW_BUCKETS_MS = (100, 250, 500, 1000, 2500, 5000, 10000)


def metrics_rollup(spans: DataFrame, findings: DataFrame, slow_ms: int, max_services: int | None = None, waste: DataFrame | None = None) -> DataFrame:
    """metric, label, kind, value: findings by type and severity, ops of services, cumulative buckets of slow durations by event
    type; with ``waste`` (see score.io_waste) also the totals of ops and avoidable ops and their ratio.

    With ``max_services`` the least active services share one label, as a live endpoint wants.
    """
    row = lambda df, metric, label, kind: df.select(F.lit(metric).alias("metric"), label.alias("label"), kind.alias("kind"), F.col("value").cast("double").alias("value"))
    none = F.lit("")
    n = F.count(F.lit(1)).alias("value")
    found = row(findings.groupBy("type", "severity").agg(n), "findings", F.col("type"), F.col("severity"))
    ops = spans.groupBy("service").agg(n)
    if max_services is not None:
        named = ops.orderBy(F.desc("value"), "service").limit(max_services).select("service", F.lit(True).alias("_named"))
        ops = ops.join(F.broadcast(named), "service", "left").groupBy(F.when(F.col("_named"), F.col("service")).otherwise("_other").alias("service")).agg(F.sum("value").alias("value"))
    slow = spans.filter(F.col("duration_us") > slow_ms * 1000).select("event_type", F.explode(F.array(*map(F.lit, SLOW_BUCKETS_MS))).alias("le"), "duration_us")
    slow = slow.filter(F.col("duration_us") <= F.col("le") * 1000).groupBy("le", "event_type").agg(n)
    out = found.unionByName(row(ops, "io_ops", F.col("service"), none)).unionByName(row(slow, "slow_duration_bucket", F.col("le").cast("string"), F.col("event_type")))
    if waste is not None:
        totals = [F.struct(F.lit(m).alias("m"), F.col(c).cast("double").alias("value")) for m, c in (("io_ops_total", "total_io_ops"), ("avoidable_io_ops_total", "avoidable"), ("io_waste_ratio", "io_waste_ratio"))]
        each = waste.select(F.explode(F.array(*totals)).alias("t")).select("t.m", "t.value")
        out = out.unionByName(each.select(F.col("m").alias("metric"), none.alias("label"), none.alias("kind"), "value"))
    return out


def sarif_results(findings: DataFrame, acknowledged: bool = False) -> DataFrame:
    """One nested result for each finding (with signature and confidence, and fixes where suggestions were added), ready for a JSON sink."""
    level = F.when(F.col("severity") == "critical", "error").when(F.col("severity") == "warning", "warning").otherwise("note")
    rank = F.when(F.col("confidence") == "daemon_production", 90).when(F.col("confidence") == "daemon_staging", 60).when(F.col("confidence") == "ci_batch", 30).otherwise(15)
    physical = F.when(F.col("code_location.filepath").isNotNull(), F.struct(F.struct(F.col("code_location.filepath").alias("uri")).alias("artifactLocation"), F.struct(F.col("code_location.lineno").alias("startLine")).alias("region")))
    fixes = []
    if "suggested_fix" in findings.columns:
        fix = F.struct(F.struct(F.concat_ws(": ", "suggested_fix.framework", "suggested_fix.recommendation").alias("text")).alias("description"))
        fixes = [F.when(F.col("suggested_fix").isNotNull(), F.array(fix)).alias("fixes")]
    return findings.select(
        *fixes, F.col("type").alias("ruleId"), level.alias("level"), rank.cast("double").alias("rank"), F.struct(F.concat_ws(" ", F.col("type"), F.lit("in"), "source_endpoint", F.lit("of"), "service", F.concat(F.lit("("), F.col("pattern.occurrences"), F.lit(" times):")), "suggestion").alias("text")).alias("message"),
        F.struct(F.concat_ws(" ", "service", "source_endpoint").alias("fullyQualifiedName")).alias("logicalLocation"), physical.alias("physicalLocation"), F.struct(F.col("signature").alias("findingSignature")).alias("partialFingerprints"), F.lit(acknowledged).alias("acknowledged"),
    )
