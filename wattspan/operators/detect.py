"""The twelve anti-pattern detectors over normalised spans. Every detector is DataFrame in, findings out.

Groups are small (one trace's spans of one template), so all detectors are grouped aggregations on keys that begin with
trace_id: their shuffles share one partitioning when the spans are repartitioned by trace_id. A group's representative
span is its first by (ord, span_id).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattspan.schema import FINDING_TYPES, SEVERITIES, Thresholds

_D = Thresholds()
# Words of instrumentation scopes that mark an object-relational mapper.
ORM_MARKERS = (
    "spring-data hibernate jpa micronaut-data jdbi r2dbc entityframeworkcore entity-framework sqlalchemy django "
    "active-record activerecord gorm sequelize prisma typeorm mongoose sea-orm diesel laravel doctrine"
).split()
_ORM = r"(?i)(^|[^a-z0-9])(" + "|".join(ORM_MARKERS) + r")([^a-z0-9]|$)"
_PLACEHOLDER = r"\?|%s|(^|[^@])@[A-Za-z_]|(^|[^:]):[A-Za-z_]|\$\d"



def _identity(half: str) -> Column:
    """Key or value of the first grouping attribute; the empty string stands for none, so keys join and group null-safely."""
    return F.coalesce(F.get("grouping", 0)[half], F.lit(""))


FINDING = (
    "type", "severity", "severity_ord", "type_ord", "trace_id", "service", "grouping", "source_endpoint", "pattern", "suggestion",
    "first_timestamp", "last_timestamp", "classification_method", "code_location", "instrumentation_scopes", "evidence",
)


def _keyed(normalized: DataFrame) -> DataFrame:
    """Spans with their grouping identity as two columns that group and join null-safely, and a 64-bit hash of their parameters."""
    if "same" in normalized.columns:
        return normalized
    return normalized.withColumns({"gk": _identity("key"), "gv": _identity("value"), "same": F.xxhash64("params"), "bare": F.size("params") == 0})


def nearest_rank(sorted_values: Column, percent: int) -> Column:
    """The value at rank ceil(p * n / 100) of a sorted array, in integer arithmetic."""
    return F.get(sorted_values, F.floor((F.size(sorted_values) * percent + 99) / 100).cast("int") - 1)


def variation(n: Column, total: Column, squares: Column) -> Column:
    """Population coefficient of variation in thousandths (0 for one value or a zero mean), from sums: those of whole numbers are
    exact, so the order of the values doesn't matter and a tie is rounded up."""
    return F.when((n > 1) & (total > 0), F.round(F.sqrt(F.greatest(n * squares - total * total, F.lit(0.0))) * 1000 / total)).otherwise(0).cast("int")


def _sums(duration: str = "duration_us") -> tuple[Column, Column, Column]:
    """How many durations, their sum and the sum of their squares."""
    x = F.col(duration).cast("double")
    return F.count(duration), F.sum(x), F.sum(x * x)


def timing_stats(duration: str = "duration_us") -> list[Column]:
    """p50, p99 and ``variation``."""
    ordered = F.sort_array(F.collect_list(duration))
    return [nearest_rank(ordered, 50).alias("p50"), nearest_rank(ordered, 99).alias("p99"), variation(*_sums(duration)).alias("cv")]


def _window_ms() -> Column:
    """Between the smallest and largest timestamp strings; 0 where one can't be read."""
    from wattspan.functions.times import epoch_ms

    return F.greatest(F.coalesce(epoch_ms(F.col("last_timestamp")) - epoch_ms(F.col("first_timestamp")), F.lit(0)), F.lit(0))


def _representative(order: Column | None = None) -> Column:
    first = F.struct("service", "grouping", F.col("source.endpoint").alias("endpoint"), "code", "instrumentation_scopes", "template", "trace_id")
    return F.min_by(first, F.struct("ord", "span_id") if order is None else order).alias("rep")


def _bounds() -> list[Column]:
    return [F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp")]


def _ordinal(value: Column, names: tuple[str, ...]) -> Column:
    return (F.array_position(F.array(*map(F.lit, names)), value) - 1).cast("int")


def _findings(groups: DataFrame, kind: Column, severity: Column, occurrences: Column, distinct: Column, suggestion: Column, template: Column | None = None, timed: bool = True, method: Column | None = None, evidence: Column | None = None, endpoint: Column | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    null = lambda t: F.lit(None).cast(t)
    pattern = F.struct(
        (F.col("rep.template") if template is None else template).alias("template"), occurrences.cast("long").alias("occurrences"), _window_ms().cast("long").alias("window_ms"), distinct.cast("long").alias("distinct_params"),
        (F.col("p50") if timed else null("long")).cast("long").alias("span_duration_us_p50"), (F.col("p99") if timed else null("long")).cast("long").alias("span_duration_us_p99"), (F.col("cv") if timed else null("int")).alias("span_duration_cv_x1000"),
    )
    out = groups.select(
        kind.alias("type"), severity.alias("severity"), _ordinal(severity, SEVERITIES).alias("severity_ord"), _ordinal(kind, FINDING_TYPES).alias("type_ord"), F.col("rep.trace_id").alias("trace_id"),
        F.col("rep.service").alias("service"), F.col("rep.grouping").alias("grouping"), (F.col("rep.endpoint") if endpoint is None else endpoint).alias("source_endpoint"), pattern.alias("pattern"), suggestion.alias("suggestion"),
        "first_timestamp", "last_timestamp", (null("string") if method is None else method).alias("classification_method"), F.col("rep.code").alias("code_location"), F.col("rep.instrumentation_scopes").alias("instrumentation_scopes"),
        (null("array<string>") if evidence is None else evidence).alias("evidence"), *also,
    )
    return out.select(*FINDING, *also)


def _short(event_type: str = "event_type") -> Column:
    return F.when(F.col(event_type) == "http_out", F.lit("http")).otherwise(F.col(event_type))


_GROUP = ("trace_id", "event_type", "template", "gk", "gv")


def _frequent(spans: DataFrame, minimum: int, *keys: str) -> DataFrame:
    """spans without those of groups of fewer than ``minimum``. Groups are counted by a 64-bit hash of their keys, before texts
    and lists of them are gathered; two that share a hash only stay longer."""
    hashed = spans.withColumn("_group", F.xxhash64(*keys))
    many = hashed.groupBy("trace_id", "_group").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= minimum)
    return hashed.join(many.select("trace_id", "_group"), ["trace_id", "_group"], "left_semi").drop("_group")


def sequential_siblings(normalized: DataFrame) -> DataFrame:
    """Per (trace, type, template, grouping): whether at least three spans of one parent run strictly one after the other."""
    in_order = Window.partitionBy(*_GROUP).orderBy("ts_ms", "ord", "span_id")
    ends = F.lag(F.col("ts_ms") * 1000 + F.col("duration_us")).over(in_order)
    parent = F.nullif("parent_span_id", F.lit(""))
    timed = _keyed(normalized).filter("ts_ms is not null").withColumns({"fits": F.coalesce(ends <= F.col("ts_ms") * 1000, F.lit(True)), "parent": parent})
    return timed.groupBy(*_GROUP).agg(((F.count(F.lit(1)) >= 3) & F.bool_and("fits") & (F.count("parent") == F.count(F.lit(1))) & (F.min("parent") == F.max("parent"))).alias("sequential"))


#: The keys of a group, those of its template first: windows over templates and over groups share one order of the rows.
_CALL = ("trace_id", "template", "gk", "gv", "event_type")


def _calls(normalized: DataFrame, thresholds: list[int], window_ms: int, mode: str) -> DataFrame:
    """A row for the spans of one group that have the same parameters, with what the rules need of the call (c, ids, bounds, rep)
    and of its group (n, distinct, cv); ``leads`` marks one row a group. For each threshold, by its place in the list: ``direct_0``,
    ``hit_0`` (the group is an N+1 finding) and ``fired_0`` (so is a group of the call's template).

    All groups begin with the trace, and windows take the place of joins: spans that are dealt by trace are read once and
    stay where they are.
    """
    spans = _keyed(normalized).filter("trace_id is not null")
    group = Window.partitionBy(*_CALL)
    place = F.row_number().over(group.orderBy(F.asc_nulls_last("duration_us")))
    at = lambda p: F.when(place == F.floor((F.count("duration_us").over(group) * p + 99) / 100), F.col("duration_us"))
    spans = spans.withColumns({"p50": at(50), "p99": at(99)})
    in_turn = []
    if mode == "strict":
        before = F.lag(F.col("ts_ms") * 1000 + F.col("duration_us")).over(group.orderBy(F.asc_nulls_last("ts_ms"), "ord", "span_id"))
        timed, parent = F.col("ts_ms").isNotNull(), F.when(F.col("ts_ms").isNotNull(), F.nullif("parent_span_id", F.lit("")))
        spans = spans.withColumns({"fits": ~timed | F.coalesce(before <= F.col("ts_ms") * 1000, F.lit(True)), "timed": timed, "parent": parent})
        in_turn = [F.bool_and("fits").alias("fits"), F.count_if("timed").alias("timed"), F.count("parent").alias("parents"), F.min("parent").alias("lowest"), F.max("parent").alias("highest")]
    k, total, squares = _sums()
    orm = F.exists(F.coalesce("instrumentation_scopes", F.array().cast("array<string>")), lambda s: s.rlike(_ORM))
    calls = spans.groupBy(*_CALL, "same").agg(
        F.count(F.lit(1)).alias("c"), F.bool_and("bare").alias("bare"), F.bool_or(orm).alias("orm"), F.max("p50").alias("p50"), F.max("p99").alias("p99"), k.alias("k"), total.alias("total"), squares.alias("squares"),
        F.collect_list("span_id").alias("ids"), F.min("timestamp").alias("call_first"), F.max("timestamp").alias("call_last"), _representative().alias("call_rep"), F.min(F.struct("ord", "span_id")).alias("at"), *in_turn,
    )
    over = lambda c: c.over(group)
    first = F.struct("at", "same")
    calls = calls.withColumns({
        "n": over(F.sum("c")), "distinct": over(F.count(F.lit(1))), "bare": over(F.bool_and("bare")), "orm": over(F.bool_or("orm")), "p50": over(F.max("p50")), "p99": over(F.max("p99")),
        "cv": variation(over(F.sum("k")), over(F.sum("total")), over(F.sum("squares"))), "first_timestamp": over(F.min("call_first")), "last_timestamp": over(F.max("call_last")), "rep": over(F.min_by("call_rep", first)), "leads": over(F.min(first))["same"] == F.col("same"),
    })
    sql, http, publish = (F.col("event_type") == t for t in ("sql", "http_out", "messaging"))
    varied = (F.col("cv") > 500) & (F.col("n") >= 3)
    placeholder = F.col("bare") & F.col("template").rlike(_PLACEHOLDER)
    if mode == "strict":
        all_timed = over(F.sum("timed"))
        sequential = F.coalesce((all_timed >= 3) & over(F.bool_and("fits")) & (over(F.sum("parents")) == all_timed) & (over(F.min("lowest")) == over(F.max("highest"))), F.lit(False))
        calls = calls.withColumn("sequential", sequential)

    def rules(threshold: int) -> tuple[Column, Column]:
        direct, often = publish | (F.col("distinct") >= threshold), F.col("n") >= 3 * threshold
        if mode == "strict":
            in_row = F.col("sequential")
            guess = sql & placeholder & (F.col("orm") | often | in_row) & (varied | often) | http & (F.col("template").contains("{") | often | in_row) & varied
        else:
            guess = {"never": F.lit(False), "always": sql & placeholder | http, "auto": sql & placeholder & (F.col("orm") | varied) | http & varied}[mode]
        # timestamps are read only where all else holds
        return direct, F.coalesce(F.when((F.col("n") >= threshold) & (direct | guess), _window_ms() <= window_ms), F.lit(False))

    for i, (direct, hit) in enumerate(map(rules, thresholds)):
        calls = calls.withColumns({f"direct_{i}": direct, f"hit_{i}": hit})
    template = Window.partitionBy(*_CALL[:-1])
    return calls.withColumns({f"fired_{i}": F.max(f"hit_{i}").over(template) for i in range(len(thresholds))})


def _repeats(normalized: DataFrame, tiers: dict[str, int], window_ms: int, mode: str, n_plus_one: bool, redundant: bool) -> DataFrame:
    """Findings of each threshold, with the name of its tier."""
    calls = _calls(normalized, list(tiers.values()), window_ms, mode)
    kinds = []
    for i, tier in enumerate(tiers):
        kind = lambda whole: F.struct(F.lit(tier).alias("tier"), F.lit(whole).alias("whole"), F.col(f"direct_{i}").alias("direct"))  # noqa: B023, E731
        again = ~F.col(f"fired_{i}") & (F.col("c") >= 2) & (F.col("event_type") != "messaging")
        kinds += [F.when(F.col(f"hit_{i}") & F.col("leads"), kind(True))] * n_plus_one + [F.when(again, kind(False))] * redundant
    rows = calls.withColumn("kind", F.explode(F.array_compact(F.array(*kinds)))).withColumns({c: F.col(f"kind.{c}") for c in ("tier", "whole", "direct")})
    whole, n = F.col("whole"), F.col("n")
    either = lambda a, b: F.when(whole, a).otherwise(b)
    rows = rows.withColumns({
        "n": either(n, F.col("c")), "p50": F.when(whole, F.col("p50")), "p99": F.when(whole, F.col("p99")), "cv": F.when(whole, F.col("cv")), "rep": either(F.col("rep"), F.col("call_rep")),
        "first_timestamp": either(F.col("first_timestamp"), F.col("call_first")), "last_timestamp": either(F.col("last_timestamp"), F.col("call_last")),
    })
    sql, http = (F.col("event_type") == t for t in ("sql", "http_out"))
    method = F.when(whole & ~F.col("direct"), F.lit("sanitizer_heuristic"))
    distinct = F.when(~whole | (F.col("event_type") == "messaging") | (sql & ~F.col("direct")), F.lit(1)).otherwise(F.col("distinct"))
    kind = F.concat(either(F.lit("n_plus_one_"), F.lit("redundant_")), _short())
    severity = either(F.when(n >= 10, F.lit("critical")).otherwise(F.lit("warning")), F.when(n >= 5, F.lit("warning")).otherwise(F.lit("info")))
    said = F.when(sql, F.lit("Fetch the rows of one request with one statement instead of a statement a row.")).when(http, F.lit("Ask for all items in one call instead of a call an item.")).otherwise(F.lit("Publish the messages of one request as a batch."))
    said = either(said, F.lit("Keep the first result for the rest of the request."))
    return _findings(rows, kind, severity, n, distinct, said, method=method, evidence=F.when(~whole, F.sort_array("ids")), also=("tier",))


def detect_n_plus_one(normalized: DataFrame, threshold: int = _D.n_plus_one, window_ms: int = _D.window_ms, mode: str = _D.sanitizer) -> DataFrame:
    """Repeated calls of one template in a trace: with distinct parameters, as publishes, or (statements whose parameters were
    removed, and URLs) by the heuristics of ``mode``: never, auto, always or strict."""
    return _repeats(normalized, {"": threshold}, window_ms, mode, True, False).drop("tier")


def detect_repeats(normalized: DataFrame, threshold: int = _D.n_plus_one, window_ms: int = _D.window_ms, mode: str = _D.sanitizer, n_plus_one: bool = True) -> DataFrame:
    """N+1 findings (unless left out) and the redundant ones beside them, as ``detect_n_plus_one`` and ``detect_redundant`` give them, from one pass over the spans."""
    return _repeats(normalized, {"": threshold}, window_ms, mode, n_plus_one, True).drop("tier")


def repeats_by_tier(normalized: DataFrame, tiers: dict[str, int], window_ms: int = _D.window_ms, mode: str = _D.sanitizer) -> DataFrame:
    """The findings that ``detect_repeats`` gives at each of several thresholds, with the name of its tier, from one pass over the spans."""
    return _repeats(normalized, tiers, window_ms, mode, True, True)


def _redundant_groups(normalized: DataFrame, n_plus_one: DataFrame) -> DataFrame:
    keyed = _frequent(_keyed(normalized).filter("event_type <> 'messaging'"), 2, *_GROUP, "same")
    fired = n_plus_one.select("trace_id", F.col("pattern.template").alias("template"), _identity("key").alias("gk"), _identity("value").alias("gv")).distinct()
    groups = keyed.groupBy(*_GROUP, "same").agg(F.count(F.lit(1)).alias("n"), F.collect_list("span_id").alias("ids"), *_bounds(), _representative())
    return groups.filter("n >= 2").join(fired, ["trace_id", "template", "gk", "gv"], "left_anti")


def detect_redundant(normalized: DataFrame, n_plus_one: DataFrame) -> DataFrame:
    """The same call with the same parameters twice or more in a trace, unless its template already is an N+1 finding there."""
    severity = F.when(F.col("n") >= 5, F.lit("warning")).otherwise(F.lit("info"))
    return _findings(_redundant_groups(normalized, n_plus_one), F.concat(F.lit("redundant_"), _short()), severity, F.col("n"), F.lit(1), F.lit("Keep the first result for the rest of the request."), timed=False, evidence=F.sort_array("ids"))


def _slow(normalized: DataFrame, slow_ms: int) -> DataFrame:
    return _keyed(normalized).filter(F.col("duration_us") > slow_ms * 1000)


def detect_slow(normalized: DataFrame, slow_ms: int = _D.slow_ms, minimum: int = _D.slow_min) -> DataFrame:
    """Templates with at least ``minimum`` calls over the limit in a trace."""
    groups = _slow(normalized, slow_ms).groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("n"), F.max("duration_us").alias("most"), F.countDistinct("same").alias("distinct"), *timing_stats(), *_bounds(), _representative())
    severity = F.when(F.col("most") > 5 * slow_ms * 1000, F.lit("critical")).otherwise(F.lit("warning"))
    return _findings(groups.filter(F.col("n") >= minimum), F.concat(F.lit("slow_"), _short()), severity, F.col("n"), F.col("distinct"), F.concat(F.lit("Slowest call took "), F.floor(F.col("most") / 1000), F.lit(" ms.")))


def detect_slow_cross_trace(normalized: DataFrame, slow_ms: int = _D.slow_ms, minimum: int = _D.slow_min) -> DataFrame:
    """Templates that are slow in at least two traces; the slowest span represents them. Percentiles come from counts of
    equal durations, so a template that every trace calls costs a row for each duration, not for each span."""
    slow = _slow(normalized, slow_ms)
    keys = ["event_type", "template", "gk", "gv"]
    each = slow.groupBy(*keys, "duration_us").agg(F.count(F.lit(1)).alias("c"))
    total = Window.partitionBy(*keys)
    ranked = each.withColumns({"upto": F.sum("c").over(total.orderBy("duration_us")), "n": F.sum("c").over(total)})
    at = lambda p: F.min(F.when(F.col("upto") >= F.floor((F.col("n") * p + 99) / 100), F.col("duration_us")))
    ranks = ranked.groupBy(*keys).agg(at(50).alias("p50"), at(95).alias("p95"), at(99).alias("p99"))
    slowest = _representative(F.struct(-F.col("duration_us"), "trace_id", "span_id"))
    groups = slow.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("trace_id").alias("traces"), F.max("duration_us").alias("most"), variation(*_sums()).alias("cv"), *_bounds(), slowest).join(ranks, keys)
    hit = groups.filter((F.col("n") >= minimum) & (F.col("traces") >= 2) & (F.col("p99") > slow_ms * 1000))
    severity = F.when(F.col("p99") > 5 * slow_ms * 1000, F.lit("critical")).otherwise(F.lit("warning"))
    text = F.format_string("p50 %d, p95 %d and p99 %d ms over %d traces.", *(F.floor(F.col(p) / 1000) for p in ("p50", "p95", "p99")), F.col("traces"))
    return _findings(hit, F.concat(F.lit("slow_"), _short()), severity, F.col("n"), F.lit(0), text)


def _children(normalized: DataFrame) -> DataFrame:
    return normalized.filter("parent_span_id is not null and parent_span_id <> ''")


def detect_fanout(normalized: DataFrame, maximum: int = _D.fanout) -> DataFrame:
    """Parents with more than ``maximum`` children; a parent outside the data is named by its id. Each span stands once under its
    own id and once under its parent's, so one grouping finds parents and children."""
    child = F.col("parent_span_id").isNotNull() & (F.col("parent_span_id") != "")
    own = F.struct("service", "grouping", F.col("source.endpoint").alias("endpoint"), "code", "instrumentation_scopes", "template", "trace_id")
    place = lambda id_, is_child: F.struct(F.col(id_).alias("parent"), F.lit(is_child).alias("child"))
    places = F.when(child, F.array(place("span_id", False), place("parent_span_id", True))).otherwise(F.array(place("span_id", False)))
    spans = normalized.filter("trace_id is not null").select("trace_id", "span_id", "ord", "timestamp", own.alias("own"), F.explode(places).alias("x")).select("*", "x.*")
    of = lambda c: F.when(F.col("child"), c)
    groups = spans.groupBy("trace_id", "parent").agg(
        F.count_if("child").alias("n"), F.min(of(F.col("timestamp"))).alias("first_timestamp"), F.max(of(F.col("timestamp"))).alias("last_timestamp"), F.min_by("own", of(F.struct("ord", "span_id"))).alias("first_child"),
        F.max_by("own", F.when(~F.col("child"), F.col("ord"))).alias("own"), F.collect_list(of(F.col("span_id"))).alias("ids"),
    )
    found = groups.filter(F.col("n") > maximum).withColumn("rep", F.coalesce("own", "first_child"))
    template = F.when(F.col("own").isNull(), F.concat(F.lit("parent:"), "parent")).otherwise(F.col("own.template"))
    severity = F.when(F.col("n") > 3 * maximum, F.lit("critical")).otherwise(F.lit("warning"))
    return _findings(found, F.lit("excessive_fanout"), severity, F.col("n"), F.col("n"), F.lit("Bundle the children of one operation, or bound how many start at once."), template=template, timed=False, evidence=F.sort_array("ids"))


def detect_chatty(normalized: DataFrame, minimum: int = _D.chatty) -> DataFrame:
    """Traces with more than ``minimum`` outbound calls of a group, with the two most frequent templates."""
    calls = _keyed(normalized).filter("event_type = 'http_out' and trace_id is not null")
    each = calls.groupBy("trace_id", "gk", "gv", "template").agg(F.count(F.lit(1)).alias("c"), *_bounds(), _representative(), F.min(F.struct("ord", "span_id")).alias("at"))
    rank = Window.partitionBy("trace_id", "gk", "gv").orderBy(F.desc("c"), "template")
    groups = each.withColumn("r", F.row_number().over(rank)).groupBy("trace_id", "gk", "gv").agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("distinct"), F.min("first_timestamp").alias("first_timestamp"), F.max("last_timestamp").alias("last_timestamp"), F.min_by("rep", "at").alias("rep"),
        F.array_sort(F.collect_list(F.when(F.col("r") <= 2, F.struct("r", "template", "c")))).alias("top"),
    ).filter(F.col("n") > minimum)
    severity = F.when(F.col("n") > 3 * minimum, F.lit("critical")).otherwise(F.lit("warning"))
    text = F.concat(F.lit("Most frequent: "), F.array_join(F.transform("top", lambda t: F.concat(t["template"], F.lit(" ("), t["c"].cast("string"), F.lit(")"))), ", "))
    return _findings(groups, F.lit("chatty_service"), severity, F.col("n"), F.col("distinct"), text, template=F.col("rep.endpoint"), timed=False)


#: Microseconds of a block of the scan over open statements; it has a row for each different time in it.
BLOCK_US = 1_000_000
#: A parent with more children than this is scanned in blocks of time as well.
LARGE_PARENT = 10_000


#: Statements are counted by service.
_POOL = ("trace_id", "service", "gk", "gv")


def _steps(normalized: DataFrame) -> DataFrame:
    """Per service, block and time: how many statements start (up) and end (down) then, s (starts less ends so far in the block) and
    low (the lowest s so far, once a time's ends are counted); of the statements that start, n, bounds and the representative."""
    sql = _keyed(normalized).filter("event_type = 'sql' and trace_id is not null and service is not null")
    start, timed = F.col("ts_ms") * 1000, F.col("ts_ms").isNotNull()
    first = F.struct("service", "grouping", F.col("source.endpoint").alias("endpoint"), "code", "instrumentation_scopes", "template", "trace_id")
    own = F.struct("timestamp", F.struct("ord", "span_id").alias("at"), first.alias("rep"))
    step = lambda t, up, down, own: F.struct(t.alias("t"), up.alias("up"), down.alias("down"), own.alias("own"))
    begin, end = step(start, timed.cast("int"), F.lit(0), own), step(start + F.col("duration_us"), F.lit(0), F.lit(1), F.when(F.lit(False), own))
    steps = sql.select(*_POOL, F.explode(F.when(timed, F.array(begin, end)).otherwise(F.array(begin))).alias("x")).select(*_POOL, F.floor(F.col("x.t") / BLOCK_US).alias("block"), "x.*")
    times = steps.groupBy(*_POOL, "block", "t").agg(
        F.sum("up").alias("up"), F.sum("down").alias("down"), F.count("own").alias("n"), F.min("own.timestamp").alias("first_timestamp"), F.max("own.timestamp").alias("last_timestamp"), F.min("own.at").alias("at"), F.min_by("own.rep", "own.at").alias("rep"),
    )
    within = Window.partitionBy(*_POOL, "block").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return times.withColumn("s", F.sum(F.col("up") - F.col("down")).over(within)).withColumn("low", F.min(F.col("s") - F.col("up")).over(within))


def _before(blocks: DataFrame) -> DataFrame:
    """blocks (total, lowest) with what the earlier blocks leave: before, the sum of starts less ends, and low_before, the lowest that it has been."""
    earlier = Window.partitionBy(*_POOL).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("before", F.coalesce(F.sum("total").over(earlier), F.lit(0))).withColumn("low_before", F.coalesce(F.min(F.col("before") + F.col("lowest")).over(earlier), F.lit(0)))


_TOTALS = lambda: [F.sum(F.col("up") - F.col("down")).alias("total"), F.min("low").alias("lowest")]


def _concurrency(normalized: DataFrame, threshold: int = 0) -> DataFrame:
    """Open statements after each time at which one starts or ends; ends come before starts of the same time, and it stops at 0.

    What is open is the running sum of starts less ends, above the lowest that it has been. Both are scanned in two levels:
    within blocks of a second, whose rows are different times, and over the sums and lowest points of the blocks. So a trace
    with very many statements is spread over its blocks. Services with fewer than ``threshold`` statements are left out.
    """
    walked = _steps(normalized).filter("t is not null")
    blocks = _before(walked.groupBy(*_POOL, "block").agg(*_TOTALS(), F.sum("n").alias("n"))).withColumn("n", F.sum("n").over(Window.partitionBy(*_POOL)))
    blocks = blocks.filter(F.col("n") >= threshold).select(*_POOL, "block", "before", "low_before")
    lowest = F.least(F.lit(0), F.col("low_before"), F.col("before") + F.col("low"))
    return walked.join(blocks, [*_POOL, "block"]).select(*_POOL, "t", (F.col("before") + F.col("s") - lowest).alias("open"))


def _peaks(normalized: DataFrame, threshold: int) -> DataFrame:
    """Of each service with at least ``threshold`` statements of a trace open at once (see ``_concurrency``): that peak and its first
    time, n, bounds and representative of its statements. The spans are read once and nothing is joined.

    Whatever the earlier blocks leave, a block is fullest where s is largest or where s is furthest above low.
    """
    at = lambda x: F.max(F.struct(x.alias("open"), (-F.col("t")).alias("t")))
    kept = [F.sum("n").alias("n"), F.min("first_timestamp").alias("first_timestamp"), F.max("last_timestamp").alias("last_timestamp"), F.min_by("rep", "at").alias("rep")]
    blocks = _steps(normalized).groupBy(*_POOL, "block").agg(*_TOTALS(), at(F.col("s")).alias("high"), at(F.col("s") - F.col("low")).alias("rise"), *kept, F.min("at").alias("at"))
    high = F.struct((F.col("before") - F.least(F.lit(0), F.col("low_before")) + F.col("high.open")).alias("open"), F.col("high.t").alias("t"))
    groups = _before(blocks).groupBy(*_POOL).agg(F.max(F.greatest(high, "rise")).alias("top"), *kept)
    return groups.filter(F.col("top.open") >= threshold).withColumns({"peak": F.col("top.open"), "peak_t": -F.col("top.t")})


def detect_pool_saturation(normalized: DataFrame, threshold: int = _D.pool) -> DataFrame:
    """Services with at least ``threshold`` statements of a trace open at once."""
    return _findings(_peaks(normalized, threshold), F.lit("pool_saturation"), F.lit("warning"), F.col("peak"), F.col("n"), F.format_string("%d statements were open at once.", F.col("peak")), template=F.col("rep.service"), timed=False)


def pool_peak_spans(normalized: DataFrame, threshold: int = _D.pool) -> DataFrame:
    """The statements that are open at the first peak of a saturated pool: trace_id, service, span_id."""
    sql = _keyed(normalized).filter("event_type = 'sql' and ts_ms is not null and duration_us > 0").select(*_POOL, "span_id", "ts_ms", "duration_us")
    start = F.col("ts_ms") * 1000
    peak = _peaks(normalized, threshold).select(*_POOL, "peak_t")
    return sql.join(peak, list(_POOL)).filter((start <= F.col("peak_t")) & (F.col("peak_t") < start + F.col("duration_us"))).select("trace_id", "service", "span_id")


def _longest_chain(spans: list[dict]) -> list[str]:
    """Of some children of one parent the longest chain that never overlaps: spans by end, then start order; inclusion on ties."""
    from bisect import bisect_right

    spans = sorted(spans, key=lambda s: s["end"])
    ends = [s["end"] for s in spans]
    before = [min(bisect_right(ends, s["start"]), i) for i, s in enumerate(spans)]
    best = [0]
    for i in range(len(spans)):
        best.append(max(best[i], best[before[i]] + 1))
    chain, i = [], len(spans)
    while i:
        if best[before[i - 1]] + 1 >= best[i - 1]:
            chain.append(spans[i - 1]["span_id"])
            i = before[i - 1]
        else:
            i -= 1
    return chain[::-1]


def _chain_places(starts, ends):
    """For each segment, whose children are in order of start, ord and id, the places of its longest chain."""
    import pyarrow as pa

    own = ([0] if len(a) == 1 else _longest_chain([{"start": x, "end": y, "span_id": i} for i, (x, y) in enumerate(zip(a, b))]) for a, b in zip(starts.to_pylist(), ends.to_pylist()))
    return pa.array(own, pa.list_(pa.int32()))


def _cut(rows: DataFrame, by: list[str], reach: Column) -> DataFrame:
    """rows with segment, the running count of the starts at which nothing that began before them, nor ``reach``, still runs."""
    in_order = Window.partitionBy(*by).orderBy("start", "ord", "span_id")
    latest = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    idle = rows.withColumn("idle", F.coalesce(F.col("start") >= F.greatest(latest, reach), F.lit(True)).cast("long"))
    return idle.withColumn("segment", F.sum("idle").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def busy_segments(children: DataFrame, large: int = LARGE_PARENT) -> DataFrame:
    """children (trace_id, parent, n, start, end, ord, span_id) with segment: a parent's children are cut wherever none of them runs.

    Parents of over ``large`` children are scanned in two levels, within blocks of time and over the blocks, so that their
    children are spread; the segments are the same.
    """
    keys = ["trace_id", "parent"]
    none = F.lit(None).cast("long")
    small = _cut(children.filter(F.col("n") <= large), keys, none)
    rows = children.filter(F.col("n") > large).withColumn("block", F.floor(F.col("start") / BLOCK_US))
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy(*keys, "block").agg(F.max("end").alias("top"))
    reach = tops.select(*keys, "block", F.max("top").over(earlier).alias("reach"))
    cut = _cut(rows.join(reach, [*keys, "block"]), [*keys, "block"], F.col("reach"))
    counts = cut.groupBy(*keys, "block").agg(F.sum("idle").alias("own"))
    seen = counts.select(*keys, "block", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("seen"))
    spread = cut.join(seen, [*keys, "block"]).withColumn("segment", F.col("segment") + F.col("seen"))
    return small.drop("idle").unionByName(spread.drop("idle", "block", "reach", "seen"))


def _chained(normalized: DataFrame, minimum: int, large: int | None, *columns) -> DataFrame:
    """trace_id, parent, span_id and own (a struct of ``columns``) of each span of the longest chain of siblings that never overlap; of parents with enough children only.

    Spans of different segments never overlap, so a parent's longest chain is that of each of its segments, one after the
    other, ties included. Python gets starts and ends of a segment, nothing else. ``large``: None where the spans are dealt
    by trace, so that all children of a parent are in one task anyway and are scanned there at once; spans are read once then.
    """
    keys = ["trace_id", "parent"]
    start = F.col("ts_ms") * 1000
    timed = _children(normalized).filter("ts_ms is not null and trace_id is not null").select(
        "trace_id", F.col("parent_span_id").alias("parent"), "span_id", "ord", "template", start.alias("start"), (start + F.col("duration_us")).alias("end"), F.struct(*columns).alias("own"))
    several = (F.col("n") >= minimum) & (F.col("a") != F.col("b"))
    if large is None:
        whole = Window.partitionBy(*keys).orderBy("start", "ord", "span_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        counted = timed.withColumns({"n": F.count(F.lit(1)).over(whole), "a": F.min("template").over(whole), "b": F.max("template").over(whole)}).filter(several)
        segments = _cut(counted, keys, F.lit(None).cast("long"))
    else:
        enough = timed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("template").alias("a"), F.max("template").alias("b"))
        segments = busy_segments(timed.drop("template").join(enough.filter(several).select(*keys, "n"), keys), large)
    groups = segments.groupBy(*keys, "segment").agg(F.sort_array(F.collect_list(F.struct("start", "ord", "span_id", "end", "own"))).alias("spans"))
    chain = F.arrow_udf(_chain_places, "array<int>")(F.col("spans.start"), F.col("spans.end"))
    places = groups.select(*keys, "spans", chain.alias("chain")).select(*keys, "spans", F.explode("chain").alias("i"))
    return places.select(*keys, F.get("spans", "i").alias("x")).select(*keys, "x.span_id", "x.ord", "x.own")


def serialized_chains(normalized: DataFrame, minimum: int = _D.serialized, large: int | None = LARGE_PARENT) -> DataFrame:
    """trace_id, parent and span_id of each span of the longest chain of siblings that never overlap; of parents with enough children only."""
    return _chained(normalized, minimum, large, "ord").select("trace_id", "parent", "span_id")


def detect_serialized(normalized: DataFrame, minimum: int = _D.serialized, large: int | None = LARGE_PARENT) -> DataFrame:
    """Siblings that run one after the other although their templates differ. ``large``: see ``busy_segments``, None where spans are dealt by trace."""
    spans = _chained(normalized, minimum, large, "timestamp", "duration_us", "service", "grouping", "source", "code", "instrumentation_scopes", "template").select("trace_id", "parent", "span_id", "ord", "own.*")
    groups = spans.groupBy("trace_id", "parent").agg(F.count(F.lit(1)).alias("n"), F.min("template").alias("a"), F.max("template").alias("b"), F.collect_set("template").alias("templates"), F.sum("duration_us").alias("total"), F.max("duration_us").alias("most"), F.collect_list("span_id").alias("ids"), *_bounds(), _representative())
    groups = groups.filter((F.col("n") >= minimum) & (F.col("a") != F.col("b"))).withColumn("distinct", F.size("templates"))
    text = F.format_string("%d calls take %d ms in a row; at once they would take %d ms.", F.col("n"), F.floor(F.col("total") / 1000), F.floor(F.col("most") / 1000))
    return _findings(groups, F.lit("serialized_calls"), F.lit("info"), F.col("n"), F.col("distinct"), text, timed=False, evidence=F.sort_array("ids"))


def finding_evidence(findings: DataFrame) -> DataFrame:
    """One row for each span behind a redundant, fan-out or serialised finding."""
    return findings.filter("evidence is not null").select("type", "trace_id", "source_endpoint", F.col("pattern.template").alias("template"), F.explode("evidence").alias("span_id"))


def redundant_spans(normalized: DataFrame, n_plus_one: DataFrame | None = None, **limits) -> DataFrame:
    """The spans of redundant findings: beside the given N+1 findings, or beside those of ``limits`` in one pass."""
    return finding_evidence(detect_repeats(normalized, n_plus_one=False, **limits) if n_plus_one is None else detect_redundant(normalized, n_plus_one))


def sort_findings(findings: DataFrame) -> DataFrame:
    """findings in their order. They are shuffled once before: the bounds of a sort come from a first pass over its input, which
    would run the detectors twice."""
    return findings.repartition("trace_id").orderBy("type_ord", "severity_ord", "trace_id", "source_endpoint", "pattern.template")


_NEEDED = ("timestamp", "ts_ms", "trace_id", "span_id", "parent_span_id", "service", "grouping", "event_type", "duration_us", "code", "instrumentation_scopes", "template", "ord", "gk", "gv", "same", "bare")


def kept_spans(normalized: DataFrame, dealt: bool = False) -> DataFrame:
    """What the detectors need of the spans, without statements and URLs, dealt by trace (unless they are ``dealt`` so) and kept (memory,
    then disk). Lost blocks are computed again; the caller may clear the cache when the findings are written."""
    # plain columns are compressed where they are kept, structs are not
    n = _keyed(normalized).select(*_NEEDED, F.col("source.endpoint").alias("_endpoint"))
    n = (n if dealt else n.repartition("trace_id")).persist()
    return n.withColumn("source", F.struct(F.col("_endpoint").alias("endpoint"))).drop("_endpoint")


def detect_all(normalized: DataFrame, thresholds: Thresholds = _D, dealt: bool = False) -> DataFrame:
    """All findings. ``dealt``: the spans are kept by the caller (``kept_spans``, a micro-batch), and are not dealt and kept once more.

    Seven detectors read the kept spans: all groups begin with the trace, so they are found where the spans lie. Each detector
    but that across traces reads them once; only chains of serialized calls, which Python finds, are shuffled again.
    """
    t = thresholds
    n = _keyed(normalized) if dealt else kept_spans(normalized)
    parts = [detect_repeats(n, t.n_plus_one, t.window_ms, t.sanitizer), detect_slow(n, t.slow_ms, t.slow_min), detect_fanout(n, t.fanout), detect_chatty(n, t.chatty), detect_pool_saturation(n, t.pool), detect_serialized(n, t.serialized, None)]
    # the cross-trace rule asks each template for two traces, so a batch of one trace has none
    return reduce(DataFrame.unionByName, [*parts, detect_slow_cross_trace(n, t.slow_ms, t.slow_min)])
