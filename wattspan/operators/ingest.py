"""From raw trace spans to I/O spans: clean, classify, walk the span tree, drop layered spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattspan.functions.hashes import fnv1a64

MAX_HOPS = 8
# Byte limits of the span fields.
LIMITS = {"trace_id": 128, "span_id": 128, "service": 256, "operation": 256, "target": 65_536, "timestamp": 64}
OPTIONAL_LIMITS = {"parent_span_id": 128, "link_trace_id": 128, "cloud_region": 128}
MAX_GROUPING, MAX_SCOPES = 8, 8
# Names of database systems.
NON_SQL = ("redis", "memcached", "mongodb", "cassandra", "dynamodb", "couchbase", "couchdb", "elasticsearch", "opensearch", "neo4j", "hbase", "geode", "influxdb")
SQL_SYSTEMS = (
    "postgresql", "mysql", "mariadb", "mssql", "oracle", "db2", "sqlite", "h2", "hsqldb", "derby", "cockroachdb", "clickhouse", "spanner", "redshift", "snowflake", "bigquery", "trino", "presto", "vertica",
    "teradata", "hive", "sql",
)
ALIASES = {
    "postgres": "postgresql", "sqlserver": "mssql", "sql server": "mssql", "microsoft.sql_server": "mssql", "oracle.db": "oracle", "ibm.db2": "db2", "gcp.spanner": "spanner", "aws.redshift": "redshift", "aws.dynamodb": "dynamodb",
}
GROUPING_KEYS = ("k8s.namespace.name", "service.namespace")
FILTER_REASONS = ("not_io", "missing_db_statement", "missing_http_url", "non_sql_datastore", "merged_db_span")


def cut_bytes(text: Column, limit: int) -> Column:
    """At most ``limit`` UTF-8 bytes, on a character boundary."""
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, limit).cast("string")), "\ufffd+$", "")
    return F.when(F.octet_length(text) <= limit, text).otherwise(cut)


def strip_endpoint_secrets(text: Column) -> Column:
    """Without query, fragment, and user:password@ of a URL whose :// comes before its first slash."""
    cut = F.regexp_replace(text, r"(?s)[?#].*$", "")
    return F.regexp_replace(cut, r"^([^/]*?://)[^/@]*@", "$1")


def sanitize_spans(spans: DataFrame) -> DataFrame:
    """Fields cut to their limits; optional fields with control characters become null; blank grouping pairs go, eight stay."""
    bad = lambda c: c.rlike(r"[\x00-\x1f\x7f]")
    out = {c: cut_bytes(F.col(c), n) for c, n in LIMITS.items()}
    out |= {c: F.when(~bad(F.col(c)), cut_bytes(F.col(c), n)) for c, n in OPTIONAL_LIMITS.items()}
    half = lambda g: g.isNotNull() & ~bad(g) & (F.trim(g) != "")
    pairs = F.filter("grouping", lambda g: half(g["key"]) & half(g["value"]))
    out["grouping"] = F.slice(F.coalesce(pairs, F.array().cast(spans.schema["grouping"].dataType)), 1, MAX_GROUPING)
    scopes = F.transform(F.coalesce("instrumentation_scopes", F.array().cast("array<string>")), lambda s: cut_bytes(s, 256))
    out["instrumentation_scopes"] = F.slice(scopes, 1, MAX_SCOPES)
    out["source"] = F.struct(strip_endpoint_secrets(cut_bytes(F.col("source.endpoint"), 512)).alias("endpoint"), cut_bytes(F.col("source.method"), 512).alias("method"))
    target = out["target"]
    out["target"] = F.when((F.col("event_type") == "messaging") & target.contains("://"), strip_endpoint_secrets(target)).otherwise(target)
    return spans.withColumns(out)


def canonical_db_system(system: Column) -> Column:
    low = F.lower(F.trim(system))
    aliases = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.coalesce(aliases[low], low)


def db_system(attrs: Column) -> Column:
    filled = lambda k: F.when(F.trim(attrs[k]) != "", attrs[k])
    return canonical_db_system(F.coalesce(filled("db.system.name"), filled("db.system"), filled("db.type")))


def classify_io(attrs: Column, kind: Column, name: Column) -> Column:
    """struct(event_type, target, operation) of a span, null if it is no I/O: statement, URL, remote call, publish, in this order."""
    filled = lambda k: F.when(F.trim(attrs[k]) != "", attrs[k])
    system = db_system(attrs)
    url = F.coalesce(filled("http.url"), filled("url.full"))
    method = F.coalesce(filled("http.request.method"), filled("http.method"))
    resource = F.when(system.isin(*SQL_SYSTEMS) & url.isNull() & method.isNull(), filled("resource.name"))
    statement = F.when(~F.coalesce(system.isin(*NON_SQL), F.lit(False)), F.coalesce(filled("db.statement"), filled("db.query.text"), resource))
    rpc = F.when((kind == "CLIENT") & filled("rpc.system").isNotNull(), F.coalesce(F.concat(filled("rpc.service"), F.lit("/"), filled("rpc.method")), name))
    publish = F.when((kind == "PRODUCER") & filled("messaging.system").isNotNull(), F.coalesce(filled("messaging.destination.name"), filled("messaging.destination"), name))
    made = lambda t, target, op: F.struct(F.lit(t).alias("event_type"), target.alias("target"), op.alias("operation"))
    verb = F.upper(F.regexp_extract(statement, r"^\s*(\w+)", 1))
    return F.when(statement.isNotNull(), made("sql", statement, verb)).when(url.isNotNull(), made("http_out", url, F.upper(F.coalesce(method, F.lit("GET"))))).when(rpc.isNotNull(), made("http_out", rpc, attrs["rpc.system"])).when(publish.isNotNull(), made("messaging", publish, attrs["messaging.system"]))


def filter_reason(attrs: Column, kind: Column) -> Column:
    """Why a span that classify_io rejects was rejected."""
    system = db_system(attrs)
    return (
        F.when(system.isin(*NON_SQL), "non_sql_datastore").when(system.isNotNull(), "missing_db_statement")
        .when((kind == "CLIENT") & (attrs["http.request.method"].isNotNull() | attrs["http.method"].isNotNull()), "missing_http_url").otherwise("not_io")
    )


def ingest_stats(classified: DataFrame) -> DataFrame:
    """One row of counts by reason and the usable ratios (null below 20 spans). classified: io (struct or null), reason."""
    n = lambda c: F.count_if(c)
    kind, reason = F.col("io.event_type"), F.col("reason")
    counts = classified.agg(n(kind == "sql").alias("sql"), n(kind == "http_out").alias("http"), *(n(reason == r).alias(r) for r in FILTER_REASONS))
    ratio = lambda kept, gap: F.when(F.col(kept) + F.col(gap) >= 20, F.col(kept) / (F.col(kept) + F.col(gap)))
    out = counts.withColumns({"sql_usable": ratio("sql", "missing_db_statement"), "http_usable": ratio("http", "missing_http_url")})
    return out.withColumn("usable", F.least("sql_usable", "http_usable"))


def ancestors(spans: DataFrame, max_hops: int = MAX_HOPS, carry: tuple[str, ...] = ()) -> DataFrame:
    """trace_id, span_id, hop (from 1), ancestor and its ``carry`` columns.

    One left equi-join on (trace_id, span) a hop, all of which share the partitioning by trace. A walk stops at a missing
    parent, at a span that is its own parent or the span itself, and after ``max_hops``.
    """
    parent = F.when(F.col("parent_span_id") != F.col("span_id"), F.col("parent_span_id"))
    walk = spans.select("trace_id", "span_id", parent.alias("_at"))
    hops = []
    for hop in range(1, max_hops + 1):
        own = F.struct(F.lit(hop).alias("hop"), F.col("span_id").alias("ancestor"), *carry).alias("_own")
        up = spans.select("trace_id", F.col("span_id").alias("_at"), parent.alias("_next"), own)
        walk = walk.join(up, ["trace_id", "_at"], "left")
        goes_on = F.col("_own.ancestor") != F.col("span_id")
        walk = walk.select("trace_id", "span_id", *hops, F.when(goes_on, F.col("_own")).alias(f"_h{hop}"), F.when(goes_on, F.col("_next")).alias("_at"))
        hops.append(f"_h{hop}")
    found = walk.select("trace_id", "span_id", F.explode(F.array_compact(F.array(*hops))).alias("h"))
    return found.select("trace_id", "span_id", "h.hop", "h.ancestor", *(f"h.{c}" for c in carry))


def resolve_source_endpoint(spans: DataFrame, max_hops: int = MAX_HOPS, walk: DataFrame | None = None) -> DataFrame:
    """spans (with route and frame) with endpoint: the nearest ancestor's inbound route, else the outermost code frame, else unknown."""
    walk = walk if walk is not None else ancestors(spans.select("trace_id", "span_id", "parent_span_id", "route", "frame"), max_hops, ("route", "frame"))
    best = walk.groupBy("trace_id", "span_id").agg(F.min_by("route", F.when(F.col("route").isNotNull(), F.col("hop"))).alias("_route"), F.max_by("frame", F.when(F.col("frame").isNotNull(), F.col("hop"))).alias("_frame"))
    return spans.join(best, ["trace_id", "span_id"], "left").withColumn("endpoint", F.coalesce("_route", "_frame", "frame", F.lit("unknown"))).drop("_route", "_frame")


def resolve_code_attrs(spans: DataFrame, max_hops: int = MAX_HOPS, walk: DataFrame | None = None) -> DataFrame:
    """spans with code: their own, else the nearest ancestor's that has any."""
    walk = walk if walk is not None else ancestors(spans.select("trace_id", "span_id", "parent_span_id", "code"), max_hops, ("code",))
    near = walk.filter("code is not null").groupBy("trace_id", "span_id").agg(F.min_by("code", "hop").alias("_code"))
    return spans.join(near, ["trace_id", "span_id"], "left").withColumn("code", F.coalesce("code", "_code")).drop("_code")


def collect_scopes(spans: DataFrame, max_hops: int = MAX_HOPS, walk: DataFrame | None = None) -> DataFrame:
    """spans (with scope) with scopes: their own first, then those of ancestors, each once."""
    walk = walk if walk is not None else ancestors(spans.select("trace_id", "span_id", "parent_span_id", "scope"), max_hops, ("scope",))
    above = walk.filter("scope is not null").groupBy("trace_id", "span_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("hop", "scope"))), lambda x: x["scope"]).alias("_above"))
    own = F.when(F.col("scope").isNull(), F.array().cast("array<string>")).otherwise(F.array("scope"))
    return spans.join(above, ["trace_id", "span_id"], "left").withColumn("scopes", F.array_distinct(F.concat(own, F.coalesce("_above", F.array().cast("array<string>"))))).drop("_above")


def with_producer_nodes(spans: DataFrame) -> DataFrame:
    """spans with sibling_link (of the CONSUMER sibling that started last at or before the span, largest span id on ties) and
    link (its own if it is a CONSUMER, else sibling_link).

    Siblings are scanned in their order and nothing is joined, so spans that are dealt by trace stay where they are.
    """
    consumer = (F.col("kind") == "CONSUMER") & (F.col("link_trace_id") != F.col("trace_id")) & (F.col("link_trace_id") != "0" * 32)
    family, same_id = Window.partitionBy("trace_id", "parent_span_id"), Window.partitionBy("trace_id", "span_id")
    in_order = family.orderBy("ts_ms", "span_id")
    before, upto = (in_order.rowsBetween(Window.unboundedPreceding, end) for end in (-1, Window.currentRow))
    timed = F.col("ts_ms").isNotNull() & F.col("span_id").isNotNull()
    rows = spans.withColumn("_own", F.when(consumer & timed, F.struct(F.col("ts_ms").alias("ts"), F.col("span_id").alias("id"), F.col("link_trace_id").alias("to"))))
    # a span is not its own sibling, so each CONSUMER also has the last one before it with another id
    rows = rows.withColumn("_before", F.last("_own", True).over(before))
    turn = F.when(F.col("_own").isNotNull() & ~F.col("_before.id").eqNullSafe(F.col("span_id")), F.struct("_before"))
    rows = rows.withColumn("_other", F.last(turn, True).over(upto)["_before"])
    newest = F.max(F.when(F.col("_own").isNotNull(), F.struct(F.col("_own").alias("own"), F.col("_other").alias("other")))).over(family.orderBy("ts_ms").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_newest", newest)
    sibling = F.when(F.col("_newest.own.id") != F.col("span_id"), F.col("_newest.own")).otherwise(F.col("_newest.other"))
    rows = rows.withColumn("_sibling", F.when(F.col("trace_id").isNotNull() & F.col("parent_span_id").isNotNull() & timed, sibling))
    # rows of one id share what any of them has
    rows = rows.withColumns({"sibling_link": F.max("_sibling").over(same_id)["to"], "link": F.max(F.when(consumer, F.col("link_trace_id"))).over(same_id)})
    known = F.col("trace_id").isNotNull() & F.col("span_id").isNotNull()
    rows = rows.withColumns({"sibling_link": F.when(known, F.col("sibling_link")), "link": F.when(known, F.coalesce("link", "sibling_link"))})
    return rows.drop("_own", "_before", "_other", "_newest", "_sibling")


def _asked(rows: DataFrame, key: Column, give: Column) -> DataFrame:
    """rows with _got: what the span of the same trace whose id is ``key`` gives (null: nothing). Each row stands once under the id it
    asks for and, if it gives anything, once under its own, so a lookup is a window."""
    gives = F.col("trace_id").isNotNull() & F.col("span_id").isNotNull() & give.isNotNull()
    place = lambda at, gift: F.struct(at.alias("at"), gift.alias("gift"), gift.isNotNull().alias("own"))
    ask, offer = place(F.coalesce(key, F.col("span_id")), F.when(F.lit(False), give)), place(F.col("span_id"), give)
    rows = rows.withColumn("_place", F.explode(F.when(gives, F.array(ask, offer)).otherwise(F.array(ask))))
    got = F.max("_place.gift").over(Window.partitionBy("trace_id", "_place.at"))
    return rows.withColumn("_got", got).filter("not _place.own").drop("_place").withColumn("_got", F.when(key.isNotNull(), F.col("_got")))


def _nearest_above(rows: DataFrame, max_hops: int) -> DataFrame:
    """rows (with link) with _above: the link of the nearest ancestor that has any, within ``max_hops``; walks stop as those of ``ancestors``.

    Each span keeps the nearest link of itself and the spans above it, and the id above those; what the span with that id
    keeps doubles their number (or, for an odd number, adds one). So eight hops are four lookups.
    """
    parent = F.when(F.col("parent_span_id") != F.col("span_id"), F.col("parent_span_id"))
    gift = lambda near, at: F.when(near.isNotNull() | at.isNotNull(), F.struct(near.alias("near"), F.when(near.isNull(), at).alias("at")))
    own = gift(F.when(F.col("link").isNotNull(), F.struct(F.col("link").alias("to"), F.col("span_id").alias("id"))), parent)
    rows = rows.withColumn("_kept", own)
    for bit in f"{max_hops:b}"[1:]:
        for give in [F.col("_kept")] + [own] * (bit == "1"):
            rows = _asked(rows, F.col("_kept.at"), give)
            rows = rows.withColumn("_kept", gift(F.coalesce("_kept.near", "_got.near"), F.col("_got.at"))).drop("_got")
    rows = _asked(rows, F.when(F.col("sibling_link").isNull(), parent), F.col("_kept"))
    # on a cycle the walk comes back to the span itself and ends there
    return rows.withColumn("_above", F.when(F.col("_got.near.id") != F.col("span_id"), F.col("_got.near.to"))).drop("_kept", "_got")


def resolve_producer_link(spans: DataFrame, max_hops: int = MAX_HOPS, walk: DataFrame | None = None) -> DataFrame:
    """spans with producer_trace, the trace whose message started this work; null where none is known.

    spans: trace_id, span_id, parent_span_id, kind, ts_ms, link_trace_id. At the span: the link of the CONSUMER sibling that
    started last at or before it. Then at each ancestor, nearest first: its own link if it is a CONSUMER, else that of such a
    sibling of the ancestor. A link to the own or an all-zero trace is none. With ``walk`` (which carries link) spans
    already have the columns of ``with_producer_nodes``; without it nothing is joined, and spans that are dealt by trace are
    not shuffled. Ids are taken to be unique within a trace; of repeated ones with several parents one is gone up by.
    """
    if walk is None:
        out = _nearest_above(with_producer_nodes(spans), max_hops)
    else:
        above = walk.filter("link is not null").groupBy("trace_id", "span_id").agg(F.min_by("link", "hop").alias("_above"))
        out = spans.join(above, ["trace_id", "span_id"], "left")
    return out.withColumn("producer_trace", F.coalesce("sibling_link", "_above")).drop("sibling_link", "link", "_above")


def collect_grouping(resource: Column, attrs: Column, keys: tuple[str, ...] = GROUPING_KEYS) -> Column:
    """Key and value of each configured attribute that the resource, else the span, has."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(resource[k], attrs[k]).alias("value")) for k in keys])
    return F.filter(pairs, lambda p: p["value"].isNotNull())


def layered_duplicates(spans: DataFrame, max_hops: int = MAX_HOPS, walk: DataFrame | None = None) -> DataFrame:
    """trace_id and span_id of SQL spans with an ancestor that has the same statement. Two spans that are ancestors of each
    other, on a cycle, have no outermost one, so both stay. spans may hold other spans, which walks pass through."""
    statement = F.when(F.col("event_type") == "sql", F.col("target"))
    own = spans.select("trace_id", "span_id", "parent_span_id", statement.alias("statement"))
    walk = walk if walk is not None else ancestors(own, max_hops, ("statement",))
    above = walk.select("trace_id", "span_id", "hop", "ancestor", F.col("statement").alias("_above"))
    same = above.join(own.select("trace_id", "span_id", "statement"), ["trace_id", "span_id"]).filter("_above = statement")
    nearest = same.groupBy("trace_id", "span_id").agg(F.min_by("ancestor", "hop").alias("ancestor"))
    mutual = walk.select("trace_id", F.col("span_id").alias("ancestor"), F.col("ancestor").alias("span_id"))
    return nearest.join(mutual, ["trace_id", "span_id", "ancestor"], "left_anti").select("trace_id", "span_id")


def suppress_layered_duplicates(spans: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """spans without their layered duplicates."""
    return spans.join(layered_duplicates(spans, max_hops), ["trace_id", "span_id"], "left_anti")


def sample_traces(spans: DataFrame, rate: float) -> DataFrame:
    """Whole traces at a rate: those whose FNV-1a hash of the id, as a share of all hashes, is below it. Spans without an id go
    unless the rate is 1 or more."""
    if rate >= 1:
        return spans
    return spans.filter(fnv1a64(F.col("trace_id")) / float(1 << 64) < rate)


def last_spans(spans: DataFrame, keep: int = 1000) -> DataFrame:
    """The last ``keep`` spans of each trace."""
    r = F.row_number().over(Window.partitionBy("trace_id").orderBy(F.desc("ts_ms"), F.desc("ord")))
    return spans.withColumn("_r", r).filter(F.col("_r") <= keep).drop("_r")
