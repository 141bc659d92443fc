"""Readers of span exports, statement statistics, energy readings, archives, reports and profiles; schemas are always given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattspan.functions.normalize import sql_template, sql_tokens
from wattspan.functions.times import epoch_ms, iso_ms
from wattspan.operators import ingest as i
from wattspan.operators.stitch import stitch_decisions
from wattspan.schema import SPANS

_KEY_VALUE = "array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>>>"
_OTLP = (
    f"resourceSpans array<struct<resource:struct<attributes:{_KEY_VALUE}>,scopeSpans:array<struct<scope:struct<name:string,version:string>,spans:array<struct<traceId:string,spanId:string,parentSpanId:string,"
    f"name:string,kind:int,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_KEY_VALUE},links:array<struct<traceId:string,spanId:string>>>>>>>>"
)
_JAEGER = (
    "data array<struct<traceID:string,spans:array<struct<spanID:string,operationName:string,references:array<struct<refType:string,spanID:string>>,startTime:bigint,duration:bigint,processID:string,"
    "tags:array<struct<key:string,value:string>>>>,processes:map<string,struct<serviceName:string,tags:array<struct<key:string,value:string>>>>>>"
)
_ZIPKIN = "traceId string, id string, parentId string, name string, kind string, timestamp bigint, duration bigint, localEndpoint struct<serviceName:string>, tags map<string,string>"
# Span kinds by number.
_KINDS = ("UNSPECIFIED", "INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER")
#: Columns of a raw span, before classification.
RAW = "trace_id, span_id, parent_span_id, service, name, kind, ts_ms, duration_us, attrs, resource, scope, link_trace_id"


def read_native_spans(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """JSON spans in the span schema, one array a file or one span a line, sanitised, with ts_ms and ord."""
    rows = spark.read.schema(SPANS).option("multiLine", multiline).json(path)
    return with_order(i.sanitize_spans(rows))


def with_order(spans: DataFrame) -> DataFrame:
    return spans.withColumns({"ts_ms": epoch_ms(F.col("timestamp")), "ord": F.monotonically_increasing_id()})


def _attributes(pairs: Column) -> Column:
    value = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))
    entries = F.transform(F.coalesce(pairs, F.array().cast(_KEY_VALUE)), lambda p: F.struct(p["key"].alias("key"), value(p["value"]).alias("value")))
    return _last_wins(entries)


def _last_wins(entries: Column) -> Column:
    """A map of the entries; of equal keys the first stays."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.get(F.filter(entries, lambda e: e["key"] == k), 0)["value"]))


def raw_otlp_spans(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    rows = spark.read.schema(_OTLP).option("multiLine", multiline).json(path)
    flat = rows.select(F.explode("resourceSpans").alias("r")).select(F.col("r.resource.attributes").alias("ra"), F.explode("r.scopeSpans").alias("s")).select("ra", F.col("s.scope.name").alias("scope"), F.explode("s.spans").alias("x"))
    ns = lambda c: F.col(c).cast("decimal(20,0)")
    start, end = ns("x.startTimeUnixNano"), ns("x.endTimeUnixNano")
    out = flat.select(
        F.col("x.traceId").alias("trace_id"), F.col("x.spanId").alias("span_id"), F.nullif("x.parentSpanId", F.lit("")).alias("parent_span_id"), F.col("x.name").alias("name"),
        F.get(F.array(*map(F.lit, _KINDS)), F.coalesce("x.kind", F.lit(0))).alias("kind"), F.floor(start / 1_000_000).cast("long").alias("ts_ms"), F.floor(F.greatest(end - start, F.lit(0)) / 1000).cast("long").alias("duration_us"),
        _attributes(F.col("x.attributes")).alias("attrs"), _attributes(F.col("ra")).alias("resource"), "scope", F.get("x.links", 0)["traceId"].alias("link_trace_id"),
    )
    return out.withColumn("service", F.coalesce(F.col("resource")["service.name"], F.lit("unknown")))


def raw_jaeger_spans(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(_JAEGER).option("multiLine", True).json(path).select(F.explode("data").alias("t")).select("t.traceID", "t.processes", F.explode("t.spans").alias("x"))
    process = F.col("processes")[F.col("x.processID")]
    tags = _last_wins(F.coalesce("x.tags", F.array().cast("array<struct<key:string,value:string>>")))
    parent = F.get(F.filter(F.col("x.references"), lambda r: r["refType"] == "CHILD_OF"), 0)["spanID"]
    none = F.create_map().cast("map<string,string>")
    out = rows.select(F.col("traceID").alias("trace_id"), F.col("x.spanID").alias("span_id"), parent.alias("parent_span_id"), F.col("x.operationName").alias("name"), F.floor(F.col("x.startTime") / 1000).cast("long").alias("ts_ms"), F.col("x.duration").alias("duration_us"), tags.alias("attrs"), none.alias("resource"), process["serviceName"].alias("service"))
    return out.withColumns({"kind": F.upper(F.coalesce(F.col("attrs")["span.kind"], F.lit("client"))), "scope": F.lit(None).cast("string"), "link_trace_id": F.lit(None).cast("string")})


def raw_zipkin_spans(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(_ZIPKIN).option("multiLine", True).json(path)
    none = F.create_map().cast("map<string,string>")
    return rows.select(F.col("traceId").alias("trace_id"), F.col("id").alias("span_id"), F.col("parentId").alias("parent_span_id"), F.coalesce("localEndpoint.serviceName", F.lit("unknown")).alias("service"), "name", F.coalesce("kind", F.lit("CLIENT")).alias("kind"), F.floor(F.col("timestamp") / 1000).cast("long").alias("ts_ms"), F.col("duration").alias("duration_us"), F.coalesce("tags", none).alias("attrs"), none.alias("resource"), F.lit(None).cast("string").alias("scope"), F.lit(None).cast("string").alias("link_trace_id"))


def classify_raw(raw: DataFrame) -> DataFrame:
    """raw spans with io (null if it is no I/O), reason, route and frame."""
    attrs = F.col("attrs")
    route = F.coalesce(attrs["http.route"], attrs["http.target"], F.when(F.col("kind") != "CLIENT", F.coalesce(attrs["http.url"], attrs["url.full"])))
    name = lambda a, b: F.coalesce(attrs[a], attrs[b])
    frame = F.concat_ws(".", name("code.namespace", "code.namespace"), name("code.function.name", "code.function"))
    io = i.classify_io(attrs, F.col("kind"), F.col("name"))
    out = raw.withColumns({"io": io, "route": route, "frame": F.nullif(frame, F.lit(""))})
    return out.withColumn("reason", F.when(F.col("io").isNull(), i.filter_reason(attrs, F.col("kind"))))


#: Names of execute spans, whose statement another span carries.
_EXECUTES = "(?i)execute|query"
#: Attributes of spans that are no statement's execution, whatever their name.
_NO_EXECUTE = ("http.url", "url.full", "http.method", "http.request.method", "rpc.system", "messaging.system")


def convert(raw: DataFrame, grouping_keys: tuple[str, ...] = i.GROUPING_KEYS) -> tuple[DataFrame, DataFrame]:
    """I/O spans of raw spans of any format, classified, enriched and sanitised, and the one-row counts of ``ingest_stats``.

    Statements that an ancestor repeats go, and split prepare and execute spans become one; both count as merged_db_span.
    Endpoints, code, scopes and producer links come from the span or its ancestors, also from those that are no I/O. The
    walks up the span tree read the classified spans once a hop, so they are dealt by trace and kept.
    """
    a = F.col("attrs")
    names = {"function": ("code.function.name", "code.function"), "filepath": ("code.file.path", "code.filepath"), "lineno": ("code.line.number", "code.lineno"), "namespace": ("code.namespace",)}
    code = F.struct(*(F.coalesce(*(a[x] for x in keys)).cast("int" if c == "lineno" else "string").alias(c) for c, keys in names.items()))
    any_code = F.coalesce(*(a[x] for keys in names.values() for x in keys)).isNotNull()
    link = F.when(F.col("link_trace_id").rlike("^[0-9a-fA-F]{32}$"), F.lower("link_trace_id"))
    statement = F.when(F.col("event_type") == "sql", F.col("target"))
    placed = classify_raw(raw.repartition("trace_id")).withColumns({"code": F.when(any_code, code), "link_trace_id": link, "event_type": F.col("io.event_type"), "target": F.col("io.target")})
    kept = placed.withColumn("statement", statement).persist()
    # producer links and split spans are absent in most exports; then their joins are left out
    if kept.filter("kind = 'CONSUMER' and link_trace_id is not null").isEmpty():
        kept = kept.withColumns({"sibling_link": F.lit(None).cast("string"), "link": F.lit(None).cast("string")})
    else:
        kept = i.with_producer_nodes(kept).persist()
    # one walk serves all that spans take from their ancestors
    walk = i.ancestors(kept, carry=("route", "frame", "scope", "code", "statement", "link")).persist()
    merged = i.layered_duplicates(kept, walk=walk)
    system = i.db_system(a)
    other = F.coalesce(*(a[c] for c in _NO_EXECUTE)).isNotNull() | F.coalesce(system.isin(*i.NON_SQL), F.lit(False))
    orphan = F.coalesce(F.col("io").isNull() & ~other & F.col("name").rlike(_EXECUTES), F.lit(False))
    whole = kept.withColumn("_statement", F.lit(None).cast("string"))
    if not kept.filter(orphan).isEmpty():
        part = kept.join(merged.withColumn("suppressed", F.lit(True)), ["trace_id", "span_id"], "left")
        part = part.select("trace_id", "span_id", "parent_span_id", "ts_ms", F.col("statement").alias("target"), orphan.alias("orphan"), F.coalesce(system.isin(*i.SQL_SYSTEMS), F.lit(False)).alias("sql_system"), "suppressed")
        decided = stitch_decisions(part, walk).persist()
        merged = merged.unionByName(decided.filter("statement is null").select("trace_id", "span_id"))
        whole = kept.join(decided.filter("statement is not null").withColumnRenamed("statement", "_statement"), ["trace_id", "span_id"], "left")
    whole = whole.join(merged.distinct().withColumn("_merged", F.lit(True)), ["trace_id", "span_id"], "left")
    made = F.struct(F.lit("sql").alias("event_type"), F.col("_statement").alias("target"), F.upper(F.regexp_extract("_statement", r"^\s*(\w+)", 1)).alias("operation"))
    io = F.when(F.col("_merged"), None).when(F.col("_statement").isNotNull(), made).otherwise(F.col("io"))
    reason = F.when(F.col("_merged"), F.lit("merged_db_span")).when(F.col("_statement").isNull(), F.col("reason"))
    whole = whole.withColumns({"io": io, "reason": reason}).drop("event_type", "target", "statement", "_merged", "_statement").persist()
    classified = i.resolve_code_attrs(i.collect_scopes(i.resolve_source_endpoint(whole, walk=walk), walk=walk), walk=walk)
    classified = i.resolve_producer_link(classified, walk=walk)
    spans = classified.filter("io is not null").select(
        iso_ms(F.col("ts_ms")).alias("timestamp"), "trace_id", "span_id", "parent_span_id", F.col("producer_trace").alias("link_trace_id"), "service", i.collect_grouping(F.col("resource"), a, grouping_keys).alias("grouping"),
        F.coalesce(F.col("resource")["cloud.region"], a["cloud.region"]).alias("cloud_region"), "io.event_type", "io.operation", "io.target", "duration_us", F.struct("endpoint", F.lit("").alias("method")).alias("source"),
        F.coalesce(a["http.response.status_code"], a["http.status_code"]).cast("int").alias("status_code"), a["http.response.body.size"].cast("long").alias("response_size_bytes"),
        "code", F.col("scopes").alias("instrumentation_scopes"),
    )
    return with_order(i.sanitize_spans(spans)), i.ingest_stats(whole)


def to_spans(raw: DataFrame, grouping_keys: tuple[str, ...] = i.GROUPING_KEYS) -> DataFrame:
    """The spans of ``convert``."""
    return convert(raw, grouping_keys)[0]


def read_otlp_spans(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    return to_spans(raw_otlp_spans(spark, path, multiline))


def read_jaeger_spans(spark: SparkSession, path: str) -> DataFrame:
    return to_spans(raw_jaeger_spans(spark, path))


def read_zipkin_spans(spark: SparkSession, path: str) -> DataFrame:
    return to_spans(raw_zipkin_spans(spark, path))


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path) if path.rstrip("/").endswith(".json") else spark.read.schema(schema).csv(path, header=True, enforceSchema=False, escape='"', multiLine=True)


def read_pg_statements(spark: SparkSession, path: str) -> DataFrame:
    """Statement statistics, CSV or JSON, with the statement's template."""
    rows = _rows(spark, path, "query string, calls long, total_exec_time double, mean_exec_time double, rows long, shared_blks_hit long, shared_blks_read long")
    return rows.withColumnsRenamed({"total_exec_time": "total_exec_time_ms", "mean_exec_time": "mean_exec_time_ms"}).withColumn("template", sql_template(sql_tokens(F.col("query"))))


def read_mysql_digests(spark: SparkSession, path: str) -> DataFrame:
    """Digest summaries, CSV or JSON; picoseconds become milliseconds, rows without a digest go."""
    rows = _rows(spark, path, "SCHEMA_NAME string, DIGEST_TEXT string, COUNT_STAR long, SUM_TIMER_WAIT double, AVG_TIMER_WAIT double, SUM_ROWS_SENT long, SUM_ROWS_EXAMINED long")
    present = lambda c: F.when(~F.lower(F.trim(c)).isin("", "null", "\\n"), F.col(c))
    out = rows.select(present("SCHEMA_NAME").alias("schema_name"), present("DIGEST_TEXT").alias("query"), F.col("COUNT_STAR").alias("calls"), (F.col("SUM_TIMER_WAIT") / 1e9).alias("total_exec_time_ms"), (F.col("AVG_TIMER_WAIT") / 1e9).alias("mean_exec_time_ms"), F.col("SUM_ROWS_SENT").alias("rows_sent"), F.col("SUM_ROWS_EXAMINED").alias("rows_examined"))
    return out.filter("query is not null").withColumn("template", sql_template(sql_tokens(F.col("query"))))


def read_energy_readings(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """service, ts_ms and watts or kwh, by the header's third column (or ``column``): power_watts or energy_kwh.

    Comment lines, negative and non-finite values are left out.
    """
    if column is None:
        head = spark.read.option("comment", "#").csv(path, header=True).columns
        column = head[2].strip() if len(head) > 2 else ""
    if column not in ("power_watts", "energy_kwh"):
        raise ValueError(f"the third column must be power_watts or energy_kwh, not {column!r}")
    rows = spark.read.schema(f"timestamp string, service string, {column} double").csv(path, header=True, comment="#", enforceSchema=True)
    v = F.col(column)
    kept = rows.filter(v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf"))).withColumn("ts_ms", epoch_ms(F.col("timestamp"))).filter("ts_ms is not null")
    return kept.select("service", "ts_ms", v.alias("watts" if column == "power_watts" else "kwh"))


def read_findings(spark: SparkSession, path: str, schema) -> DataFrame:
    """Findings of a saved report in the schema of findings."""
    from pyspark.sql import types as T

    report = T.StructType([T.StructField("findings", T.ArrayType(schema))])
    return spark.read.schema(report).option("multiLine", True).json(path).select(F.explode("findings").alias("f")).select("f.*")


def read_acknowledgments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("signature string, acknowledged_by string, acknowledged_at string, reason string, expires_at string, service string, endpoint string").json(path).filter("signature is not null")


def read_hourly_profiles(spark: SparkSession, path: str) -> DataFrame:
    """region, month (null: every month), hour, intensity of 24 or 12 x 24 finite values of zero or more."""
    rows = spark.read.schema("region string, hourly array<double>, monthly array<array<double>>").option("multiLine", True).json(path)
    flat = rows.filter(F.size("hourly") == 24).select("region", F.lit(None).cast("int").alias("month"), F.posexplode("hourly").alias("hour", "intensity"))
    monthly = rows.filter(F.size("monthly") == 12).select("region", F.posexplode("monthly").alias("m", "v")).filter(F.size("v") == 24).select("region", (F.col("m") + 1).alias("month"), F.posexplode("v").alias("hour", "intensity"))
    v = F.col("intensity")
    every = flat.unionByName(monthly)
    bad = every.filter(v.isNull() | F.isnan(v) | (v < 0) | (v == float("inf"))).select("region").distinct()
    return every.join(bad, "region", "left_anti")


def read_energy_telemetry(spark: SparkSession, path: str) -> DataFrame:
    from wattspan.operators.energy import sum_by_label

    return sum_by_label(spark.read.schema("ts timestamp, source string, label string, value double").json(path))


def stream_spans(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of spans from JSON-lines files that arrive in a folder."""
    reader = spark.readStream.schema(SPANS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    spans = i.sanitize_spans(reader.json(path))
    return spans.withColumns({"ts_ms": epoch_ms(F.col("timestamp")), "ts": F.timestamp_millis(epoch_ms(F.col("timestamp")))}).withColumn("ord", F.col("ts_ms"))
