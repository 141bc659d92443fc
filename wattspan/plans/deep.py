"""Queries over deep traces: the events of a user in blocks of sixteen, one span an event, up to fifteen levels deep.

Statements, calls and spans that are no I/O lie between each other, statements repeat along a chain, every seventh span is
a CONSUMER with a link, and fields are dirty or too long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattspan.operators import ingest, reports, stitch
from wattspan.plans.registry import register
from wattspan.sources.derived import read_tables

BLOCK = 16
#: The same view for DuckDB; ``up`` walks from each span to its ancestors, eight hops at most.
_SQL = """
WITH RECURSIVE e AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn, epoch_us(ts) // 1000 AS ts_ms FROM events
), d AS (
  SELECT 'u' || user_id || '-' || (rn // 16) AS trace_id, rn % 16 AS pos, event_id, ts_ms,
    'u' || user_id || '-' || rn AS span_id, CASE WHEN rn % 16 = 0 THEN NULL WHEN rn % 16 % 5 = 4 THEN 'u' || user_id || '-' || (rn - 2) ELSE 'u' || user_id || '-' || (rn - 1) END AS parent_span_id,
    CASE event_id % 3 WHEN 0 THEN 'sql' WHEN 2 THEN 'http_out' END AS event_type, CASE event_id % 3 WHEN 0 THEN 'SELECT v FROM t' || (event_id % 2) WHEN 2 THEN 'http://h/' || (event_id % 5) END AS target,
    CASE WHEN event_id % 7 = 0 THEN 'CONSUMER' ELSE 'CLIENT' END AS kind, 't' || (event_id % 11) AS link_trace_id,
    CASE WHEN event_id % 10 = 0 THEN 'GET /r' || (event_id % 4) END AS route, CASE WHEN event_id % 4 = 0 THEN 'f' || (event_id % 9) END AS frame, 'lib-' || (event_id % 3) AS scope
  FROM e
), up AS (
  SELECT trace_id, span_id, 1 AS hop, parent_span_id AS ancestor FROM d WHERE parent_span_id IS NOT NULL
  UNION ALL
  SELECT up.trace_id, up.span_id, hop + 1, d.parent_span_id FROM up JOIN d ON d.trace_id = up.trace_id AND d.span_id = up.ancestor WHERE hop < 8 AND d.parent_span_id IS NOT NULL
)
"""


def deep_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = read_tables(spark, sf_dir, "events")
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    e = events.select("user_id", "event_id", "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms")).withColumn("rn", rn)
    user = lambda n: F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), n.cast("string"))
    tag = lambda prefix, m: F.concat(F.lit(prefix), (F.col("event_id") % m).cast("string"))
    every = lambda m, value: F.when(F.col("event_id") % m == 0, value)
    pos, third = F.col("rn") % BLOCK, F.col("event_id") % 3
    return e.select(
        user(F.floor(F.col("rn") / BLOCK)).alias("trace_id"), user(F.col("rn")).alias("span_id"), F.when(pos > 0, user(F.when(pos % 5 == 4, F.col("rn") - 2).otherwise(F.col("rn") - 1))).alias("parent_span_id"), "ts_ms", "event_id",
        F.when(third == 0, "sql").when(third == 2, "http_out").alias("event_type"), F.when(third == 0, tag("SELECT v FROM t", 2)).when(third == 2, tag("http://h/", 5)).alias("target"),
        F.coalesce(every(7, F.lit("CONSUMER")), F.lit("CLIENT")).alias("kind"), tag("t", 11).alias("link_trace_id"), every(10, tag("GET /r", 4)).alias("route"), every(4, tag("f", 9)).alias("frame"), tag("lib-", 3).alias("scope"),
    )


@register("ancestors_deep", _SQL + "SELECT trace_id, span_id, hop, ancestor FROM up")
def _ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.ancestors(deep_spans(spark, sf_dir))


@register("orphan_carriers_deep", _SQL + """, o AS (
  SELECT trace_id, span_id FROM d
  WHERE event_type IS NULL AND (event_id % 2 = 0 OR (trace_id, parent_span_id) IN (SELECT (trace_id, parent_span_id) FROM d WHERE event_type = 'sql' AND parent_span_id IS NOT NULL))
), above AS (
  SELECT up.trace_id, up.span_id, arg_max(up.ancestor, hop) AS carrier
  FROM up JOIN o a ON a.trace_id = up.trace_id AND a.span_id = up.ancestor GROUP BY up.trace_id, up.span_id
)
SELECT o.trace_id, o.span_id, carrier FROM o LEFT JOIN above ON above.trace_id = o.trace_id AND above.span_id = o.span_id""")  # fmt: skip
def _carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    statement = F.when(F.col("event_type") == "sql", F.col("target"))
    execute = {"target": statement, "orphan": F.col("event_type").isNull(), "sql_system": F.col("event_id") % 2 == 0}
    return stitch.orphan_carriers(deep_spans(spark, sf_dir).withColumns(execute))


@register("layered_duplicates_deep", _SQL + """
SELECT DISTINCT s.trace_id, s.span_id FROM d s JOIN up ON up.trace_id = s.trace_id AND up.span_id = s.span_id JOIN d a ON a.trace_id = up.trace_id AND a.span_id = up.ancestor
WHERE s.event_type = 'sql' AND a.event_type = 'sql' AND a.target = s.target""")  # fmt: skip
def _layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.layered_duplicates(deep_spans(spark, sf_dir))


@register("resolve_source_endpoint", _SQL + """, near AS (
  SELECT up.trace_id, up.span_id, arg_min(a.route, hop) FILTER (WHERE a.route IS NOT NULL) AS route, arg_max(a.frame, hop) FILTER (WHERE a.frame IS NOT NULL) AS frame FROM up JOIN d a ON a.trace_id = up.trace_id AND a.span_id = up.ancestor GROUP BY ALL
)
SELECT d.span_id, coalesce(near.route, near.frame, d.frame, 'unknown') AS endpoint FROM d LEFT JOIN near ON d.trace_id = near.trace_id AND d.span_id = near.span_id""")  # fmt: skip
def _endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.resolve_source_endpoint(deep_spans(spark, sf_dir)).select("span_id", "endpoint")


@register("resolve_code_attrs", _SQL + """, near AS (
  SELECT up.trace_id, up.span_id, arg_min(a.frame, hop) FILTER (WHERE a.frame IS NOT NULL) AS frame FROM up JOIN d a ON a.trace_id = up.trace_id AND a.span_id = up.ancestor GROUP BY ALL
)
SELECT d.span_id, coalesce(d.frame, near.frame) AS code FROM d LEFT JOIN near ON d.trace_id = near.trace_id AND d.span_id = near.span_id""")  # fmt: skip
def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.resolve_code_attrs(deep_spans(spark, sf_dir).withColumnRenamed("frame", "code")).select("span_id", "code")


@register("collect_scopes", _SQL + """, al AS (
  SELECT trace_id, span_id, 0 AS hop, scope FROM d UNION ALL SELECT up.trace_id, up.span_id, hop, a.scope FROM up JOIN d a ON a.trace_id = up.trace_id AND a.span_id = up.ancestor
), f AS (SELECT trace_id, span_id, scope, min(hop) AS hop FROM al GROUP BY ALL)
SELECT span_id, string_agg(scope, ',' ORDER BY hop) AS scopes FROM f GROUP BY trace_id, span_id""")  # fmt: skip
def _scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.collect_scopes(deep_spans(spark, sf_dir)).select("span_id", F.array_join("scopes", ",").alias("scopes"))


@register("resolve_producer_link_deep", _SQL + """, c AS (SELECT * FROM d WHERE kind = 'CONSUMER'), sib AS (
  SELECT s.trace_id, s.span_id, arg_max(c.link_trace_id, (c.ts_ms, c.span_id)) AS link FROM d s JOIN c ON c.trace_id = s.trace_id AND c.parent_span_id = s.parent_span_id AND c.ts_ms <= s.ts_ms AND c.span_id <> s.span_id GROUP BY ALL
), node AS (SELECT d.trace_id, d.span_id, coalesce(c.link_trace_id, sib.link) AS link FROM d LEFT JOIN c ON d.trace_id = c.trace_id AND d.span_id = c.span_id LEFT JOIN sib ON d.trace_id = sib.trace_id AND d.span_id = sib.span_id),
above AS (SELECT up.trace_id, up.span_id, arg_min(n.link, hop) FILTER (WHERE n.link IS NOT NULL) AS link FROM up JOIN node n ON n.trace_id = up.trace_id AND n.span_id = up.ancestor GROUP BY ALL)
SELECT d.span_id, coalesce(sib.link, above.link) AS producer_trace FROM d LEFT JOIN sib ON d.trace_id = sib.trace_id AND d.span_id = sib.span_id LEFT JOIN above ON d.trace_id = above.trace_id AND d.span_id = above.span_id""")  # fmt: skip
def _link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.resolve_producer_link(deep_spans(spark, sf_dir)).select("span_id", "producer_trace")


@register("explain_tree_deep", _SQL.replace("), up AS (", "), tree AS (SELECT trace_id, span_id, 0 AS depth, span_id AS path FROM d WHERE parent_span_id IS NULL UNION ALL SELECT d.trace_id, d.span_id, depth + 1, path || '/' || d.span_id FROM tree t JOIN d ON d.trace_id = t.trace_id AND d.parent_span_id = t.span_id), up AS (") + "SELECT trace_id, span_id, depth, path FROM tree")
def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = deep_spans(spark, sf_dir).withColumns({"template": F.col("target"), "ord": F.col("event_id")})
    none = spans.select("trace_id", F.struct("template").alias("pattern"), F.lit("x").alias("type")).filter("false")
    return reports.explain_tree(spans, none).select("trace_id", "span_id", "depth", F.array_join("path", "/").alias("path"))


@register("ingest_stats", _SQL + """, k AS (SELECT *, event_id % 13 AS m FROM d)
SELECT count(*) FILTER (WHERE event_type = 'sql') AS sql, count(*) FILTER (WHERE event_type = 'http_out') AS http, count(*) FILTER (WHERE event_type IS NULL AND m > 3) AS not_io, count(*) FILTER (WHERE event_type IS NULL AND m = 0) AS missing_db_statement,
  count(*) FILTER (WHERE event_type IS NULL AND m = 1) AS missing_http_url, count(*) FILTER (WHERE event_type IS NULL AND m = 2) AS non_sql_datastore, count(*) FILTER (WHERE event_type IS NULL AND m = 3) AS merged_db_span,
  count(*) FILTER (WHERE event_type = 'sql') / count(*) FILTER (WHERE event_type = 'sql' OR (event_type IS NULL AND m = 0)) AS sql_usable, count(*) FILTER (WHERE event_type = 'http_out') / count(*) FILTER (WHERE event_type = 'http_out' OR (event_type IS NULL AND m = 1)) AS http_usable,
  least(count(*) FILTER (WHERE event_type = 'sql') / count(*) FILTER (WHERE event_type = 'sql' OR (event_type IS NULL AND m = 0)), count(*) FILTER (WHERE event_type = 'http_out') / count(*) FILTER (WHERE event_type = 'http_out' OR (event_type IS NULL AND m = 1))) AS usable FROM k""")  # fmt: skip
def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("event_id") % 13
    reason = F.when(m == 0, "missing_db_statement").when(m == 1, "missing_http_url").when(m == 2, "non_sql_datastore").when(m == 3, "merged_db_span").otherwise("not_io")
    io = F.when(F.col("event_type").isNotNull(), F.struct("event_type", "target"))
    return ingest.ingest_stats(deep_spans(spark, sf_dir).withColumns({"io": io, "reason": F.when(io.isNull(), reason)}))


@register("sanitize_spans_dirty", _SQL + """
SELECT span_id, CASE WHEN event_id % 3 = 0 THEN repeat('é', 128) ELSE 'op' END AS operation, CASE WHEN event_id % 6 <> 0 THEN 'eu-west-3' END AS cloud_region, 'http://shop/items' AS endpoint,
  CASE WHEN event_id % 4 = 0 THEN 1 ELSE 2 END AS groups, CASE WHEN event_id % 5 = 0 THEN 'amqp://broker/q' ELSE 'plain' END AS target FROM d""")  # fmt: skip
def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    null = lambda t: F.lit(None).cast(t)
    spans = deep_spans(spark, sf_dir).withColumns({
        "operation": F.when(n % 3 == 0, F.repeat(F.lit("é"), F.lit(200))).otherwise("op"), "cloud_region": F.when(n % 6 == 0, F.lit("eu\twest")).otherwise("eu-west-3"),
        "source": F.struct(F.concat(F.lit("http://user:word@shop/items?q="), n.cast("string")).alias("endpoint"), F.lit("GET").alias("method")),
        "grouping": F.array(pair("namespace", F.lit("a")), pair("team", F.when(n % 4 == 0, F.lit(" ")).otherwise("b"))), "event_type": F.lit("messaging"),
        "target": F.when(n % 5 == 0, F.lit("amqp://user:word@broker/q?x=1")).otherwise("plain"), "service": F.lit("s"), "timestamp": F.lit("t"), "instrumentation_scopes": null("array<string>"),
    })
    return ingest.sanitize_spans(spans).select("span_id", "operation", "cloud_region", F.col("source.endpoint").alias("endpoint"), F.size("grouping").alias("groups"), "target")
