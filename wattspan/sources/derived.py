"""Spans derived from the order tables: one span a line item, one trace an order. All rows of the tables take part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Regions of the five region keys; the last one is unknown.
REGIONS = ("eu-west-3", "us-east-1", "europe-west1", "westeurope", None)
_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"

#: The same view for DuckDB, as the beginning of every SQL statement.
SPANS_SQL = """
WITH line AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS rn FROM lineitem
), spans AS (
  SELECT 'o' || l_orderkey AS trace_id, 's' || l_orderkey || '-' || rn AS span_id, CASE WHEN rn > 1 THEN 's' || l_orderkey || '-1' END AS parent_span_id,
    'svc-' || (o_custkey % 8) AS service, l_orderkey, rn AS ord,
    CASE WHEN l_returnflag = 'A' OR l_linestatus = 'F' THEN 'sql' WHEN l_returnflag = 'N' THEN 'http_out' ELSE 'messaging' END AS event_type,
    1752156000000 + (l_orderkey % 24) * 3600000 + rn * 20 AS ts_ms, CAST(l_quantity * 1000 AS BIGINT) AS duration_us,
    CASE WHEN l_returnflag = 'A' OR l_linestatus = 'F' THEN 'SELECT * FROM part WHERE p_partkey = ' || l_partkey || ' AND p_size IN (1, 2)'
         WHEN l_returnflag = 'N' THEN 'http://supplier-svc/api/suppliers/' || (l_suppkey % 5) || '?page=' || (l_linenumber % 2) ELSE 'orders' END AS target,
    CASE WHEN l_returnflag = 'A' OR l_linestatus = 'F' THEN 'SELECT' WHEN l_returnflag = 'N' THEN 'GET' ELSE 'kafka' END AS operation,
    'POST /api/orders/' || lower(substr(o_orderpriority, 3)) AS endpoint, CAST(floor(l_extendedprice * 20) AS BIGINT) AS response_size_bytes,
    CASE n_regionkey WHEN 0 THEN 'eu-west-3' WHEN 1 THEN 'us-east-1' WHEN 2 THEN 'europe-west1' WHEN 3 THEN 'westeurope' END AS cloud_region
  FROM line JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
), normalized AS (
  SELECT *,
    CASE event_type WHEN 'sql' THEN 'SELECT * FROM part WHERE p_partkey = ? AND p_size IN (?)' WHEN 'http_out' THEN 'GET supplier-svc/api/suppliers/{id}' ELSE 'kafka orders' END AS template,
    CASE event_type WHEN 'sql' THEN regexp_extract(target, 'p_partkey = ([0-9]+)', 1) || ',1,2' WHEN 'http_out' THEN regexp_extract(target, '[?](.*)$', 1) || ',' || regexp_extract(target, 'suppliers/([0-9]+)', 1) ELSE '' END AS params
  FROM spans
)
"""


def read_tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


#: Spans that one task derives. Rows are dealt while they are narrow, so Spark, which goes by bytes, would give a task too many of them.
SPANS_A_TASK = 150_000
#: Where the spans of a folder of tables are already written.
WRITTEN: dict[str, str] = {}


def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all line items, in the span schema."""
    if sf_dir in WRITTEN:
        return spark.read.parquet(WRITTEN[sf_dir])
    line, orders, supplier, nation = read_tables(spark, sf_dir, "lineitem", "orders", "supplier", "nation")
    text = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs))
    # rows are dealt by trace_id while they are narrow; what groups by it afterwards needs no further shuffle
    in_order = Window.partitionBy("trace_id").orderBy(*_LINE.split(", ")[1:])
    tasks = max(spark.sparkContext.defaultParallelism, -(-line.count() // SPANS_A_TASK))
    line = line.withColumn("trace_id", text("o", F.col("l_orderkey"))).repartition(tasks, "trace_id").withColumn("rn", F.row_number().over(in_order))
    row = line.join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(nation.select("n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"))
    row = row.join(orders.select(text("o", F.col("o_orderkey")).alias("trace_id"), "o_custkey", "o_orderpriority"), "trace_id")
    sql = (F.col("l_returnflag") == "A") | (F.col("l_linestatus") == "F")
    http = ~sql & (F.col("l_returnflag") == "N")
    pick = lambda a, b, c: F.when(sql, a).when(http, b).otherwise(c)
    ts = F.lit(1_752_156_000_000) + (F.col("l_orderkey") % 24) * 3_600_000 + F.col("rn") * 20
    region = F.get(F.array(*map(F.lit, REGIONS)), F.col("n_regionkey").cast("int"))
    null = lambda t: F.lit(None).cast(t)
    from wattspan.functions.times import iso_ms
    from wattspan.schema import CODE, GROUPING

    return row.select(
        iso_ms(ts).alias("timestamp"), ts.alias("ts_ms"), "trace_id", text("s", F.col("l_orderkey"), "-", F.col("rn")).alias("span_id"),
        F.when(F.col("rn") > 1, text("s", F.col("l_orderkey"), "-1")).alias("parent_span_id"), null("string").alias("link_trace_id"), text("svc-", F.col("o_custkey") % 8).alias("service"),
        F.array().cast(GROUPING).alias("grouping"), region.alias("cloud_region"), pick(F.lit("sql"), F.lit("http_out"), F.lit("messaging")).alias("event_type"), pick(F.lit("SELECT"), F.lit("GET"), F.lit("kafka")).alias("operation"),
        pick(text("SELECT * FROM part WHERE p_partkey = ", F.col("l_partkey"), " AND p_size IN (1, 2)"), text("http://supplier-svc/api/suppliers/", F.col("l_suppkey") % 5, "?page=", F.col("l_linenumber") % 2), F.lit("orders")).alias("target"),
        (F.col("l_quantity") * 1000).cast("long").alias("duration_us"), F.struct(text("POST /api/orders/", F.lower(F.substring("o_orderpriority", 3, 99))).alias("endpoint"), F.lit("POST").alias("method")).alias("source"),
        F.lit(200).alias("status_code"), F.floor(F.col("l_extendedprice") * 20).cast("long").alias("response_size_bytes"), null(CODE).alias("code"), F.array().cast("array<string>").alias("instrumentation_scopes"), F.col("rn").cast("long").alias("ord"),
    )
