import json

from pyspark.sql import functions as F

from tests.spans import BASE, stamp
from wattspan.operators import ingest, periodic
from wattspan.sources import readers


def put(path, value, lines=False):
    path.write_text("\n".join(map(json.dumps, value)) if lines else json.dumps(value))
    return str(path)


def attrs(**own):
    return [{"key": k.replace("__", "."), "value": {"stringValue": v}} for k, v in own.items()]


def test_otlp_spans(spark, tmp_path):
    ns = lambda ms: str((BASE + ms) * 1_000_000)
    spans = [
        {"traceId": "t", "spanId": "root", "name": "GET /o", "kind": 2, "startTimeUnixNano": ns(0), "endTimeUnixNano": ns(50), "attributes": attrs(http__route="/o/{id}")},
        {"traceId": "t", "spanId": "mid", "parentSpanId": "root", "name": "repo", "kind": 1, "startTimeUnixNano": ns(1), "endTimeUnixNano": ns(9), "attributes": attrs(code__function="load", code__namespace="a.B")},
        {"traceId": "t", "spanId": "sql", "parentSpanId": "mid", "name": "q", "kind": 3, "startTimeUnixNano": ns(2), "endTimeUnixNano": ns(4), "attributes": attrs(db__system="postgres", db__statement="SELECT 1")},
        {"traceId": "t", "spanId": "dup", "parentSpanId": "sql", "name": "q", "kind": 3, "startTimeUnixNano": ns(2), "endTimeUnixNano": ns(3), "attributes": attrs(db__system="postgres", db__statement="SELECT 1")},
        {"traceId": "t", "spanId": "redis", "parentSpanId": "mid", "name": "GET", "kind": 3, "startTimeUnixNano": ns(5), "endTimeUnixNano": ns(6), "attributes": attrs(db__system="redis", db__statement="GET k")},
        {"traceId": "t", "spanId": "pub", "parentSpanId": "mid", "name": "send", "kind": 4, "startTimeUnixNano": ns(6), "endTimeUnixNano": ns(7), "attributes": attrs(messaging__system="kafka", messaging__destination__name="orders")},
    ]
    doc = {"resourceSpans": [{"resource": {"attributes": attrs(service__name="shop", k8s__namespace__name="prod")}, "scopeSpans": [{"scope": {"name": "agent"}, "spans": spans}]}]}
    path = put(tmp_path / "o.json", doc)
    got = {r.span_id: r for r in readers.read_otlp_spans(spark, path).collect()}
    assert sorted(got) == ["pub", "sql"]
    assert got["sql"].source.endpoint == "/o/{id}" and got["sql"].duration_us == 2000 and got["sql"].ts_ms == BASE + 2 and got["sql"].timestamp == stamp(2)
    assert got["sql"].grouping[0].value == "prod" and got["pub"].operation == "kafka" and got["pub"].target == "orders"
    stats = ingest.ingest_stats(readers.classify_raw(readers.raw_otlp_spans(spark, path))).first()
    assert (stats.sql, stats.non_sql_datastore, stats.not_io, stats.usable) == (2, 1, 2, None)


def test_jaeger_and_zipkin_give_the_same_spans(spark, tmp_path):
    us = (BASE + 5) * 1000
    tags = {"http.url": "http://a/b", "http.method": "get"}
    jaeger = {"data": [{"traceID": "t", "spans": [{"spanID": "s", "operationName": "x", "references": [], "startTime": us, "duration": 7, "processID": "p", "tags": [{"key": k, "value": v} for k, v in tags.items()]}], "processes": {"p": {"serviceName": "shop", "tags": []}}}]}
    zipkin = [{"traceId": "t", "id": "s", "name": "x", "kind": "CLIENT", "timestamp": us, "duration": 7, "localEndpoint": {"serviceName": "shop"}, "tags": tags}]
    columns = ["trace_id", "span_id", "service", "event_type", "operation", "target", "duration_us", "timestamp"]
    a = readers.read_jaeger_spans(spark, put(tmp_path / "j.json", jaeger)).select(columns).collect()
    b = readers.read_zipkin_spans(spark, put(tmp_path / "z.json", zipkin)).select(columns).collect()
    assert a == b and a[0].operation == "GET" and a[0].target == "http://a/b"


def test_statement_statistics_of_csv_and_json_agree(spark, tmp_path):
    (tmp_path / "p.csv").write_text('query,calls,total_exec_time,mean_exec_time,rows,shared_blks_hit,shared_blks_read\n"SELECT ""a"", 1",2,3.5,1.75,4,5,6\n')
    put(tmp_path / "p.json", [{"query": 'SELECT "a", 1', "calls": 2, "total_exec_time": 3.5, "mean_exec_time": 1.75, "rows": 4, "shared_blks_hit": 5, "shared_blks_read": 6}])
    rows = [readers.read_pg_statements(spark, str(tmp_path / f"p.{x}")).collect() for x in ("csv", "json")]
    assert rows[0] == rows[1] and rows[0][0].template == 'SELECT "a", ?'
    (tmp_path / "m.csv").write_text("SCHEMA_NAME,DIGEST_TEXT,COUNT_STAR,SUM_TIMER_WAIT,AVG_TIMER_WAIT,SUM_ROWS_SENT,SUM_ROWS_EXAMINED\nshop,SELECT ?,3,9000000000,3000000000,1,2\nshop,NULL,1,1,1,1,1\n")
    got = readers.read_mysql_digests(spark, str(tmp_path / "m.csv")).collect()
    assert len(got) == 1 and got[0].total_exec_time_ms == 9.0


def test_energy_profiles_and_acknowledgments(spark, tmp_path):
    (tmp_path / "e.csv").write_text(f"timestamp,service,energy_kwh\n# note\n{stamp(0)},a,1.5\n{stamp(1)},a,-1\n{stamp(2)},a,NaN\nbad,a,1\n")
    assert [(r.service, r.kwh) for r in readers.read_energy_readings(spark, str(tmp_path / "e.csv")).collect()] == [("a", 1.5)]
    put(tmp_path / "h.json", [{"region": "x", "hourly": [1.0] * 24}, {"region": "y", "hourly": [-1.0] * 24}, {"region": "z", "monthly": [[float(h) for h in range(24)]] * 12}])
    got = readers.read_hourly_profiles(spark, str(tmp_path / "h.json")).groupBy("region").count().collect()
    assert sorted((r.region, r["count"]) for r in got) == [("x", 24), ("z", 288)]
    put(tmp_path / "a.json", [{"signature": "s"}, {"reason": "none"}], lines=True)
    assert readers.read_acknowledgments(spark, str(tmp_path / "a.json")).count() == 1


def test_sanitize_and_secrets(spark):
    texts = [("https://u:p@h/x?token=1#f", "https://h/x"), ("/a/b?c", "/a/b"), ("a/b://c@d", "a/b://c@d")]
    rows = spark.createDataFrame(texts, "s string, want string").withColumn("got", ingest.strip_endpoint_secrets(F.col("s")))
    assert all(r.got == r.want for r in rows.collect())
    cut = spark.createDataFrame([("é" * 10,)], "s string").select(ingest.cut_bytes(F.col("s"), 5).alias("c")).first().c
    assert cut == "éé"


def test_ancestors_stop_at_cycles_and_missing_parents(spark):
    rows = [("t", "a", "b"), ("t", "b", "a"), ("t", "c", "gone"), ("t", "d", "d"), ("t", "e", "d")]
    got = {(r.span_id, r.hop, r.ancestor) for r in ingest.ancestors(spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string"), 3).collect()}
    assert ("e", 1, "d") in got and ("a", 1, "b") in got and all(s != x for s, _, x in got) and not any(s == "c" for s, _, _ in got)
