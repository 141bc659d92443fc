import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wattspan.functions.normalize import http_params, http_template, sql_params, sql_template, sql_tokens

SQL = [
    ("SELECT * FROM t WHERE id = 42", "SELECT * FROM t WHERE id = ?", ["42"]),
    ("SELECT 'it''s', x1 FROM t2", "SELECT ?, x1 FROM t2", ["it''s"]),
    ("SELECT 'open", "SELECT ?", ["open"]),
    ('SELECT "a 1", `b 2` FROM t', 'SELECT "a 1", `b 2` FROM t', []),
    ("WHERE a = $1 AND b = -1.5", "WHERE a = $? AND b = -?", ["1.5"]),
    ("VALUES (1.2.3)", "VALUES (?.?)", ["1.2", "3"]),
    ("SELECT $$a 'b' 1$$, $x$2$x$", "SELECT ?, ?", ["a 'b' 1", "2"]),
    ("WHERE id IN (1, 2,3)", "WHERE id IN (?)", ["1", "2", "3"]),
    ("WHERE join_in (1, 2)", "WHERE join_in (?, ?)", ["1", "2"]),
    ("SELECT 1 -- it's 5\n, 2", "SELECT ? -- it?", ["1", "s 5\n, 2"]),
    ("", "", []),
]
HTTP = [
    ("GET", "http://Shop:8080/api/items/12?page=1&x=2", "GET shop/api/items/{id}", ["page=1", "x=2", "12"]),
    ("GET", "https://u:p@shop./a/0f8fad5b-d9cb-469f-a165-70867728950e", "GET shop/a/{uuid}", ["0f8fad5b-d9cb-469f-a165-70867728950e"]),
    ("POST", "http://10.0.0.1/x", "POST /x", []),
    ("GET", "http://[::1]:80/x", "GET /x", []),
    ("GET", "http://shop", "GET shop/", []),
    ("GET", "http://shop#f", "GET shop/", []),
    ("GET", "/a/7/b", "GET /a/{id}/b", ["7"]),
]


def test_statements(spark):
    rows = spark.createDataFrame([(i, s) for i, (s, _, _) in enumerate(SQL)], "i int, s string").withColumn("k", sql_tokens(F.col("s")))
    got = rows.select("i", sql_template(F.col("k")).alias("t"), sql_params(F.col("k")).alias("p")).orderBy("i").collect()
    assert [(r.t, r.p) for r in got] == [(t, p) for _, t, p in SQL]


def test_urls(spark):
    rows = spark.createDataFrame([(i, m, u) for i, (m, u, _, _) in enumerate(HTTP)], "i int, m string, u string")
    got = rows.select("i", http_template(F.col("m"), F.col("u")).alias("t"), http_params(F.col("u")).alias("p")).orderBy("i").collect()
    assert [(r.t, r.p) for r in got] == [(t, p) for _, _, t, p in HTTP]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aIN ()'\"`$x1.2,?=-", max_size=40), min_size=20, max_size=30))
def test_templates_are_stable_and_hide_numbers(spark, texts):
    once = spark.createDataFrame([(t,) for t in texts], "s string").withColumn("t", sql_template(sql_tokens(F.col("s"))))
    for r in once.withColumn("u", sql_template(sql_tokens(F.col("t")))).collect():
        assert r.u == r.t
        outside = re.sub(r"\"[^\"]*\"?|`[^`]*`?|[A-Za-z_]\w*", "", r.t)
        assert not re.search(r"\d", outside)


def test_long_statements_are_cut(spark):
    texts = ["SELECT '" + "é" * 70_000 + "' , 5", "SELECT 'x" + "é" * 70_000 + "' , 5"]  # the second is cut inside a character
    got = spark.createDataFrame([(t,) for t in texts], "s string").select(sql_template(sql_tokens(F.col("s"))).alias("t")).collect()
    assert [r.t for r in got] == ["SELECT ?"] * 2


def test_words_and_digits_are_ascii(spark):
    """Letters and digits of other scripts are no words and no numbers, whatever class the pattern names them by."""
    rows = spark.createDataFrame([("a = ٣ AND é7 = 4²", "a = ٣ AND é? = ?²", ["7", "4"]), ("x٣9, ſ1_1, K2", "x٣?, ſ?_1, K2", ["9", "1"])], "sql string, want string, params array<string>")
    got = rows.select("want", "params", sql_template(sql_tokens(F.col("sql"))).alias("t"), sql_params(sql_tokens(F.col("sql"))).alias("p")).collect()
    assert all((r.t, r.p) == (r.want, r.params) for r in got), got
