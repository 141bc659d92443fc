"""Templates of SQL statements, URLs and messages as column expressions.

A statement is read once from left to right: each match takes what stays as it is (quoted names, words with their digits,
signs) and then one value, so a number counts only where no word character stands before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# \w is one test a character; ranges like 0-9A-Za-z_ are one each, which made this five times as slow
_KEPT = r"(?:[^'\"\x60$\w]++|(?!\d)\w++|\"[^\"]*+\"?|\x60[^\x60]*+\x60?|\$(?=\d)|\$(?!\d|(?:[A-Za-z_][A-Za-z0-9_]*)?\$))*+"
_VALUE = r"'(?:[^']|'')*+'?|(\$(?:[A-Za-z_][A-Za-z0-9_]*)?\$).*?(?:\3|\z)|\d++(?:\.\d*+)?"
#: What is kept, then the number of a placeholder like $1, or a value (group 2).
_STEP = rf"(?s)\G({_KEPT})(?:(?<=\$)\d+|({_VALUE}))"
_IN_WORD = r"(?i)(?:^|\s)IN(?![A-Za-z0-9])"
_IN_LIST = r"(?i)IN\s*\(\s*\?(?:\s*,\s*\?)*\s*\)"
#: Statements are cut at so many bytes.
MAX_STATEMENT = 65_536
_UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
_IPV4 = r"^\d{1,3}(\.\d{1,3}){3}$"
#: Query pairs kept as parameters.
MAX_QUERY_PAIRS = 100


def _cut(sql: Column) -> Column:
    """At most MAX_STATEMENT bytes, on a character boundary."""
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(sql, "UTF-8"), 1, MAX_STATEMENT).cast("string")), "\ufffd+$", "")
    return F.when(F.octet_length(sql) <= MAX_STATEMENT, sql).otherwise(cut)


def _unquoted(token: Column) -> Column:
    """A value token without its quotes or dollar tags."""
    tagged = F.regexp_replace(token, r"(?s)^(\$\w*\$)(.*?)(?:\1)?$", "$2")
    quoted = F.regexp_replace(token, r"(?s)^'(.*?)'?$", "$1")
    return F.when(token.startswith("$"), tagged).when(token.startswith("'"), quoted).otherwise(token)


def sql_masked(sql: Column) -> Column:
    """The statement with ? for each literal and $? for each placeholder."""
    return F.regexp_replace(_cut(sql), _STEP, "$1?")


def _collapsed(masked: Column) -> Column:
    """Lists after IN collapse."""
    return F.when(masked.rlike(_IN_WORD), F.regexp_replace(masked, _IN_LIST, "IN (?)")).otherwise(masked)


def _literals(sql: Column) -> Column:
    """The literals without their quotes, in order."""
    return F.transform(F.filter(F.regexp_extract_all(_cut(sql), F.lit(_STEP), F.lit(2)), lambda v: v != ""), _unquoted)


def sql_tokens(sql: Column) -> Column:
    """What a statement is read into: masked and params."""
    return F.struct(sql_masked(sql).alias("masked"), _literals(sql).alias("params"))


def sql_template(tokens: Column) -> Column:
    """Literals become ?, $1 becomes $?, and lists after IN collapse."""
    return _collapsed(tokens["masked"])


def sql_params(tokens: Column) -> Column:
    return tokens["params"]


def _bare(target: Column) -> Column:
    """Host and port of an http(s) URL; empty for other targets."""
    return F.regexp_replace(F.regexp_extract(target, r"(?i)^https?://([^/?#]*)", 1), r"^.*@", "")


def _name(bare: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(bare, r":\d*$", "")), r"\.$", "")


def _host(bare: Column, name: Column) -> Column:
    return F.when(bare.startswith("[") | name.rlike(_IPV4), F.lit("")).otherwise(name)


def http_host(target: Column) -> Column:
    """Lower-case host of an http(s) URL without user, port and trailing dot; empty for IP literals and for other targets."""
    return _host(_bare(target), _name(_bare(target)))


def _rest(target: Column) -> Column:
    """What follows the host: path, query and fragment."""
    return F.regexp_replace(target, r"(?i)^https?://[^/?#]*", "")


def _segments(rest: Column) -> Column:
    path = F.when(rest.startswith("#"), F.lit("/")).otherwise(F.substring_index(rest, "?", 1))
    return F.split(F.when(path == "", F.lit("/")).otherwise(path), "/")


def _template(method: Column, host: Column, segments: Column) -> Column:
    mask = lambda s: F.when(s.rlike(_UUID), F.lit("{uuid}")).when(s.rlike(r"^\d+$"), F.lit("{id}")).otherwise(s)
    return F.concat(method, F.lit(" "), host, F.array_join(F.transform(segments, mask), "/"))


def _params(rest: Column, segments: Column) -> Column:
    query = F.when(rest.startswith("#"), F.lit("")).otherwise(F.regexp_extract(rest, r"(?s)^[^?]*\?(.*)$", 1))
    pairs = F.slice(F.split(query, "&"), 1, MAX_QUERY_PAIRS)
    masked = F.filter(segments, lambda s: s.rlike(_UUID) | s.rlike(r"^\d+$"))
    return F.concat(F.filter(pairs, lambda p: p != ""), masked)


def http_template(method: Column, target: Column) -> Column:
    """METHOD host/path, where UUID segments become {uuid} and number segments {id}."""
    return _template(method, http_host(target), _segments(_rest(target)))


def http_params(target: Column) -> Column:
    """The first query pairs, then masked path segments."""
    return _params(_rest(target), _segments(_rest(target)))


def normalize_spans(spans: DataFrame) -> DataFrame:
    """spans with template and params; publishes are never masked."""
    kind, target = F.col("event_type"), F.col("target")
    http = lambda c: F.when(kind == "http_out", c)
    # a column of its own, used several times, is computed once
    out = spans.withColumns({"_masked": F.when(kind == "sql", sql_masked(target)), "_bare": http(_bare(target)), "_rest": http(_rest(target))})
    out = out.withColumns({"_name": _name(F.col("_bare")), "_segments": _segments(F.col("_rest"))})
    template = F.when(kind == "sql", _collapsed(F.col("_masked"))).when(kind == "http_out", _template(F.col("operation"), _host(F.col("_bare"), F.col("_name")), F.col("_segments"))).otherwise(F.concat_ws(" ", "operation", "target"))
    params = F.when(kind == "sql", _literals(target)).when(kind == "http_out", _params(F.col("_rest"), F.col("_segments"))).otherwise(F.array().cast("array<string>"))
    return out.withColumns({"template": template, "params": params}).drop("_masked", "_bare", "_rest", "_name", "_segments")


def template_rollup(normalized: DataFrame) -> DataFrame:
    """Calls, distinct parameter lists, durations and traces of each template of a service.

    Parameter lists count by a 64-bit hash. Spans of one template, trace and list meet before anything is shuffled further.
    """
    keys = ["event_type", "service", "template"]
    kept = [F.sum("calls").alias("calls"), F.sum("total_us").alias("total_us"), F.max("max_us").alias("max_us")]
    first = [F.count(F.lit(1)).alias("calls"), F.sum("duration_us").alias("total_us"), F.max("duration_us").alias("max_us"), F.count("duration_us").alias("timed")]
    each = normalized.groupBy(*keys, "trace_id", F.xxhash64("params").alias("same")).agg(*first)
    out = each.groupBy(*keys).agg(*kept, F.sum("timed").alias("timed"), F.countDistinct("same").alias("distinct_params"), F.countDistinct("trace_id").alias("traces"))
    return out.select(*keys, "calls", "distinct_params", "total_us", (F.col("total_us") / F.col("timed")).alias("mean_us"), "max_us", "traces")
