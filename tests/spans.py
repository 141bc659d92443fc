"""Span rows for tests, in the span schema."""

from wattspan.functions.normalize import normalize_spans
from wattspan.schema import SPANS
from wattspan.sources.readers import with_order

BASE = 1_752_156_000_000


def stamp(ms):
    import datetime as dt

    return (dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=BASE + ms)).strftime("%Y-%m-%dT%H:%M:%S.") + f"{(BASE + ms) % 1000:03d}Z"


def span(i, target, ms, trace="t1", kind="sql", us=800, parent=None, service="shop", endpoint="POST /orders", scopes=(), op=None, grouping=(), region=None, size=None):
    operation = op or {"sql": "SELECT", "http_out": "GET", "messaging": "kafka"}[kind]
    return (stamp(ms), trace, f"{trace}-s{i}", parent, None, service, [tuple(g) for g in grouping], region, kind, operation, target, us, (endpoint, "POST"), 200, size, None, list(scopes))


def frame(spark, rows):
    return normalize_spans(with_order(spark.createDataFrame(rows, SPANS)))
