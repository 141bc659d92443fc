"""Traces by processing time with bounded state, and correlations over micro-batches."""

import json
import random
import time

import pytest

from tests.spans import stamp
from wattspan.sources import readers
from wattspan.streaming.correlate import LiveCorrelations, cross_trace_correlations
from wattspan.streaming.live import detect_stream
from wattspan.streaming.window import assemble_traces


def row(trace, i, ms, service="shop", us=10):
    return {"timestamp": stamp(ms), "trace_id": trace, "span_id": f"{trace}{i}", "service": service, "event_type": "sql", "operation": "SELECT", "target": f"SELECT * FROM t WHERE id = {i}", "duration_us": us, "source": {"endpoint": "/o", "method": "GET"}}


def put(folder, name, rows):
    # a stream lists a folder at any time: the file appears whole
    hidden = folder.parent / f"{name}.part"
    hidden.write_text("".join(json.dumps(r) + "\n" for r in rows))
    hidden.rename(folder / name)


def until(condition, seconds=120):
    end = time.time() + seconds
    while not condition():
        assert time.time() < end, "nothing came"
        time.sleep(0.2)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path / "in"


def test_late_spans_start_a_partial_trace_and_a_trace_keeps_its_last_spans(spark, folder, tmp_path):
    got = []
    traces = assemble_traces(readers.stream_spans(spark, str(folder)), ttl_ms=3_000, shards=2)

    def each(batch, epoch):
        got.extend((r.trace_id, r.reason, len(r.spans), r.lost_spans, [s.span_id for s in r.spans][-1]) for r in batch.collect())

    put(folder, "1.json", [row("a", i, i * 10) for i in range(3)] + [row("big", i, i) for i in range(5_000)])
    query = traces.writeStream.option("checkpointLocation", str(tmp_path / "check")).foreachBatch(each).start()
    try:
        until(lambda: len(got) == 2)
        assert sorted(got) == [("a", "expired", 3, 0, "a2"), ("big", "expired", 1000, 4000, "big4999")]
        put(folder, "2.json", [row("a", 9, 5)])
        until(lambda: len(got) == 3)
        assert got[2] == ("a", "expired", 1, 0, "a9")
    finally:
        query.stop()


def test_the_least_recently_used_trace_goes_first_and_a_restart_goes_on(spark, folder, tmp_path):
    got = []
    def start():
        traces = assemble_traces(readers.stream_spans(spark, str(folder), 1), ttl_ms=3_600_000, max_traces=2, shards=1)
        each = lambda batch, epoch: got.extend((r.trace_id, r.reason, [s.span_id for s in r.spans]) for r in batch.collect())
        return traces.writeStream.option("checkpointLocation", str(tmp_path / "check")).foreachBatch(each).start()

    put(folder, "1.json", [row("a", 0, 0), row("b", 0, 1), row("a", 1, 2)])
    query = start()
    try:
        until(lambda: any(p["numInputRows"] == 3 for p in map(lambda p: json.loads(p.json), query.recentProgress)))
    finally:
        query.stop()
    assert not got
    put(folder, "2.json", [row("c", 0, 3)])
    query = start()
    try:
        until(lambda: got)
        assert got == [("b", "evicted", ["b0"])]
        put(folder, "3.json", [row("d", 0, 4)])
        until(lambda: len(got) == 2)
        assert got[1] == ("a", "evicted", ["a0", "a1"])
    finally:
        query.stop()


def test_findings_and_pairs_of_a_stream(spark, folder, tmp_path):
    found, pairs = [], {}
    live = LiveCorrelations(spark, str(tmp_path / "pairs"), min_count=2, min_confidence=0.5)
    rows = [row(f"{s}{k}", i, k * 20_000 + at + i * 10, service=s) for k in range(3) for s, at in (("shop", 0), ("stock", 1_000)) for i in range(6)]
    put(folder, "1.json", rows)
    query = detect_stream(
        readers.stream_spans(spark, str(folder)), lambda f, epoch: found.extend((r.type, r.trace_id, r.pattern.occurrences) for r in f.collect()), str(tmp_path / "check"), ttl_ms=1_000,
        correlations=live, pairs_sink=lambda p, epoch: pairs.update({r.a: (r.b, r["count"], r.median_lag_ms) for r in p.collect()}),
    )
    try:
        until(lambda: len(found) == 6 and pairs)
    finally:
        query.stop()
    assert sorted(found) == sorted(("n_plus_one_sql", f"{s}{k}", 6) for k in range(3) for s in ("shop", "stock"))
    (a, (b, count, lag)), = pairs.items()
    assert a.startswith("shop|") and b.startswith("stock|") and (count, lag) == (3, 1000.0)


FINDING = "ts_ms long, trace_id string, service string, type string, template string, gk string, gv string"


def findings(rng, n, start, span):
    return [(start + rng.randrange(span), f"t{rng.randrange(10**9)}", rng.choice("abc"), "slow_sql", rng.choice("xy"), "ns", rng.choice("pq")) for _ in range(n)]


def key(df):
    return sorted((r.gv, r.a, r.b, r["count"], r.median_lag_ms, r.first_seen, r.last_seen, r.sample_trace, r.total, r.confidence) for r in df.collect())


def test_batches_give_the_pairs_of_one_batch(spark, tmp_path):
    rng = random.Random(4)
    # overlapping times: a batch brings findings before those of the batch before it, and at their times
    parts = [findings(rng, 60, at, 9_000) for at in (0, 6_000, 12_000)] + [[]]
    limits = dict(lag_ms=500, min_count=2, min_confidence=0.1)
    live = LiveCorrelations(spark, str(tmp_path / "s"), **limits)
    for n, part in enumerate(parts):
        got = key(live.update(spark.createDataFrame(part, FINDING), n))
        every = [r for p in parts[: n + 1] for r in p]
        assert got == key(cross_trace_correlations(spark.createDataFrame(every, FINDING), **limits)) and got
    # a retried batch starts from the state before it
    assert key(live.update(spark.createDataFrame(parts[3], FINDING), 3)) == got
    assert sorted(p.name for p in (tmp_path / "s").iterdir()) == ["batch=2", "batch=3"]


def test_the_window_moves_on_and_rare_pairs_go(spark, tmp_path):
    rng = random.Random(6)
    limits = dict(lag_ms=500, min_count=1, min_confidence=0.0)
    live = LiveCorrelations(spark, str(tmp_path / "w"), window_ms=5_000, **limits)
    parts = [findings(rng, 40, at, 3_000) for at in (0, 3_000, 20_000)]
    for n, part in enumerate(parts):
        got = key(live.update(spark.createDataFrame(part, FINDING), n))
        every = [r for p in parts[: n + 1] for r in p]
        assert got == key(cross_trace_correlations(spark.createDataFrame(every, FINDING), window_ms=5_000, **limits))
    small = LiveCorrelations(spark, str(tmp_path / "c"), max_pairs=10, **limits)
    kept = key(small.update(spark.createDataFrame(parts[0], FINDING), 0))
    every = key(cross_trace_correlations(spark.createDataFrame(parts[0], FINDING), **limits))
    assert len(every) > 10 and len(kept) == 9 and set(kept) <= set(every)
    assert min(r[3] for r in kept) >= max(r[3] for r in every if r not in kept)


def test_sampling_goes_by_fnv_1a(spark):
    from pyspark.sql import functions as F

    from wattspan.functions.hashes import fnv1a64
    from wattspan.operators.ingest import sample_traces

    # Published values of the hash, and a plain version.
    known = {"": 0xCBF29CE484222325, "a": 0xAF63DC4C8601EC8C, "foobar": 0x85944171F73967E8}

    def plain(text):
        h = 0xCBF29CE484222325
        for b in text.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h

    texts = [*known, "é" * 20, "4bf92f3577b34da6a3ce929d0e0e4736", *(f"t{i}" for i in range(200))]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "trace_id string")
    got = {r.trace_id: r.h for r in df.select("trace_id", fnv1a64(F.col("trace_id")).alias("h")).collect()}
    assert all(plain(t) == h for t, h in known.items()) and got == {t: float(plain(t)) for t in texts} | {None: None}
    assert {r.trace_id for r in sample_traces(df, 0.3).collect()} == {t for t in texts if plain(t) / 2**64 < 0.3}
    assert sample_traces(df, 1.0).count() == len(texts) + 1 and sample_traces(df, 0.0).count() == 0
