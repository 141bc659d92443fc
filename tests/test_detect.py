import pytest
from pyspark.sql import functions as F

from tests.spans import frame, span
from wattspan.operators import detect as d
from wattspan.operators import reports, score
from wattspan.schema import Thresholds


def query(i):
    return f"SELECT * FROM items WHERE id = {i}"


def kinds(findings):
    return sorted(r.type for r in findings.select("type").collect())


def test_n_plus_one_needs_count_distinct_parameters_and_window(spark):
    six = [span(i, query(i), i * 50) for i in range(6)]
    found = d.detect_n_plus_one(frame(spark, six)).collect()
    assert len(found) == 1 and found[0].pattern.occurrences == 6 and found[0].pattern.distinct_params == 6 and found[0].severity == "warning"
    assert d.detect_n_plus_one(frame(spark, six[:4])).count() == 0
    assert d.detect_n_plus_one(frame(spark, [span(i, query(i), i * 100) for i in range(6)])).count() == 1  # exactly at the limit
    assert d.detect_n_plus_one(frame(spark, [span(i, query(i), i * 101) for i in range(6)])).count() == 0
    assert d.detect_n_plus_one(frame(spark, [span(i, query(i), i) for i in range(10)])).first().severity == "critical"


def test_publishes_need_no_parameters(spark):
    found = d.detect_n_plus_one(frame(spark, [span(i, "orders", i * 10, kind="messaging") for i in range(5)])).collect()
    assert [(f.type, f.pattern.distinct_params) for f in found] == [("n_plus_one_messaging", 1)]


@pytest.mark.parametrize(("mode", "scopes", "varied", "fires"), [("never", ["x.hibernate-6"], True, False), ("auto", ["x.hibernate-6"], False, True), ("auto", [], False, False), ("auto", [], True, True), ("always", [], False, True), ("strict", ["x.hibernate-6"], True, True), ("strict", ["x.hibernate-6"], False, False)])
def test_statements_without_parameters(spark, mode, scopes, varied, fires):
    rows = [span(i, "SELECT * FROM items WHERE id = ?", i * 20, scopes=scopes, us=100 + 4000 * (varied and i % 3 == 0)) for i in range(6)]
    found = d.detect_n_plus_one(frame(spark, rows), mode=mode).collect()
    assert [f.classification_method for f in found] == ["sanitizer_heuristic"] * fires


def test_redundant_is_exclusive_with_n_plus_one(spark):
    rows = [span(i, query(i), i * 10) for i in range(5)] + [span(9, query(0), 60)] + [span(20 + i, "SELECT now()", i) for i in range(5)]
    n = frame(spark, rows)
    n1 = d.detect_n_plus_one(n)
    again = d.detect_redundant(n, n1).collect()
    assert [(f.pattern.template, f.pattern.occurrences, f.severity) for f in again] == [("SELECT now()", 5, "warning")]
    assert len(again[0].evidence) == 5 and d.redundant_spans(n, n1).count() == 5


def test_waste_counts_each_template_once(spark):
    n = frame(spark, [span(i, query(i), i * 10) for i in range(6)] + [span(7, query(1), 70)])
    n1 = d.detect_n_plus_one(n)
    got = score.avoidable_io_ops(n1.unionByName(d.detect_redundant(n, n1))).first()
    assert (got.avoidable, got.avoidable_sql, got.avoidable_messaging) == (6, 6, 0)


def test_slow_in_a_trace_and_across_traces(spark):
    slow = [span(i, query(i), i, us=600_000 + i) for i in range(3)]
    assert kinds(d.detect_slow(frame(spark, slow))) == ["slow_sql"]
    assert d.detect_slow_cross_trace(frame(spark, slow)).count() == 0
    spread = [span(0, query(i), i, trace=f"t{i}", us=3_000_000 + i) for i in range(3)]
    found = d.detect_slow_cross_trace(frame(spark, spread)).collect()
    assert [(f.trace_id, f.severity, f.pattern.span_duration_us_p50) for f in found] == [("t2", "critical", 3_000_001)]
    assert d.detect_slow(frame(spark, spread)).count() == 0


def test_fanout_with_and_without_its_parent(spark):
    children = [span(i, query(i), i, parent="root") for i in range(1, 6)]
    got = d.detect_fanout(frame(spark, children), 4).first()
    assert got.pattern.template == "parent:root" and got.severity == "warning"
    root = span(0, "/work", 0, kind="http_out")
    rows = [(*root[:2], "root", *root[3:]), *[span(i, query(i), i, parent="root") for i in range(1, 14)]]
    got = d.detect_fanout(frame(spark, rows), 4).first()
    assert got.pattern.template == "GET /work" and got.severity == "critical" and got.pattern.occurrences == 13


def test_chatty_and_pool(spark):
    calls = [span(i, f"http://a/x/{i % 2}", i * 600, kind="http_out") for i in range(4)]
    assert d.detect_chatty(frame(spark, calls), 3).first().pattern.template == "POST /orders"
    at_once = [span(i, query(i), i, us=100_000) for i in range(4)] + [span(9, query(9), 2, us=0), span(10, query(10), 500, us=10)]
    n = frame(spark, at_once)
    got = d.detect_pool_saturation(n, 4).first()
    assert got.pattern.occurrences == 4 and got.pattern.distinct_params == 6
    assert sorted(r.span_id for r in d.pool_peak_spans(n, 4).collect()) == [f"t1-s{i}" for i in range(4)]
    assert d.detect_pool_saturation(n, 5).count() == 0


def test_serialized_chain(spark):
    rows = [span(i, f"http://svc{i}/a", i * 20, kind="http_out", us=15_000, parent="p") for i in range(4)] + [span(8, "http://long/a", 0, kind="http_out", us=90_000, parent="p")]
    got = d.detect_serialized(frame(spark, rows)).first()
    assert got.pattern.occurrences == 4 and got.evidence == [f"t1-s{i}" for i in range(4)]
    same = [span(i, "http://svc/a", i * 20, kind="http_out", us=15_000, parent="p") for i in range(4)]
    assert d.detect_serialized(frame(spark, same)).count() == 0


def test_findings_do_not_depend_on_the_order_of_spans_and_add_up_over_traces(spark):
    rows = [span(i, query(i), i * 30, trace=t, parent="p") for t in ("a", "b") for i in range(6)]
    limits = Thresholds(fanout=5)
    key = lambda df: sorted((r.type, r.trace_id, r.pattern.occurrences) for r in d.detect_all(df, limits).filter(~F.col("type").startswith("slow")).collect())
    both = key(frame(spark, rows))
    assert both == key(frame(spark, rows[::-1]))
    assert both == sorted(key(frame(spark, rows[:6])) + key(frame(spark, rows[6:])))
    assert d.detect_all(frame(spark, []), limits).count() == 0


def test_grouping_keeps_groups_apart(spark):
    rows = [span(i, query(i), i * 10, grouping=[("ns", "x" if i % 2 else "y")]) for i in range(8)]
    assert d.detect_n_plus_one(frame(spark, rows)).count() == 0 and d.detect_n_plus_one(frame(spark, rows), 4).count() == 2


def test_gate_diff_and_acknowledgments(spark):
    n = frame(spark, [span(i, query(i), i * 10) for i in range(10)])
    findings = reports.finding_signature(reports.stamp_confidence(d.detect_n_plus_one(n)))
    gate = reports.quality_gate(findings, score.io_waste(n, findings))
    assert not reports.gate_passed(gate).first().passed and gate.count() == 4
    milder = d.detect_n_plus_one(frame(spark, [span(i, query(i), i * 10) for i in range(6)]))
    assert [r.change for r in reports.severity_changes(findings, milder).collect()] == ["improved"]
    assert [r.change for r in reports.diff_findings(milder.limit(0), findings).collect()] == ["new"]
    acks = spark.createDataFrame([(findings.first().signature, "2026-02-01", None, None), ("gone", None, "shop", "POST /orders")], "signature string, expires_at string, service string, endpoint string")
    open_, done = reports.apply_acknowledgments(findings, acks, "2026-02-01")
    assert (open_.count(), done.count()) == (0, 1)
    assert reports.apply_acknowledgments(findings, acks, "2026-02-02")[0].count() == 1
    assert [r.status for r in reports.unmatched_acknowledgments(findings, acks, "2026-01-01", score.endpoint_stats(n)).collect()] == ["likely_fixed"]
    assert reports.sarif_results(findings).first().level == "error"


def test_explain_tree_holds_deep_spans_and_findings_without_a_span(spark):
    rows = [span(i, query(i), i, parent=f"t1-s{i - 1}" if i else None) for i in range(12)]
    rows += [span(3, "SELECT 1", 50, parent="t1-s2"), span(20, query(1), 60, parent="t1-s21"), span(21, query(1), 61, parent="t1-s20")]  # a repeated id, a cycle
    rows += [span(i, query(i), i, trace="t2", parent="gone") for i in range(9)]
    n = frame(spark, rows)
    found = d.detect_fanout(n, 8)
    tree = reports.explain_tree(n, found).collect()
    deep = sorted((r.depth, r.path[-1]) for r in tree if r.trace_id == "t1")
    assert deep == sorted([(i, f"t1-s{i}") for i in range(12)] + [(3, "t1-s3")])
    assert all(len(r.path) == r.depth + 1 for r in tree if r.path)
    assert sum(r.trace_id == "t2" and r.depth == 0 and r.findings is None for r in tree) == 9
    assert [(r.trace_id, r.template, r.findings) for r in tree if r.span_id is None] == [("t2", "parent:gone", ["excessive_fanout"])]
    assert max(r.depth for r in reports.explain_tree(n, found, 3).collect() if r.path) == 3


def test_open_statements_of_a_huge_trace(spark):
    """A trace with most spans, over many blocks, with ends before starts, spans of no duration and spans over many blocks."""
    import random

    rng = random.Random(2)
    rows = [span(i, query(i % 9), rng.randrange(0, 60_000), us=rng.choice([0, 500, 20_000, 3_000_000, 0])) for i in range(4_000)]
    rows += [span(i, query(i), i, trace=f"small{i % 40}", us=rng.choice([0, 5_000])) for i in range(400)]
    n = frame(spark, rows)
    got = {(r.trace_id, r.t): r.open for r in d._concurrency(n, 1).collect()}
    steps: dict = {}
    for r in n.select("trace_id", "ts_ms", "duration_us").collect():
        steps.setdefault(r.trace_id, []).extend([(r.ts_ms * 1000, 1), (r.ts_ms * 1000 + r.duration_us, -1)])
    want = {}
    for trace, own in steps.items():
        open_ = 0
        for t, x in sorted(own):
            open_ = max(open_ + x, 0)
            want[trace, t] = open_
    assert got == want and max(got.values()) > 30 and len(want) > 6_000
    saturated = {r.trace_id: r.pattern.occurrences for r in d.detect_pool_saturation(n, 20).collect()}
    assert saturated == {"t1": max(v for (trace, _), v in want.items() if trace == "t1")}


def test_serialized_calls_of_a_huge_parent_are_cut_where_it_idles(spark):
    """One parent with most children, with ties, children of no duration and children over many blocks; both scans agree with a plain walk."""
    import random

    rng = random.Random(4)
    rows = [span(i, f"SELECT a{i % 3} FROM t", rng.randrange(0, 90_000), parent="root", us=rng.choice([0, 1_000, 20_000, 40_000, 2_500_000 * (i % 50 == 0)])) for i in range(3_000)]
    rows += [span(i, f"SELECT a{i // 30 % 2} FROM t", rng.randrange(0, 40), trace=f"small{i % 30}", parent="p", us=rng.choice([0, 5_000])) for i in range(240)]
    n = frame(spark, rows)
    children: dict = {}
    for r in n.collect():
        children.setdefault(r.trace_id, []).append({"start": r.ts_ms * 1000, "ord": r.ord, "span_id": r.span_id, "end": r.ts_ms * 1000 + r.duration_us})
    order = ("start", "ord", "span_id", "end")
    want = {(t, x) for t, own in children.items() for x in d._longest_chain(sorted(own, key=lambda s: tuple(s[k] for k in order)))}
    for large in (1_000, 10_000):
        chains = d.serialized_chains(n, 3, large).collect()
        assert {(r.trace_id, r.span_id) for r in chains} == want and len(chains) == len(want)
    timed = spark.createDataFrame([("t", "p", 3_000, s["start"], s["end"], s["ord"], s["span_id"]) for s in children["t1"]], "trace_id string, parent string, n int, start long, end long, ord long, span_id string")
    sizes = [sorted(r["count"] for r in d.busy_segments(timed, large).groupBy("segment").count().collect()) for large in (1_000, 10_000)]
    assert sizes[0] == sizes[1] and len(sizes[0]) > 20 and sizes[0][-1] < 1_500
    assert {r.trace_id for r in d.detect_serialized(n, 3, 1_000).collect()} == {t for t, own in children.items() if sum(x == t for x, _ in want) >= 3}


def test_variation_does_not_depend_on_the_order_of_spans(spark):
    """1000 * deviation / mean is exactly 437.5 here, so 438; running means over some orders of the values give 437."""
    from itertools import permutations

    values = [11000, 27000, 17000, 9000]
    rows = [(i, x) for i, p in enumerate(permutations(values)) for x in p] + [(-1, 15_000), (-1, 17_000), (-2, 7), (-3, 0), (-3, 0)]
    got = {r.g: r.cv for r in spark.createDataFrame(rows, "g int, duration_us long").coalesce(1).groupBy("g").agg(*d.timing_stats()).collect()}
    assert {v for g, v in got.items() if g >= 0} == {438} and (got[-1], got[-2], got[-3]) == (63, 0, 0)


@pytest.mark.parametrize("mode", ["auto", "strict", "always"])
def test_repeats_in_one_pass_equal_the_two_detectors_and_deal_spans_once(spark, mode):
    import random

    rng = random.Random(7)
    target = {"sql": lambda: f"SELECT * FROM t{rng.randrange(3)} WHERE id = {rng.choice([1, 2, rng.randrange(99), '?'])}", "http_out": lambda: f"http://a/{rng.choice('xy')}/{rng.randrange(3)}", "messaging": lambda: "orders"}
    rows = []
    for i in range(1_500):
        kind = rng.choice(list(target))
        rows.append(span(i, target[kind](), rng.randrange(600), trace=f"t{i % 40}", kind=kind, us=rng.randrange(1, 30_000), parent=rng.choice(["p", "p", None]), grouping=[("ns", "x")] if rng.random() < 0.1 else ()))
    n = frame(spark, rows)
    n1 = d.detect_n_plus_one(n, 4, 500, mode)
    row = lambda f: [str((r.type, r.severity, r.trace_id, r.grouping, r.source_endpoint, r.pattern, r.first_timestamp, r.last_timestamp, r.classification_method, r.evidence, r.suggestion)) for r in f.collect()]
    both = row(d.detect_repeats(n, 4, 500, mode))
    assert sorted(both) == sorted(row(n1) + row(d.detect_redundant(n, n1))) and len(set(both)) > 40
    plan = d.detect_repeats(n.repartition(3, "trace_id"), 4, 500, mode)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
