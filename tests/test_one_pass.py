"""Detectors read spans that are dealt by trace once and don't shuffle them again; how many spans a task derives doesn't grow with the tables."""

import random

from tests.spans import frame, span
from wattspan.operators import detect as d
from wattspan.sources import derived


def spans(spark, n=900):
    rng = random.Random(11)
    targets = {"sql": "SELECT * FROM t WHERE id = 1", "http_out": "http://a/x/1", "messaging": "orders"}
    rows = []
    for i in range(n):
        kind = rng.choice(list(targets))
        rows.append(span(i, targets[kind], rng.randrange(3_000), trace=f"t{i % 5}", kind=kind, us=rng.choice([0, 900, 40_000, 1_200_000]), parent=rng.choice(["p", "q", None])))
    return frame(spark, rows)


def dealt(spark, name):
    """Spans that are read from a file, dealt by trace."""
    path = f"{spark.conf.get('spark.checkpoint.dir')}/{name}"
    spans(spark).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).repartition(3, "trace_id")


def passes(found):
    plan = found._jdf.queryExecution().sparkPlan().toString()
    return plan.count("FileScan"), found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_pools_are_found_in_one_pass_at_their_first_peak(spark):
    assert passes(d.detect_pool_saturation(dealt(spark, "pool"), 3)) == (1, 1)
    n = spans(spark)
    walk: dict = {}
    for r in d._concurrency(n, 1).collect():
        walk.setdefault(r.trace_id, []).append((r.open, -r.t))
    want = {t: (max(w)[0], -max(w)[1]) for t, w in walk.items()}
    assert {r.trace_id: (r.peak, r.peak_t) for r in d._peaks(n, 2).collect()} == want and len(want) == 5
    assert d._peaks(n, max(p for p, _ in want.values()) + 1).count() == 0


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    counts = []
    for limit in (1_000_000, 100):
        monkeypatch.setattr(derived, "SPANS_A_TASK", limit)
        counts.append(derived.order_spans(spark, "/root/testdata/sf0.001").rdd.getNumPartitions())
    assert counts[0] == spark.sparkContext.defaultParallelism and counts[1] > 50


#: evidence


def test_fanout_and_serialized_calls_are_found_in_one_pass(spark):
    n = dealt(spark, "evidence")
    # Spark forgets how rows are dealt where Python finds the chains, so these are dealt once more
    assert passes(d.detect_fanout(n, 8)) == (1, 1) and passes(d.detect_serialized(n, 3, None)) == (1, 2)
    rows = lambda found: sorted(str(r) for r in found.collect())
    at_once = rows(d.detect_serialized(n, 3, None))
    assert at_once == rows(d.detect_serialized(spans(spark), 3, 100)) and len(at_once) == 10


#: all findings


def test_findings_are_sorted_after_one_run_of_the_detectors(spark):
    n = dealt(spark, "all")
    kept = d.kept_spans(n, dealt=True)
    kept.count()  # Spark knows how kept rows are dealt once they are there
    parts = [d.detect_repeats(kept, 5, 500), d.detect_chatty(kept, 2), d.detect_slow(kept, 25, 3)]
    assert all(x._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0].count("Exchange") == 0 for x in parts)
    ordered = d.sort_findings(parts[1])._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert ordered.count("Exchange hashpartitioning") == 1 and ordered.count("Exchange rangepartitioning") == 1
    kept.unpersist()
    spark.catalog.clearCache()
