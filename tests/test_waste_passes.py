"""Queries that need findings several times find them once."""

import __spark_entry__ as entry
from tests.test_one_pass import spans
from wattspan.operators import detect as d
from wattspan.operators import score

SF = "/root/testdata/sf0.001"


def line_scans(found):
    return found._jdf.queryExecution().sparkPlan().toString().count("lineitem.parquet")


def test_tiers_are_found_in_one_pass(spark):
    # one for the repeats of both tiers, one for energy and grams
    assert line_scans(entry.queries()["waste_tiers"](spark, SF)) == 2 and line_scans(entry.queries()["canonical_tiers"](spark, SF)) == 2


def test_repeats_by_tier_equal_those_of_each_threshold(spark):
    n = spans(spark)
    row = lambda r: str([r[c] for c in d.FINDING])
    got = d.repeats_by_tier(n, {"a": 2, "b": 300, "c": 10_000}, 5_000).collect()
    for tier, threshold in (("a", 2), ("b", 300), ("c", 10_000)):
        assert sorted(row(r) for r in got if r.tier == tier) == sorted(map(row, d.detect_repeats(n, threshold, 5_000).collect()))
    avoidable = {r.tier: r.avoidable for r in score.avoidable_by_tier(d.repeats_by_tier(n, {"a": 2, "b": 300}, 5_000), ("a", "b", "none")).collect()}
    assert avoidable == {t: score.avoidable_io_ops(d.detect_repeats(n, x, 5_000)).first().avoidable for t, x in (("a", 2), ("b", 300))} | {"none": 0}


def test_tiers_of_no_spans(spark):
    n = spans(spark).filter("false")
    got = score.canonical_tiers(n, score.scored_spans(n)).collect()
    assert sorted((r.tier, r.io_ops, r.avoidable, r.ratio, r.avoidable_kwh) for r in got) == [("canonical", 0, 0, 0.0, 0.0), ("operational", 0, 0, 0.0, 0.0)]


def test_gates_find_repeats_once(spark):
    # the findings are written once; what is left of the spans is their number
    for name in ("gate_after_acknowledgments", "quality_gate"):
        gate = entry.queries()[name](spark, SF)
        assert line_scans(gate) == 1 and len(gate.collect()) == 4
