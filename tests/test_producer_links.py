"""Producer links come from one pass over the spans: siblings are scanned in order, ancestors are looked up, nothing is joined."""

import random
from collections import Counter

from tests.test_one_pass import passes
from wattspan.operators.ingest import resolve_producer_link

SCHEMA = "trace_id string, span_id string, parent_span_id string, kind string, ts_ms long, link_trace_id string"


def plain(rows, hops):
    """The rules one after the other, over one trace with unique ids."""
    by_id = {r[1]: r for r in rows}
    links = [r for r in rows if r[3] == "CONSUMER" and r[5] and r[5] != r[0] and r[5] != "0" * 32]
    at = {}
    for r in rows:
        before = [c for c in links if r[2] is not None and c[2] == r[2] and None not in (c[4], r[4]) and c[4] <= r[4] and c[1] != r[1]]
        at[r[1]] = max(before, key=lambda c: (c[4], c[1]))[5] if before else None
    out = Counter()
    for r in rows:
        found, up = at[r[1]], r
        for _ in range(hops):
            if found or up[2] == up[1] or up[2] not in by_id or up[2] == r[1]:
                break
            up = by_id[up[2]]
            found = up[5] if up in links else at[up[1]]
        out[(r[0], r[1], found)] += 1
    return out


def rows_of(rng, trace, n):
    for k in range(n):
        parent = rng.choice([None, "", "gone", f"s{rng.randrange(n)}"] + [f"s{max(k - 1, 0)}"] * 4 + [f"s{k // 3}"])
        kind = rng.choice(["CONSUMER"] + ["CLIENT"] * rng.choice([1, 9]) + [None])
        yield (trace, f"s{k}", parent, kind, rng.choice([None, *range(6)]), rng.choice([f"l{k}", "x", "y", None, trace, "0" * 32]))


def test_links_of_siblings_and_ancestors(spark):
    rng = random.Random(5)
    traces = [list(rows_of(rng, f"t{t}", rng.choice([1, 8, 30]))) for t in range(80)]
    ring = [("ring", f"s{k}", f"s{(k + 1) % 5}", "CONSUMER" if k == 2 else "CLIENT", k, "far") for k in range(5)]
    df = spark.createDataFrame([r for rows in [*traces, ring] for r in rows], SCHEMA)
    for hops in (8, 3, 1):
        got = Counter((r.trace_id, r.span_id, r.producer_trace) for r in resolve_producer_link(df, hops).collect())
        assert got == sum((plain(rows, hops) for rows in [*traces, ring]), Counter())


def test_repeats_and_nulls(spark):
    rows = [("t", "p", None, "CLIENT", 0, None), ("t", "a", "p", "CONSUMER", 1, "m"), ("t", "a", "p", "CONSUMER", 1, "m"), ("t", "b", "p", "CLIENT", 2, None), ("t", "c", "b", "CLIENT", 3, None)]
    rows += [(None, *r[1:]) for r in rows[:5]] + [("u", None, *r[2:]) for r in rows[:5]]
    got = [(r.trace_id, r.span_id, r.producer_trace) for r in resolve_producer_link(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == 15 and sorted(r[1:] for r in got if r[2]) == [("b", "m"), ("c", "m")]
    assert resolve_producer_link(spark.createDataFrame([], SCHEMA)).count() == 0


def test_links_are_found_in_one_pass(spark):
    path = f"{spark.conf.get('spark.checkpoint.dir')}/links"
    spark.createDataFrame(list(rows_of(random.Random(6), "t", 30)), SCHEMA).write.mode("overwrite").parquet(path)
    assert passes(resolve_producer_link(spark.read.parquet(path).repartition(3, "trace_id"))) == (1, 1)
