import random
from itertools import groupby

from tests.spans import BASE
from tests.test_sources import attrs, put
from wattspan.operators.stitch import stitch_split_spans
from wattspan.sources import readers

SCHEMA = "trace_id string, span_id string, parent_span_id string, ts_ms long, target string, orphan boolean, sql_system boolean"


def above(by_id, row):
    """Ids of at most eight ancestors, nearest first."""
    out, at = [], row
    while len(out) < 8 and at[2] in by_id and at[2] != row[1] and at[2] != at[1]:
        at = by_id[at[2]]
        out.append(at[1])
    return out


def plain(rows):
    """The rules one after the other, over one trace."""
    by_id = {r[1]: r for r in rows}
    lines = {r[1]: above(by_id, r) for r in rows}
    donors = [r for r in rows if r[4]]
    admitted = [r for r in rows if r[5] and not r[4] and (r[6] or any(d[2] == r[2] for d in donors if d[2]))]
    ids = {r[1] for r in admitted}
    carrier_of = {r[1]: [x for x in lines[r[1]] if x in ids] for r in admitted}
    used, given = set(), {}
    for r in sorted((r for r in admitted if not carrier_of[r[1]]), key=lambda r: (r[3], r[1])):
        siblings = sorted((d for d in donors if d[2] and d[2] == r[2] and d[3] <= r[3]), key=lambda d: (-d[3], d[1]))[:8]
        related = [d for d in donors if d[1] in lines[r[1]] or r[1] in lines[d[1]]]
        before = [d for d in siblings + related if d[3] <= r[3]]
        free = [d for d in before if d[1] not in used]
        pick = min(free or before or related, key=lambda d: (abs(d[3] - r[3]), d[1]), default=None)
        if pick:
            used.add(pick[1])
            given[r[1]] = pick[4]
    gone = used | {x for x, c in carrier_of.items() if c and c[-1] in given}
    return {(r[0], r[1], given.get(r[1], r[4])) for r in rows if r[1] not in gone}


def check(spark, rows, **sizes):
    rows.sort(key=lambda r: r[0])
    want = set().union(*(plain(list(g)) for _, g in groupby(rows, key=lambda r: r[0])))
    got = stitch_split_spans(spark.createDataFrame(rows, SCHEMA), **sizes).collect()
    assert len(got) == len(want)
    assert {(r.trace_id, r.span_id, r.target) for r in got} == want


def rows_of(trace, rng, n, parent):
    for k in range(n):
        kind = rng.random()
        yield (trace, f"{trace}-{rng.randrange(100)}-{k}", parent(k), rng.randrange(n * 2), f"q{k}" if kind < 0.45 else None, kind > 0.4, rng.random() < 0.7)


def test_siblings_with_ties_and_look_back(spark):
    rng = random.Random(3)
    rows = [r for t in range(40) for r in rows_of(f"t{t}", rng, rng.choice([3, 10, 60]), lambda k: rng.choice(["p", "p", "o", None, ""]))]
    check(spark, rows)
    check(spark, rows, block_ms=7, block_donors=10)


def test_trees(spark):
    rng = random.Random(4)
    rows = []
    for t in range(60):
        made = list(rows_of(f"t{t}", rng, rng.choice([2, 8, 25]), lambda k: None))
        for k, r in enumerate(made):
            parent = made[rng.randrange(len(made) if t % 9 == 0 else k)][1] if k and rng.random() < 0.9 else rng.choice([None, "", "gone"])
            rows.append((*r[:2], parent, *r[3:]))
    check(spark, rows)


def test_one_parent_with_most_spans(spark):
    """Prepared in a batch and executed later, then one by one, then prepared once and executed often."""
    rows = [("t", f"a{k:05}", "p", k, f"q{k}", False, True) for k in range(2000)] + [("t", f"b{k:05}", "p", 3000 + k, None, True, True) for k in range(2000)]
    for k in range(3000):
        rows += [("t", f"c{k:05}", "p", 6000 + 2 * k, f"r{k}", False, True), ("t", f"d{k:05}", "p", 6001 + 2 * k, None, True, True)]
    rows += [("t", f"e{k:05}", "p", 20000 + k, None, True, True) for k in range(3000)]
    got = {r.span_id: r.target for r in stitch_split_spans(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[f"b{k:05}"] for k in range(9)] == [f"q{1999 - k}" for k in range(8)] + ["q1999"]
    assert all(got[f"d{k:05}"] == f"r{k}" and f"c{k:05}" not in got for k in range(3000))
    assert {got[f"e{k:05}"] for k in range(3000)} == {"r2999"}


def test_nulls_repeats_and_an_empty_table(spark):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    rows = []
    for name in ["", *names]:
        three = [(f"t{name}", "a", "p", 1, "q", False, True), (f"t{name}", "b", "p", 2, None, True, True), (f"t{name}", "c", "b", 3, None, True, False)]
        rows += [tuple(None if n == name else v for n, v in zip(names, r)) for r in three]
    rows += [r for r in rows if r[0] == "t"]
    got = [tuple(r)[:2] + (r.target,) for r in stitch_split_spans(spark.createDataFrame(rows, SCHEMA)).collect()]
    # c is no child of b's sibling group and has no system, so it is not admitted
    assert sorted(x for x in got if x[0] == "t") == [("t", "b", "q")] * 2 + [("t", "c", None)] * 2
    assert sum(x[0] is None for x in got) == 3 and sorted(x[1] for x in got if x[0] == "tts_ms") == ["a", "b", "c"]
    assert stitch_split_spans(spark.createDataFrame([], SCHEMA)).count() == 0


def test_layers_of_an_export(spark, tmp_path):
    """The outer layer names no system and is admitted by its sibling; the inner one goes with it."""
    ns = lambda ms: str((BASE + ms) * 1_000_000)
    one = lambda i, p, name, at, ms, **a: {"traceId": "t", "spanId": i, "parentSpanId": p, "name": name, "kind": 3, "startTimeUnixNano": ns(at), "endTimeUnixNano": ns(at + ms), "attributes": attrs(**a)}
    spans = [
        one("root", "", "GET /o", 0, 90, http__route="/o"), one("prep", "root", "Doctrine::prepare", 1, 0, db__query__text="SELECT a FROM b"), one("inner-prep", "prep", "PDO::prepare", 1, 0, db__system="mysql", db__query__text="SELECT a FROM b"),
        one("exec", "root", "Doctrine::execute", 2, 40), one("inner-exec", "exec", "PDOStatement::execute", 2, 39, db__system="mysql"),
        one("alone", "other", "execute batch", 50, 1), one("call", "root", "query service", 60, 1, http__request__method="GET"),
    ]
    doc = {"resourceSpans": [{"resource": {"attributes": attrs(service__name="shop")}, "scopeSpans": [{"scope": {"name": "agent"}, "spans": spans}]}]}
    out, stats = readers.convert(readers.raw_otlp_spans(spark, put(tmp_path / "o.json", doc)))
    (row,) = out.collect()
    assert (row.span_id, row.target, row.duration_us, row.operation) == ("exec", "SELECT a FROM b", 40_000, "SELECT")
    assert stats.first().merged_db_span == 3
