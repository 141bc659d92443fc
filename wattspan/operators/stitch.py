"""Queries that instrumentation splits: a span with the statement (donor) and an execute span with the duration (orphan) become one.

An orphan below another orphan defers to the outermost one. The others, carriers, by start, take the statement of a related
donor: a sibling that starts no later, an ancestor or a descendant. A donor that started no later goes before one that started
later, then an unused one, then the latest, then the smallest id. Donors that gave their statement go, as do orphans whose
carrier has one.

Siblings alone are matched like brackets: a carrier takes the unused donor that was pushed last. So a donor's and a carrier's
depth tell who belongs together, and depths are running sums, which are scanned in two levels, within seconds and over them: a
parent with very many children is spread over its seconds. Only sibling groups with a related ancestor or descendant are dealt
one after the other, a trace a task, as a choice there depends on the choices in other groups.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattspan.operators.ingest import MAX_HOPS, ancestors
from wattspan.sources.shared import written

#: Fixed value: how many donors before a carrier may be taken unused.
LOOKBACK = 8
#: Milliseconds of a block of the scan over siblings.
BLOCK_MS = 1000
#: Donors of a parent whose carriers are matched together.
BLOCK_DONORS = 1000

_ID = ["trace_id", "span_id"]


def stitch_parts(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Donors (with gone) and admitted orphans of spans: trace_id, span_id, parent, ts_ms, target.

    Without ``sql_system`` among the columns all orphans are admitted; with it, one whose own system is no SQL system only
    if a donor has the same parent. Spans without ids or time take no part.
    """
    has = lambda c, default: F.coalesce(c, F.lit(default)) if c in spans.columns else F.lit(default)
    filled = F.coalesce(F.col("target") != "", F.lit(False))
    own = spans.filter("trace_id <> '' and span_id <> '' and ts_ms is not null").select(
        *_ID, F.nullif("parent_span_id", F.lit("")).alias("parent"), "ts_ms", "target", filled.alias("donor"), F.coalesce("orphan", F.lit(False)).alias("orphan"), has("sql_system", True).alias("sql"), has("suppressed", False).alias("gone")
    )
    donors = own.filter("donor").drop("donor", "orphan", "sql")
    orphans = own.filter("orphan and not donor")
    if "sql_system" in spans.columns:
        parents = donors.filter("parent is not null").select("trace_id", "parent").distinct()
        orphans = orphans.filter("sql").unionByName(orphans.filter("not sql").join(parents, ["trace_id", "parent"], "left_semi"))
    return donors, orphans.select(*_ID, "parent", "ts_ms")


def related_pairs(members: DataFrame, walk: DataFrame) -> DataFrame:
    """trace_id, span_id, hop, ancestor of members below members, with is_donor and above_donor; never both donors."""
    own = members.select(*_ID, "is_donor")
    up = members.select("trace_id", F.col("span_id").alias("ancestor"), F.col("is_donor").alias("above_donor"))
    return walk.select(*_ID, "hop", "ancestor").join(own, _ID).join(up, ["trace_id", "ancestor"]).filter("not (is_donor and above_donor)")


def deferred_orphans(pairs: DataFrame) -> DataFrame:
    """trace_id, span_id and carrier, its outermost ancestor that is an orphan, of the orphans that have one."""
    return pairs.filter("not is_donor and not above_donor").groupBy(*_ID).agg(F.max_by("ancestor", "hop").alias("carrier"))


def orphan_carriers(spans: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """trace_id, span_id and carrier (null if it carries itself) of the admitted orphans of ``stitch_decisions``' spans."""
    orphans = stitch_parts(spans)[1]
    pairs = related_pairs(orphans.withColumn("is_donor", F.lit(False)), ancestors(spans.select("trace_id", "span_id", "parent_span_id"), max_hops))
    return orphans.select(*_ID).join(deferred_orphans(pairs), _ID, "left")


def match_siblings(members: DataFrame, block_ms: int = BLOCK_MS, block_donors: int = BLOCK_DONORS) -> DataFrame:
    """trace_id, span_id and donor of the carriers that have a donor before them. members: trace_id, parent, span_id, ts_ms, is_donor.

    The depth of a donor is how many unused donors there are with it, that of a carrier how many there are before it. A
    carrier's donor is the last one of its own depth, if it is among the last eight, else the last of all, used again. Of
    donors that start together the smallest id is the last.
    """
    keys = ["trace_id", "parent"]
    d = F.col("is_donor")
    rows = members.withColumns({"block": F.floor(F.col("ts_ms") / block_ms), "_down": F.when(d, F.col("span_id")), "_up": F.when(~d, F.col("span_id"))})
    order = [F.col("ts_ms"), F.when(d, 0).otherwise(1), F.desc("_down"), F.col("_up")]
    within = Window.partitionBy(*keys, "block").orderBy(*order)
    upto, before = within.rowsBetween(Window.unboundedPreceding, 0), within.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"s": F.sum(F.when(d, 1).otherwise(-1)).over(upto), "k": F.sum(F.when(d, 1).otherwise(0)).over(upto), "latest": F.last("_down", True).over(upto)})
    rows = rows.withColumn("low", F.min("s").over(before))
    tops = rows.groupBy(*keys, "block").agg(F.sum(F.when(d, 1).otherwise(-1)).alias("s"), F.count_if(d).alias("k"), F.min("s").alias("low"), F.min_by("_down", F.when(d, F.struct(-F.col("ts_ms"), F.col("_down")))).alias("latest"))
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumns({"s0": F.coalesce(F.sum("s").over(earlier), F.lit(0)), "k0": F.coalesce(F.sum("k").over(earlier), F.lit(0)), "latest0": F.last("latest", True).over(earlier)})
    tops = tops.withColumn("low0", F.least(F.lit(0), F.min(F.col("s0") + F.col("low")).over(earlier)))
    at = rows.join(tops.select(*keys, "block", "s0", "k0", "latest0", "low0"), [*keys, "block"])
    floor = F.least("low0", F.col("s0") + F.col("low"))
    depth = F.col("s0") + F.col("s") + F.when(d, 0).otherwise(1) - floor
    at = at.select(*keys, "span_id", "is_donor", (F.col("k0") + F.col("k")).alias("k"), depth.alias("depth"), F.coalesce("latest", "latest0").alias("latest"))
    # a donor stands in the block of its number and, for the carriers after the next seven donors, in the one that they reach
    number = lambda k: F.floor(k / block_donors)
    givers = at.filter("is_donor").withColumn("part", F.explode(F.array_distinct(F.array(number(F.col("k")), number(F.col("k") + LOOKBACK - 1)))))
    takers = at.filter("not is_donor and depth > 0").withColumn("part", number(F.col("k")))
    w = Window.partitionBy(*keys, "part", "depth").orderBy("k", F.desc("is_donor"))
    free = F.last(F.when(d, F.struct("k", "span_id")), True).over(w)
    found = givers.unionByName(takers).withColumn("free", free).filter("not is_donor and free.k > k - 8").select(*_ID, F.col("free.span_id").alias("_free"))
    used = at.filter("not is_donor and latest is not null").select(*_ID, "latest").join(found, _ID, "left")
    return used.select(*_ID, F.coalesce("_free", "latest").alias("donor"))


def _in_turn(pdf):
    """One trace: carriers by start and id, each with its siblings and related donors."""
    import pandas as pd

    rows = pdf.to_dict("records")
    starts = {r["span_id"]: r["ts_ms"] for r in rows if r["is_donor"]}
    families: dict = {}
    for r in rows:
        if r["is_donor"] and r["parent"]:
            families.setdefault(r["parent"], []).append(r["span_id"])
    for ids in families.values():
        ids.sort(reverse=True)
        ids.sort(key=starts.get)
    times = {parent: [starts[x] for x in ids] for parent, ids in families.items()}
    used: set = set()
    out = []
    for r in sorted((r for r in rows if not r["is_donor"]), key=lambda r: (r["ts_ms"], r["span_id"])):
        ids, ts = families.get(r["parent"], []), r["ts_ms"]
        at = bisect_right(times[r["parent"]], ts) if ids else 0
        near = ids[max(at - LOOKBACK, 0) : at] + [x for x in (r["related"] if r["related"] is not None else ()) if x in starts]
        if near:
            best = min(near, key=lambda x: (starts[x] > ts, starts[x] <= ts and x in used, abs(ts - starts[x]), x))
            used.add(best)
            out.append((r["trace_id"], r["span_id"], best))
    return pd.DataFrame(out, columns=["trace_id", "span_id", "donor"])


def stitch_decisions(spans: DataFrame, walk: DataFrame | None = None, max_hops: int = MAX_HOPS, block_ms: int = BLOCK_MS, block_donors: int = BLOCK_DONORS) -> DataFrame:
    """trace_id, span_id and statement of each span that takes one; statement is null where the span goes.

    spans: trace_id, span_id, parent_span_id, ts_ms, target, orphan, and sql_system and suppressed if known; suppressed donors
    admit siblings but give nothing. Ids are taken to be unique within a trace; of repeated ones one decision holds for all.
    ``walk`` is that of ``ancestors`` over at least these spans. Donors and orphans of traces that have an orphan, and their
    pairs up the tree, are written to the shared folder once, when this is called.
    """
    donors, orphans = stitch_parts(spans)
    nothing = F.lit(None).cast("string").alias("statement")
    whole = donors.withColumn("is_donor", F.lit(True)).unionByName(orphans.withColumns({"target": nothing, "gone": F.lit(False), "is_donor": F.lit(False)}))
    members = written(whole.join(orphans.select("trace_id").distinct(), "trace_id", "left_semi"), "stitch")
    if walk is None:
        asked = members.filter("not is_donor").select("trace_id").distinct()
        walk = ancestors(spans.select("trace_id", "span_id", "parent_span_id").join(asked, "trace_id", "left_semi"), max_hops)
    pairs = written(related_pairs(members.filter("not gone"), walk), "stitch-pairs")
    deferred = deferred_orphans(pairs)
    donors = members.filter("is_donor")
    members = members.filter("not gone").select(*_ID, "parent", "ts_ms", "is_donor").join(deferred.select(*_ID), _ID, "left_anti")
    mixed = pairs.filter("is_donor <> above_donor")
    related = mixed.select("trace_id", F.when(F.col("is_donor"), F.col("ancestor")).otherwise(F.col("span_id")).alias("carrier"), F.when(F.col("is_donor"), F.col("span_id")).otherwise(F.col("ancestor")).alias("donor")).distinct()
    related = related.join(deferred.select("trace_id", F.col("span_id").alias("carrier")), ["trace_id", "carrier"], "left_anti")
    # sibling groups without a related ancestor or descendant do not depend on any other
    ends = related.select("trace_id", F.explode(F.array("carrier", "donor")).alias("span_id")).distinct()
    touched = members.join(ends, _ID, "left_semi").select("trace_id", F.coalesce("parent", F.lit("")).alias("_parent")).distinct()
    keyed = members.withColumn("_parent", F.coalesce("parent", F.lit("")))
    plain = keyed.filter("parent is not null").join(touched, ["trace_id", "_parent"], "left_anti").drop("_parent")
    lists = related.groupBy("trace_id", F.col("carrier").alias("span_id")).agg(F.collect_list("donor").alias("related"))
    turn = keyed.join(touched, ["trace_id", "_parent"], "left_semi").drop("_parent").join(lists, _ID, "left")
    chosen = match_siblings(plain, block_ms, block_donors).unionByName(turn.groupBy("trace_id").applyInPandas(_in_turn, "trace_id string, span_id string, donor string"))
    taken = chosen.join(donors.select("trace_id", F.col("span_id").alias("donor"), F.col("target").alias("statement")), ["trace_id", "donor"])
    served = taken.select("trace_id", F.col("span_id").alias("carrier"))
    goes = [taken.select("trace_id", F.col("donor").alias("span_id"), nothing), whole.filter("gone").select(*_ID, nothing), deferred.join(served, ["trace_id", "carrier"], "left_semi").select(*_ID, nothing)]
    decided = taken.select(*_ID, "statement")
    for part in goes:
        decided = decided.unionByName(part)
    return decided.groupBy(*_ID).agg(F.max("statement").alias("statement"))


def stitch_split_spans(spans: DataFrame, walk: DataFrame | None = None, **sizes: int) -> DataFrame:
    """Statement spans and execute spans of one query become one, as ``stitch_decisions`` says; other spans stay as they are."""
    columns = ["trace_id", "span_id", "parent_span_id", "ts_ms", "target", "orphan"]
    decided = stitch_decisions(spans, walk, **sizes).withColumn("_decided", F.lit(True))
    out = spans.select(*columns).join(decided, _ID, "left").filter("_decided is null or statement is not null")
    return out.withColumn("target", F.coalesce("statement", "target")).select(*columns)
