"""Line deduplication by winnowing, in DataFrame operations alone.

* Every document's lines are hashed; in each window of ``run`` lines the smallest hash is selected. Two equal runs select
  equal fingerprints, so a fingerprint of one place only rules out its runs.
* Places of fingerprints that stand in several places are joined with the runs around them.
* A run of ``run`` lines with an earlier place is repeated. Neighbouring repeated runs are extended both ways into the
  longest repeated stretch, which is deleted; the first place stays.

Only a run's first place goes back to its document, so frequent runs are never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattspan.llm.common import join_by_key, materialise

_LAST = (1 << 63) - 1


def _placed_runs(docs: DataFrame, run: int) -> DataFrame:
    """doc, at, two hashes of the run of lines that starts there, the run's fingerprint and where it stands. Runs of blank lines don't count."""
    lines = docs.select("doc", F.split("text", "\n").alias("lines")).filter(F.size("lines") >= run)
    hashed = lines.select("doc", F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("h"), F.hash(x).alias("c"), x.rlike("[^ \\t\\r]").alias("full"))).alias("l"))
    part = lambda p, name: [F.get("l", p + k)[name] for k in range(run)]
    least, greatest = (F.least, F.greatest) if run > 1 else (lambda x: x, lambda x: x)
    whole = lambda p: F.struct(
        F.xxhash64(*part(p, "h")).alias("h"), F.hash(*part(p, "c")).alias("c"), least(*part(p, "h")).alias("print"),
        (p + F.array_position(F.array(*part(p, "h")), least(*part(p, "h"))).cast("int") - 1).alias("place"), greatest(*part(p, "full")).alias("full"),
    )
    runs = hashed.select("doc", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("l") - run), whole)).alias("at", "r"))
    return runs.filter("r.full").select("doc", "at", "r.h", "r.c", "r.print", "r.place")


def repeated_stretches(docs: DataFrame, run: int = 2) -> DataFrame:
    """doc and its repeated stretches of lines, as sorted (start, end) pairs; docs: doc (ordered, unique), text."""
    runs = materialise(_placed_runs(docs, run), "runs")
    prints = runs.groupBy("print").agg(F.count(F.lit(1)).alias("rows"), F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min("place").alias("early"), F.max("place").alias("late"))
    several = prints.filter("lo < hi or early < late").select("print", "rows")
    live = materialise(join_by_key(runs, several, ["print"], "rows", runs.count()).select("doc", "at", "h", "c"), "live")
    own = live.groupBy("h", "c", "doc").agg(F.min("at").alias("at"))
    first = own.groupBy("h", "c").agg(F.min("doc").alias("doc"), F.min_by("at", "doc").alias("at")).select("doc", "at")
    gone = live.select("doc", "at").join(first, ["doc", "at"], "left_anti")
    in_order = Window.partitionBy("doc").orderBy("at")
    opens = F.coalesce((F.col("at") > F.lag("at").over(in_order) + run).cast("int"), F.lit(1))
    stretch = gone.withColumn("opens", opens).withColumn("n", F.sum("opens").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    stretch = stretch.groupBy("doc", "n").agg(F.struct(F.min("at").alias("start"), (F.max("at") + run).alias("end")).alias("s"))
    return stretch.groupBy("doc").agg(F.array_sort(F.collect_list("s")).alias("stretches"))


def dedup_lines(docs: DataFrame, run: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_lines, n_removed, text (without the repeated lines), stretches.

    Lines are what stands between line feeds. A line goes if it lies in a run of ``run`` consecutive lines, not all blank,
    that starts earlier too: in a row of a smaller id, or earlier in the same row. Runs are judged on the input. A null text
    counts as one empty line and stays null; rows that repeat id and text are one document and get equal rows; of rows that
    share an id only, a hash of the text gives the order; null ids come last. An empty table gives no rows; other columns
    are not read.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.col(text_col).alias("raw"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("x", F.xxhash64("text"))
    numbered = materialise(rows.select("id", "x").distinct().orderBy("id", "x").withColumn("doc", F.monotonically_increasing_id()), "numbered")
    texts = rows.join(numbered.hint("shuffle_hash"), ["id", "x"])
    stretches = repeated_stretches(texts.select("doc", "text"), run)
    known = materialise(numbered.join(stretches, "doc", "left").select("id", "x", "stretches"), "stretches")
    out = rows.join(known.hint("shuffle_hash"), ["id", "x"]).withColumn("lines", F.split("text", "\n"))
    # what lies before, between and after the stretches
    starts = F.concat(F.array(F.lit(0)), F.transform("stretches", lambda s: s["end"]))
    ends = F.concat(F.transform("stretches", lambda s: s["start"]), F.array(F.size("lines")))
    kept = F.array_join(F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice("lines", a + 1, b - a))), "\n")
    removed = F.aggregate("stretches", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    none = F.col("stretches").isNull()
    return out.select(
        F.nullif("id", F.lit(_LAST)).alias("doc_id"), F.size("lines").cast("long").alias("n_lines"), F.when(none, 0).otherwise(removed).cast("long").alias("n_removed"),
        F.when(none, F.col("raw")).otherwise(kept).alias("text"), F.coalesce("stretches", F.array().cast("array<struct<start:int,end:int>>")).alias("stretches"),
    )
