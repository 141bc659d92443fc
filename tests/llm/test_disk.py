from pathlib import Path

from pyspark.sql import functions as F

from wattspan.llm.exact_dedup import compact, flush_runs


def test_bloom_filters_take_the_room_of_their_rows(spark):
    digests = spark.range(200).select("id", F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    runs = flush_runs(digests, 8)
    level = compact(runs)
    size = lambda t: sum(p.stat().st_size for p in Path(t.scratch_path.removeprefix("file://")).rglob("*.parquet"))
    assert size(level) < 300_000 and level.count() == 200
