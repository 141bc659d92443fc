import pyarrow as pa
from public_tokenizers import path
from pyspark.sql import functions as F

from wattspan.llm import near_dedup, tokens
from wattspan.llm.common import batch_blocks
from wattspan.llm.toxicity import ToxicityModel, keep_clean

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def _bytes(batches):
    for b in batches:
        yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "size": [b.nbytes]})


def test_texts_reach_workers_in_small_batches(spark):
    docs = spark.range(0, 40, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 100_000).alias("text"))
    spark.conf.set(SETTING, "64m")
    assert keep_clean(docs, ToxicityModel({}, {}, weights=[0.0] * 7 + [-5.0])).count() == 40
    got = docs.mapInArrow(_bytes, "rows long, size long").collect()
    assert sum(r.rows for r in got) == 40 and max(r.size for r in got) < 5_000_000


def test_a_smaller_batch_of_the_session_stays(spark):
    spark.conf.set(SETTING, "1m")
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert keep_clean(docs, ToxicityModel({}, {}, weights=[0.0] * 7 + [-5.0])).count() == 1
    assert spark.conf.get(SETTING) == "1m"
    spark.conf.unset(SETTING)


def test_a_vocabulary_goes_when_texts_are_read_for_something_else():
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["a b c"], "x": [1], "c": pa.array([1], pa.int32())})
    vocabulary = tokens.shared(path("word_bpe_49k.json"))
    assert list(batch_blocks([batch], "text", keep=tokens.shared)) and tokens.shared(path("word_bpe_49k.json")) is vocabulary
    assert list(near_dedup._features([batch]))
    assert tokens.shared.cache_info().currsize == 0
