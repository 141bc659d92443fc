import corpus_pipeline
from tests.llm.brute import fold, near_components
from wattspan.llm.common import materialise

SF = "/root/testdata/sf0.001"


def test_stages_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, SF), name)
        kept[name] = {r.doc_id: getattr(r, "text", None) for r in out.collect()}
        if name != "packing":
            assert out.columns == docs.columns
            docs = out
    texts = kept["toxicity"]
    last: dict = {}
    for d, t in texts.items():
        last[fold(t)] = max(d, last.get(fold(t), d))
    assert set(kept["exact_dedup"]) == set(last.values())
    parts = near_components(list(kept["exact_dedup"].items()), 80)
    assert set(kept["near_dedup"]) == {d for d, (_, c) in parts.items() if d == c}
    assert set(kept["secret_scans"]) == set(kept["near_dedup"]) == set(kept["packing"])


def test_registered_query_runs(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
