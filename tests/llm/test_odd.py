"""Every registered operator query and every pipeline stage over the odd rows."""

import hashlib
import zlib

import numpy as np
import pytest

from tests.llm import odd
from tests.llm.brute import near_components, repeated_words
from wattspan.llm import queries
from wattspan.llm.exact_dedup import keep_one
from wattspan.llm.near_dedup import keep_representatives
from wattspan.llm.secrets import redact
from wattspan.llm.segments import Words, hash_ranges, hash_runs


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    odd.table(spark).write.parquet(f"{path}/documents.parquet")
    rows = [(d, 1, int(d % 2)) for d, _ in odd.TEXTS if d is not None] + [(None, 0, 1), (3, None, None)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(20, [1.0, 0.0]), (21, [0.5, 0.5]), (None, [1.0, 1.0]), (40, None), (22, [0.0, 0.0])], "vec_id long, embedding array<double>").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", sorted(n for n in queries.queries() if n not in ("op4_nearest_neighbours", "op7_packing", "op11_hard_negatives", "op12_vector_codes", "pipeline")))
def test_queries_give_a_row_for_each_row(spark, folder, name):
    got = queries.queries()[name](spark, folder)
    rows = got.collect()
    assert sorted(map(repr, (r.doc_id for r in rows))) == sorted(map(repr, (d for d, _ in odd.TEXTS)))
    if "held_out" in got.columns:
        assert all(r.held_out is not None for r in rows) and not any(r.held_out for r in rows if r.doc_id is None)


def test_pieces_of_odd_rows(spark, folder):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    want = {d: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in odd.TEXTS if d not in (None, 1)}
    pieces = queries.op7_packing(spark, folder).collect()
    for d, ids in want.items():
        own = sorted((r for r in pieces if r.doc_id == d), key=lambda r: r.start)
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist() and {r.doc_tokens for r in own} == {len(ids)}
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own), d


def test_structured_texts_are_told_apart(spark, folder):
    docs = [(d, t) for d, t in odd.TEXTS if d not in (None, 1)]
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op9_near_dedup(spark, folder).collect() if r.doc_id not in (None, 1)}
    assert near == near_components(docs, 85)
    gone = repeated_words(docs)
    for r in queries.op5_substring_dedup(spark, folder).collect():
        if r.doc_id in gone:
            words = (dict(docs)[r.doc_id] or "").encode().split()
            kept = b" ".join(w for w, g in zip(words, gone[r.doc_id], strict=True) if not g)
            assert (r.n_removed, r.kept_sha256) == (sum(gone[r.doc_id]), hashlib.sha256(kept).hexdigest()), r.doc_id


def test_hashes_of_structured_bytes_and_runs():
    texts = [odd.thue_morse(n, *ab) for n in (64, 1024, 1032, 4096) for ab in ("ab", "ba")]
    words = Words([*texts, *(" ".join(t) for t in texts)], fold=False)
    distinct = {bytes(words.data[s:e]) for s, e in zip(words.starts, words.ends)}
    for seed in hash_ranges(words.data, words.starts, words.ends, 2):
        assert len(set(seed.tolist())) == len(distinct)
    assert len(set(words.keys()[0].tolist())) == len(texts) * 2
    values = hash_ranges(words.data, words.starts, words.ends)[0]
    for n in (1, 4, 5, 20):
        runs = hash_runs(values, n)
        assert len(runs) == len(values) - n + 1
        assert len(set(runs.tolist())) == len({tuple(values[i : i + n].tolist()) for i in range(len(runs))})


def test_stages_bear_odd_rows(spark):
    docs = odd.table(spark)
    for stage in (keep_one, keep_representatives, redact):
        assert stage(docs.limit(0)).count() == 0
        out = stage(docs)
        assert out.columns == docs.columns and out.schema == docs.schema
    safe = {(r.doc_id, r.text) for r in redact(docs).collect()}
    assert not any(v in (t or "") for _, t in safe for v in ("abc123def9", "aaa111bbb2", "zzz999yyy8"))
    assert len(safe) == len({(d, t) for d, t in odd.TEXTS})


def test_many_matches_in_one_text(spark):
    from wattspan.llm.secrets import digest, scan_secrets

    text = "".join(f"token=value{i:06d} " for i in range(3_000))
    got = digest(scan_secrets(odd.table(spark, [(1, text)]))).first()
    want = ",".join(f"assign:{i * 18}:{i * 18 + 17}" for i in range(3_000))
    assert got.n_assign == 3_000 and got.base_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_group_of_near_copies_around_the_threshold(spark):
    """More texts than a hot key has, some linked to the common base and most not."""
    import random

    rng = random.Random(5)
    base = [f"w{rng.randrange(200)}" for _ in range(110)]
    docs = []
    for i in range(700):
        copy = list(base)
        for k in range(rng.choice([0, 1, 1, 2, 3, 4, 5, 6])):
            at = rng.randrange(len(copy))
            copy[at : at + 1] = rng.choice([[f"n{i}x{k}"], [], [copy[at], f"m{rng.randrange(4)}"]])
        docs.append((i, " ".join(copy)))
    from wattspan.llm.near_dedup import near_duplicates

    for percent in (80, 85):
        want = near_components(docs, percent)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(odd.table(spark, docs), percent).collect()}
        assert got == want
        assert 10 < len({c for _, c in want.values()}) < 600
