import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from wattspan.llm.sentencepiece import PieceModel, decode_ids, encode_digests, encode_texts

PATH = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = "abSTdrevlm' '\"''.,0129\n\té ßÉ   日本語한국тест▁\x1bć😀aaaa----====    "


@pytest.fixture(scope="module")
def model():
    return PieceModel(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_random_texts_equal_the_library(model, library):
    rng = random.Random(5)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 90))) for _ in range(2000)]
    texts += ["", " ", "  ", "\n", "a" * 5000, "the quick brown fox " * 200, "=" * 300, "日" * 400]
    for text, ids, back in zip(texts, (got := model.encode(texts)), model.decode(got), strict=True):
        assert ids.tolist() == library.encode(text)
        assert back == text.replace("▁", " ")


def test_unigram_recurrence_finds_the_best_sum(library):
    model = PieceModel(PATH, model_type=1)
    rng = random.Random(7)
    for _ in range(60):
        text = "".join(rng.choice("thequickas▁in") for _ in range(rng.randint(1, 12)))
        best = [0.0] + [-1e18] * len(text)
        for i in range(1, len(text) + 1):
            for j in range(i):
                if text[j:i] in model.usable:
                    best[i] = max(best[i], best[j] + model.scores[model.id[text[j:i]]])
        ids = model.encode_segments([text])[0]
        assert sum(model.scores[i] for i in ids) == pytest.approx(best[-1])
        assert model._one(text) == ids or sum(model.scores[i] for i in model._one(text)) == pytest.approx(best[-1])


def test_documents_come_back(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    encoded = encode_texts(docs)
    for r in encoded.collect():
        assert r.ids == library.encode(texts[r.doc_id])
    assert {r.doc_id: r.text for r in decode_ids(encoded).collect()} == texts
    assert all(r.round_trip for r in encode_digests(docs).collect())


def test_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "a", 3), (1, "a", 3)], "doc_id long, text string, ids int")
    rows = encode_texts(docs).collect()
    assert sorted(len(r.ids) for r in rows) == [0, 0, 1, 1]
    assert [r.text for r in decode_ids(encode_texts(docs)).orderBy("text").collect()] == ["", "", "a", "a"]
    assert encode_digests(docs.limit(0)).count() == 0
    assert np.array_equal(PieceModel(PATH).encode([None])[0], [])
