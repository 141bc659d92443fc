import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wattspan.llm.language_id import fit_language_id, identify_languages
from wattspan.llm.nearest import nearest_neighbours
from wattspan.llm.packing import Packer, pack_documents
from wattspan.llm.tokens import WordBpe
from wattspan.llm.toxicity import FEATURES, LexiconAutomaton, ToxicityModel, fit_toxicity, keep_clean, score_toxicity, window_features

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("word_bpe_49k.json")


def one_edit(a, b):
    """Whether one insertion, deletion or substitution after the first letter turns a into b."""
    if a[:1] != b[:1] or abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def test_automaton_equals_plain_edit_distance():
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    terms = {word(rng.randrange(3, 9)): float(i + 1) for i in range(40)}
    automaton = LexiconAutomaton(terms, {}, max_states=50)
    for _ in range(3000):
        w = word(rng.randrange(1, 10))
        got = automaton.match(w)
        if w in terms:
            assert got == (terms[w], 0)
        else:
            near = [v for t, v in terms.items() if len(t) >= 5 and one_edit(t, w)]
            assert got == ((max(near), 1) if near else None), w


def test_quotations_are_no_abuse():
    automaton = LexiconAutomaton({"moron": 5.0}, {"lowei": 4.0})
    plain, quoted = (window_features(t, automaton) for t in ("you are a moron here", 'he wrote "you moron" there'))
    hits, away = FEATURES.index("hits"), FEATURES.index("quoted")
    assert plain[hits] > 3 * quoted[hits] and quoted[away] > plain[away]
    assert window_features("mor0n loweitext", automaton)[hits] > plain[hits]
    assert window_features(None, automaton) == window_features("", automaton) == [0.0] * len(FEATURES)


def test_toxicity_learns_and_keeps_clean_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_toxicity(docs, labels, learn=F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    rows = score_toxicity(docs, model).join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.93
    assert sum(r.predicted and not r.toxic for r in rows) <= 3
    left = keep_clean(docs, model)
    assert left.columns == docs.columns and left.count() == sum(r.predicted == 0 for r in score_toxicity(docs, model).collect())
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "idiot " * 30_000)], "doc_id long, text string")
    assert [r.predicted for r in score_toxicity(odd, model).orderBy("score").collect()][:3] == [0, 0, 0]
    none = ToxicityModel({}, {}, weights=[0.0] * len(FEATURES) + [-5.0])
    assert fit_toxicity(docs, labels.limit(0)).weights == none.weights and score_toxicity(docs.limit(0), none).count() == 0


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = fit_language_id(docs, learn=~held, sample=600)
    rows = identify_languages(docs.filter(held), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)
    odd = spark.createDataFrame([(1, None, 1), (1, "", 1), (None, "123 !", 1), (2, "the " * 40_000, 1)], "doc_id long, text string, lang_pred int")
    assert sorted(r.lang_pred for r in identify_languages(odd, model).collect()) == ["en", "und", "und", "und"]
    assert fit_language_id(docs.limit(0)).languages == [] and identify_languages(odd, fit_language_id(docs.limit(0))).filter("lang_pred <> 'und'").count() == 0


def test_ids_equal_the_tokenizer():
    bpe, library = WordBpe(PATH, cache=500), Tokenizer.from_file(PATH)
    rng = random.Random(1)
    alphabet = "abSTdrevlm' '\"''.,0129\n\té ßÉ²ªµ<|>x Σσ日 \x1c"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["<|endoftext|> x", "İ", "it's we'll 'S"]
    for text, ids in zip(texts, bpe.ids(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("max_open", [4096, 20])
def test_packed_windows_hold_every_id_once(max_open):
    rng = random.Random(2)
    packer, docs, rows = Packer(64, max_open=max_open), {}, []
    for d in range(400):
        docs[d] = np.arange(rng.choice([1, 5, 30, 63, 64, 65, 200]), dtype=np.int32) + d
        rows += packer.add(d, docs[d])
    rows += packer.consolidate(last=True)
    covered = {d: np.zeros(len(x), int) for d, x in docs.items()}
    fill: dict = {}
    for d, start, length, crc, total, sequence, offset in rows:
        assert total == len(docs[d]) and crc == zlib.crc32(docs[d][start : start + length].astype("<u4").tobytes())
        covered[d][start : start + length] += 1
        fill.setdefault(sequence, []).append((offset, length))
    assert all((x == 1).all() for x in covered.values())
    for pieces in fill.values():
        pieces.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and pieces[0][0] == 0
        total = sum(n for _, n in pieces)
        assert total == 64 or total & (total - 1) == 0  # no padding


def test_packing_of_odd_rows(spark):
    odd = spark.createDataFrame([(None, None, 1), (1, "", 1), (1, "", 1), (2, "word " * 30_000, 1)], "doc_id long, text string, length int")
    rows = pack_documents(odd).collect()
    assert sum(r.length for r in rows) == 1 + 1 + 1 + 30_001 and pack_documents(odd.limit(0)).count() == 0


def test_neighbours_reach_the_recall(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    local = vectors.orderBy("vec_id").collect()
    ids, matrix = np.array([r.vec_id for r in local]), np.array([r.embedding for r in local], float)
    found: dict = {}
    for r in nearest_neighbours(vectors, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hits = total = 0
    for q, own in found.items():
        score = matrix @ matrix[ids == q][0]
        score[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -score))[:20]].tolist())
        hits, total = hits + len(best & {v for v, _ in own.values()}), total + 20
        ordered = [own[k] for k in sorted(own)]
        assert sorted(own) == list(range(1, 21)) and ordered == sorted(ordered, key=lambda x: (-x[1], x[0]))
    assert hits >= 0.9 * total


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, []), (None, [1.0, 1.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0])]
    vectors = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = [(r.query_id, r["rank"], r.vec_id) for r in nearest_neighbours(vectors, F.col("vec_id") % 20 == 0, k=2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 9), (0, 2, 9), (20, 1, 0), (20, 2, 9)]
    assert nearest_neighbours(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0
