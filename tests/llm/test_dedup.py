import hashlib
import random

import numpy as np
import pytest

from tests.llm.brute import fold, near_components, repeated_words
from wattspan.llm.exact_dedup import exact_duplicates, keep_one
from wattspan.llm.line_dedup import dedup_lines
from wattspan.llm.near_dedup import BITS, MAX_XOR, SAMPLES, keep_representatives, minhash, near_duplicates, odd_sketch
from wattspan.llm.substring_dedup import repeated_spans

#: Extra columns whose names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, digest string, run int, rep long, doc long, lines string"


def table(spark, docs):
    return spark.createDataFrame([(d, t, "en", "s", 0, 1, "x", 2, 3, 4, "l") for d, t in docs], SCHEMA)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    shared = [prose(rng, 30), prose(rng, 60)]
    docs = []
    for i in range(60):
        parts = [prose(rng, rng.randrange(0, 80))]
        if i % 3 == 0:
            parts.insert(rng.randrange(2), rng.choice(shared))
        docs.append(" ".join(parts))
    base = prose(rng, 150).split()
    for i in range(25):  # near copies of one text, some of them nearer than others
        copy = list(base)
        for _ in range(rng.randrange(0, 6)):
            copy[rng.randrange(len(copy))] = f"z{i}"
        docs.append(" ".join(copy))
    docs += ["a " * 90, "a b " * 50, "", " \t", None, "one two", "One TWO", "one  two", "É x", "é x", docs[3], docs[3], docs[0].upper(), "x" * 300_000, "\x1fkeep\x1fas one word"]
    rng.shuffle(docs)
    return [(i * 3, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_groups(spark, corpus, keep):
    groups: dict = {}
    for d, t in corpus:
        groups.setdefault(fold(t), []).append(d)
    got = {r.doc_id: r for r in exact_duplicates(table(spark, corpus), keep).collect()}
    assert len(got) == len(corpus)
    for d, t in corpus:
        own = groups[fold(t)]
        want = min(own) if keep == "smallest" else max(own)
        assert (got[d].keep_id, got[d].group_size, got[d].kept, got[d].text_sha256) == (want, len(own), d == want, hashlib.sha256(fold(t)).hexdigest())
    left = keep_one(table(spark, corpus), keep)
    assert left.columns == table(spark, corpus[:1]).columns
    assert {r.doc_id for r in left.collect()} == {d for d in got if got[d].kept}


@pytest.mark.parametrize("percent", [85, 80])
def test_near_components(spark, corpus, percent):
    want = near_components(corpus, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(table(spark, corpus), percent).collect()}
    assert got == want
    if percent == 80:
        assert {r.doc_id for r in keep_representatives(table(spark, corpus)).collect()} == {d for d, (_, c) in want.items() if c == d}


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for same in (0.95, 0.85, 0.5):
        a = rng.integers(-(1 << 62), 1 << 62, 1000)
        b = np.concatenate([a[: int(1000 * 2 * same / (1 + same))], rng.integers(-(1 << 62), 1 << 62, 1000)])[:1000]
        x = np.unpackbits((odd_sketch(minhash(a)) ^ odd_sketch(minhash(b))).view(np.uint8)).sum()
        j = 1 + BITS / 2 * np.log(1 - 2 * x / BITS) / (2 * SAMPLES)
        assert abs(j - same) < 0.12 and (x <= MAX_XOR) == (same > 0.6)


def test_repeated_words(spark, corpus):
    want = repeated_words(corpus)
    texts = dict(corpus)
    for r in repeated_spans(table(spark, corpus)).collect():
        words, gone = (texts[r.doc_id] or "").encode().split(), want[r.doc_id]
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(words), sum(gone), hashlib.sha256(kept).hexdigest()), r.doc_id
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and all(gone[k] for s in r.spans for k in range(s.start, s.end))


def plain_lines(docs, run):
    first, out = {}, {}
    for d, t in sorted(docs):
        lines = (t or "").split("\n")
        gone = [False] * len(lines)
        for i in range(len(lines) - run + 1):
            key = tuple(lines[i : i + run])
            if any(x.strip(" \t\r") for x in key) and first.setdefault(key, (d, i)) != (d, i):
                gone[i : i + run] = [True] * run
        out[d] = ("\n".join(x for x, g in zip(lines, gone, strict=True) if not g), sum(gone))
    return out


@pytest.mark.parametrize("run", [1, 2, 3])
def test_repeated_lines(spark, run):
    rng = random.Random(run)
    docs = [(i, "\n".join(rng.choice(["", "a", "b", "c", "long line", f"own {rng.randrange(40)}"]) for _ in range(rng.randrange(12)))) for i in range(50)]
    docs += [(100, None), (101, ""), (102, "a\na\na\na"), (103, "x\n" * 3000)]
    want = plain_lines(docs, run)
    for r in dedup_lines(table(spark, docs), run).collect():
        assert (r.text or "", r.n_removed) == want[r.doc_id]


def test_nulls_repeats_and_empty_tables(spark):
    odd = table(spark, [(None, None), (None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (1, "other text of one id"), (2, None)])
    none = odd.limit(0)
    for f in (exact_duplicates, near_duplicates, repeated_spans, dedup_lines, keep_one, keep_representatives):
        assert f(none).count() == 0
    for f in (exact_duplicates, near_duplicates, repeated_spans, dedup_lines):
        assert f(odd).count() == 6
    assert {(r.doc_id, r.component_id) for r in near_duplicates(odd).collect()} >= {(None, 1), (None, None), (2, 2)}


def test_representatives_of_null_and_repeated_ids(spark):
    rng = random.Random(3)
    a, b, c, e = (prose(rng, 120).split() for _ in range(4))
    near = lambda words, k: " ".join([*words[:k], f"changed{k}", *words[k + 1 :]])
    docs = [
        (None, "alone without id"), (None, ""), (None, None), (None, " "), (None, "one\ttwo"), (None, "one two"),
        (1, " ".join(a)), (7, near(a, 50)), (None, near(a, 60)), (7, "other text of one id"),
        (3, " ".join(b)), (3, " ".join(c)), (4, near(b, 50)), (5, near(c, 50)), (3, " ".join(b)),
        (None, " ".join(e)), (None, near(e, 50)),
    ]
    left = [(r.doc_id, r.text) for r in keep_representatives(table(spark, docs)).collect()]
    certain = [docs[k] for k in (0, 1, 2, 3, 6, 9, 10, 11, 14)]
    assert sorted(map(repr, (x for x in left if x in certain))) == sorted(map(repr, certain))
    rest = [x for x in left if x not in certain]  # one of each group that has no id at all
    assert len(rest) == 2 and sum(x in docs[4:6] for x in rest) == sum(x in docs[15:] for x in rest) == 1
    got = {(r.doc_id, r.component_id) for r in near_duplicates(table(spark, docs)).collect()}
    assert got == {(None, None), (1, 1), (7, 1), (None, 1), (7, 7), (3, 3), (4, 3), (5, 3)}


@pytest.mark.parametrize("percent", [50, 79, 101])
def test_near_dedup_refuses_what_its_bands_would_miss(spark, percent):
    with pytest.raises(ValueError):
        near_duplicates(table(spark, [(1, "a b c")]), percent)
    with pytest.raises(ValueError):
        keep_representatives(table(spark, [(1, "a b c")]), percent)
