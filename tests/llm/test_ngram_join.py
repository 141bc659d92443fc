"""The n-gram join against a plain version: around the threshold, on odd rows, and the bounds that it rests on."""

import random

import numpy as np
import pytest

from tests.llm import odd
from tests.llm.brute import near_components
from wattspan.llm.ngram_join import _sketches, chunk_words, ngram_jaccard_join, size_bands


def corpus(seed, n=260):
    """Families of edited texts of all sizes, exact copies, and texts that share passages."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    docs = []
    for family in range(12):
        base = [f"w{rng.randrange(150)}" for _ in range(rng.choice([1, 2, 3, 6, 9, 12, 25, 60, 150, 400]))]
        for k in range(n // 12):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[f"n{family}x{k}"], [], [copy[at], f"m{rng.randrange(3)}"]])
                copy = copy or ["x"]
            if k % 7 == 0:
                copy += passage
            docs.append(" ".join(copy))
    docs += ["", None, " \t", "One TWO", "one  two", "one two three", docs[5], docs[5].upper()]
    rng.shuffle(docs)
    return [(i * 2, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("percent, n", [(90, 3), (75, 3), (100, 3), (85, 5)])
def test_components(spark, percent, n):
    docs = corpus(percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(odd.table(spark, docs), percent, n).collect()}
    want = near_components(docs, percent, n)
    assert got == want
    assert len({c for _, c in want.values()}) < len(docs) - 40


def test_group_of_near_copies_around_the_threshold(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(200)}" for _ in range(110)]
    docs = []
    for i in range(600):
        copy = list(base)
        for k in range(rng.choice([0, 1, 1, 2, 3, 4])):
            at = rng.randrange(len(copy))
            copy[at : at + 1] = rng.choice([[f"n{i}x{k}"], [], [copy[at], f"m{rng.randrange(4)}"]])
        docs.append((i, " ".join(copy)))
    want = near_components(docs, 90, 3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(odd.table(spark, docs)).collect()} == want
    assert 10 < len({c for _, c in want.values()}) < 550


@pytest.mark.parametrize("percent", [50, 80, 90, 100])
def test_linked_sizes_meet_in_one_band_or_the_next(percent):
    low, chunks = size_bands(percent)
    for a in (*range(1, 400), 5_000, 77_777):
        for b in {a, a * 100 // percent}:
            i, j = np.searchsorted(low, [a, b], "right") - 1
            assert j - i in (0, 1) and (a + b) * (100 - percent) // (100 + percent) < chunks[i]


def test_a_linked_pair_shares_a_chunk_and_sketches_bound_the_difference():
    rng = np.random.default_rng(3)
    for size in (1, 5, 12, 40, 300):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 62, size))
            b = np.union1d(a[rng.random(len(a)) > 0.03], rng.integers(0, 1 << 62, max(1, size // 40)))
            both, level, chunks = len(np.intersect1d(a, b)), *(x[0] for x in _levels(a, b))
            first, parity, xor = chunk_words(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), np.array([chunks, chunks]), np.array([level, level]))
            differ = np.unpackbits((parity[:chunks] ^ parity[chunks:]).view(np.uint8)).sum()
            assert differ <= len(a) + len(b) - 2 * both
            if 100 * both >= 90 * (len(a) + len(b) - both):
                assert ((parity[:chunks] == parity[chunks:]) & (xor[:chunks] == xor[chunks:])).any()


def _levels(a, b):
    low, chunks = size_bands(90)
    level = np.searchsorted(low, [min(len(a), len(b))], "right") - 1
    return level, chunks[level]


def test_sketches_of_empty_blocks_and_sets():
    band, levels = _sketches([], 90)
    assert len(band) == 0 and all(len(parity) == 0 for _, _, parity, _ in levels)
    band, levels = _sketches([np.empty(0, np.int64), np.array([7])], 90)
    assert band.tolist() == [-1, 0] and [len(parity) for _, _, parity, _ in levels] == [1, 0]


def test_odd_rows(spark):
    got = ngram_jaccard_join(odd.table(spark)).collect()
    assert sorted(map(repr, (r.doc_id for r in got))) == sorted(map(repr, (d for d, _ in odd.TEXTS)))
    own = [(d, t) for d, t in odd.TEXTS if d not in (None, 1)]
    want = near_components(own, 90, 3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id in want} == want
    assert ngram_jaccard_join(odd.table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        ngram_jaccard_join(odd.table(spark), percent=40)
