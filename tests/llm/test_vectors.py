"""Hard negatives and vector codes against plain versions, and on odd rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from wattspan.llm import hard_negatives as hn
from wattspan.llm import vector_codes as vc
from wattspan.llm.hard_negatives import mine_hard_negatives
from wattspan.llm.vector_codes import compress_vectors

#: Extra columns whose names the operators use inside.
EXTRA = "q array<long>, block int, kind int, row_key long, found long, place int, rank int, position int, entry int, salt int, part long, key string, rows long, weight int"
SCHEMA = f"vec_id long, label int, embedding array<double>, {EXTRA}"


def table(spark, rows):
    return spark.createDataFrame([(i, label, v, [1], 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, "k", 12, 13) for i, label, v in rows], SCHEMA)


def vectors(n, dims, seed, spread=0.3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, spread) for _ in range(dims)] for _ in range(6)]
    rows = []
    for i in range(n):
        label = rng.randrange(4)
        centre = centres[rng.randrange(6)]
        # coarse steps, so that scores tie
        rows.append((i, label, [round(c + rng.gauss(0, 0.1), 1) for c in centre]))
    # a third of all rows is one vector, under ids and labels of its own
    return [(i, label, rows[0][2]) if i % 3 == 0 else (i, label, v) for i, label, v in rows]


ODD = [(900, None, [0.1] * 8), (901, 1, None), (902, 1, [0.1] * 7 + [None]), (903, 2, [0.1] * 7 + [float("nan")]), (904, 2, [float("inf")] + [0.1] * 7)]


@pytest.mark.parametrize("least", [40, 1024])
def test_hard_negatives(spark, monkeypatch, least):
    monkeypatch.setattr(hn, "LEAST_ROWS", least)
    rows = vectors(400, 8, 3) + ODD
    got = mine_hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0, F.col("label"))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute.hard_negatives(rows, lambda i: i % 10 == 0)
    assert len(want) > 100 and sorted(map(tuple, got.collect())) == sorted(want)


def test_hard_negatives_read_few_dimensions_of_most_rows():
    import numpy as np

    rng = np.random.default_rng(5)
    block = hn.VerticalBlock(np.arange(5_000), np.zeros(5_000, np.int64), rng.integers(-100, 100, (5_000, 64)) * np.where(np.arange(64) < 8, 8, 1))
    seen = []
    anchor = block.columns[:, 7].astype(np.int64)

    def keep(sums, least, most):
        seen.append(len(sums))
        kth = np.partition(sums, len(sums) - 5)[len(sums) - 5]
        return sums + most >= kth + least

    rows, scores = block.scan(anchor, np.arange(5_000), keep)
    full = anchor @ block.columns.astype(np.int64)
    assert seen[1] < 2_500 and seen[-1] < 200 and (scores == full[rows]).all()
    assert set(np.argsort(-full, kind="stable")[:5]) <= set(rows.tolist())


def test_hard_negatives_of_odd_tables(spark):
    anchors, label = F.col("vec_id") % 50 == 0, F.col("label")
    assert mine_hard_negatives(table(spark, []), anchors, label).count() == 0
    # repeated rows count once; rows that repeat an id are rows of their own and never each other's positives
    rows = [(50, 1, [1.0, 0.0]), (50, 1, [1.0, 0.0]), (50, 1, [0.5, 0.5]), (1, 1, [1.0, 1.0]), (1, 1, [1.0, 1.0]), (2, 2, [0.75, 0.0]), (3, 2, [0.75, 0.0]), (None, 2, [0.75, 0.0]), (4, 2, [1.0]), (5, 1, []), (100, 2, []), (6, 2, [1e300, 0.0])]
    got = sorted(map(tuple, mine_hard_negatives(table(spark, rows), anchors, label).collect()))
    half = 256 * 256
    assert got == [(50, 1, 1, 2, half, half * 3 // 4), (50, 1, 2, 3, half, half * 3 // 4)]
    # negative scores have no range
    rows = [(50, 1, [1.0]), (1, 1, [-1.0]), (2, 2, [-0.75])]
    assert mine_hard_negatives(table(spark, rows), anchors, label).count() == 0


def test_large_integers_stay_exact(spark):
    big = float(2**19)
    rows = [(50, 1, [big, 1.0]), (1, 1, [big, 1.0]), (2, 2, [big * 0.75, 3.0]), (3, 2, [big * 0.75, 5.0])]
    got = [tuple(r) for r in mine_hard_negatives(table(spark, rows), F.col("vec_id") == 50, F.col("label")).collect()]
    assert got == brute.hard_negatives(rows, lambda i: i == 50) and len(got) == 2


@pytest.mark.parametrize("rounds", [0, 2, 4])
def test_vector_codes(spark, monkeypatch, rounds):
    monkeypatch.setattr(vc, "MEMBERS", 300)
    rows = vectors(300, 8, 4) + ODD
    got = compress_vectors(table(spark, rows), parts=4, entries=16, rounds=rounds)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want, books = brute.vector_codes([(i, "" if label is None else str(label), v) for i, label, v in rows], 4, 16, rounds)
    assert {r.vec_id: (r.code, r.error, r.label_error) for r in got.collect()} == want and len(want) == 301
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    assert {r.codebooks_sha256 for r in got.collect()} == {hashlib.sha256(text.encode()).hexdigest()}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("members_")]


def test_only_those_that_change_entry_migrate(spark, monkeypatch):
    moved = []
    move_in = vc._Owners.move_in

    def counted(self, members):
        move_in(self, members)
        moved.append(self.spark.table(self.tables[-1]).agg(F.sum("n")).first()[0] or 0)

    monkeypatch.setattr(vc._Owners, "move_in", counted)
    compress_vectors(table(spark, vectors(300, 8, 4)), parts=4, entries=16, rounds=3)
    assert moved[0] == 300 * 4 and 0 < moved[1] < 600 and moved[2] < moved[1]


def test_vector_codes_of_odd_tables(spark):
    assert compress_vectors(table(spark, []), parts=2).count() == 0
    assert compress_vectors(table(spark, [(1, 1, None)]), parts=2).count() == 0
    rows = [(3, 1, [0.5, 0.5]), (3, 1, [0.5, 0.5]), (None, None, [0.5, 0.25]), (4, None, [0.5, 0.5, 0.5]), (5, 2, [1e300, 0.5]), (6, 2, []), (2, 1, [0.0, 0.0])]
    got = sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in compress_vectors(table(spark, rows), parts=2, entries=2, rounds=0).collect())
    # entries are ids 2 and 3; ties go to the lower index
    assert got == [("2", "0000", 0, 0), ("3", "0101", 0, 0), ("3", "0101", 0, 0), ("None", "0100", 64 * 64, 64 * 64)]
    with pytest.raises(ValueError):
        compress_vectors(table(spark, rows), entries=300)
