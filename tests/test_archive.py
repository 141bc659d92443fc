"""An archive that is written, gone on with, read, verified and forged."""

import json

import pytest
from pyspark.sql import functions as F

from tests.spans import stamp
from wattspan.operators import periodic
from wattspan.sources import archive


def windows(spark, rows):
    """rows: (chain, hour, requests)."""
    df = spark.createDataFrame(rows, "file string, line long, requests long")
    report = F.struct("requests", (F.col("requests") * 10).alias("io_ops"), F.lit(0.1).alias("energy_kwh"))
    ts = F.date_format(F.timestamp_millis(F.lit(1_752_156_000_000) + F.col("line") * 3_600_000), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return df.select("file", "line", archive.window_body(ts, report).alias("body"))


def files(folder):
    return sorted(p for p in folder.rglob("*.txt") if "_heads" not in str(p))


def counts(spark, path, *period, segment=50_000):
    return {r.file: tuple(r)[1:] for r in periodic.verify_archive_chain(archive.read_archive_lines(spark, path), *period, segment=segment).collect()}


@pytest.fixture
def written(spark, tmp_path):
    path = str(tmp_path / "archive")
    for batch in range(3):
        hours = range(batch * 4, batch * 4 + 4)
        archive.append_window_archive(windows(spark, [(c, h, h) for c in ("shop/eu +1", "cart") for h in hours if c == "cart" or batch != 1]), path, batch)
    return tmp_path / "archive", path


def test_chains_go_on_and_a_retried_batch_leaves_no_line_twice(spark, written):
    folder, path = written
    assert counts(spark, path) == {"shop/eu +1": (8, 8, 0), "cart": (12, 12, 0)}
    archive.append_window_archive(windows(spark, [("cart", h, h) for h in range(8, 12)] + [("shop/eu +1", h, h) for h in range(8, 12)]), path, 2)
    assert counts(spark, path, segment=3) == {"shop/eu +1": (8, 8, 0), "cart": (12, 12, 0)}
    good, bad = archive.read_window_archive(spark, path)
    assert bad.count() == 0 and good.count() == 20
    rows = [(r.line, r.seq, r.requests) for r in good.filter("file = 'cart'").orderBy("line").collect()]
    assert rows == [(i, i, i) for i in range(12)]
    line = json.loads(files(folder)[0].read_text().splitlines()[0])
    assert sorted(line) == ["hash", "prev", "report", "seq", "ts"]
    assert line["hash"] == periodic.archive_hash(json.dumps(line), None, None)


def forge(folder, change):
    """Change the lines of the chain of twelve as one list, and write them back into its three files."""
    own = [p for p in files(folder) if "chain=cart" in str(p)]
    lines = [p.read_text().splitlines() for p in own]
    new = change([x for part in lines for x in part])
    for p, part in zip(own, (new[:4], new[4:8], new[8:]), strict=True):
        for crc in p.parent.glob(".*.crc"):
            crc.unlink()
        p.write_text("".join(f"{x}\n" for x in part))


def without_hash(line):
    row = json.loads(line)
    del row["hash"]
    return json.dumps(row)


@pytest.mark.parametrize(
    "change, want",
    [
        (lambda x: x[:5] + [x[5].replace('"requests":5', '"requests":6')] + x[6:], (12, 11, 1)),
        (lambda x: x[:4] + x[5:] + [], (11, 10, 1)),
        (lambda x: x[:3] + [x[4], x[3]] + x[5:], (12, 9, 3)),
        (lambda x: x[:5] + [without_hash(x[5])] + x[6:], (12, 11, 1)),
        (lambda x: [without_hash(x[0])] + x[1:], (12, 10, 1)),
        (lambda x: x[:6] + ['{"ts": "2025-', "", "7"] + x[6:], (12, 12, 0)),
        (lambda x: x[:6] + [x[6].replace('"seq":6', '"seq":9')] + x[7:], (12, 10, 2)),
    ],
    ids=["edited", "removed", "swapped", "hash removed", "unchained start", "broken lines", "renumbered"],
)
def test_forged_lines_break_the_chain(spark, written, change, want):
    folder, path = written
    forge(folder, change)
    assert counts(spark, path, segment=2) == {"shop/eu +1": (8, 8, 0), "cart": want}


def test_breaks_in_and_out_of_a_period(spark, written):
    folder, path = written
    # hours 0 to 9 lie on the first day
    forge(folder, lambda x: [x[0], x[1].replace('"requests":1', '"requests":2'), *x[2:11], x[11].replace('"requests":11', '"requests":12')])
    assert counts(spark, path, "2025-07-10", "2025-07-10")["cart"] == (12, 10, 2, 1, 1, 0)


def test_lines_keep_their_numbers_over_splits(spark, tmp_path):
    lines = [json.dumps({"ts": stamp(i * 1000), "report": {"requests": i}, "pad": "x" * (i % 50)}) for i in range(2_000)]
    (tmp_path / "w.json").write_text("\n".join([*lines, "{broken", json.dumps({"ts": "no"})]))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        raw = archive.read_archive_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        good, bad = archive.read_window_archive(spark, str(tmp_path / "w.json"))
        assert [(r.line, r.requests) for r in good.orderBy("line").collect()] == [(i, i) for i in range(2_000)]
        assert sorted((r.line, r.text) for r in bad.collect()) == [(2_000, "{broken"), (2_001, '{"ts": "no"}')]
        # a file that was never chained
        assert [tuple(r)[1:] for r in periodic.verify_archive_chain(raw, "2025-07-10", "2025-07-10").collect()] == [(2_001, 0, 0, 0, 0, 2_001)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_odd_batches(spark, tmp_path):
    path = str(tmp_path / "odd")
    archive.append_window_archive(windows(spark, []), path, 0)
    assert archive.read_archive_lines(spark, path).count() == 0
    rows = spark.createDataFrame([("a", 0, "{}"), ("a", 1, "no json"), ("a", 2, None), ("a", 3, '{"x": 1.50}')], "file string, line long, body string")
    archive.append_window_archive(rows, path, 1)
    assert counts(spark, path) == {"a": (2, 2, 0)} and '"x":1.50' in "".join(p.read_text() for p in files(tmp_path / "odd"))
