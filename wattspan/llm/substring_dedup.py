"""Substring deduplication by hashes of fixed-length runs, in place of relative Lempel-Ziv factors.

No factor is parsed or extended. Every run of 20 words is hashed to the shuffle partition that finds the first place of
that run; a run whose first place is elsewhere (a smaller doc_id, or an earlier start in the same document) is repeated,
and the union of a document's repeated runs are its spans. A word lies in such a run exactly if it lies in a repeat of 20
words or more, which is what the result asks for; a greedy parse takes one factor at a place and needs the runs across
its boundaries looked up besides to find the same words.

Most runs are new text. So that only runs that can repeat are looked up, each document first names the smallest of the
four-word hashes of each of its runs, its anchors: equal runs have equal anchors. An anchor that only one document has is
dead, and so are the runs under it. Whole copies go before that: a copy of a smaller document is one span.
Only facts about single places go back to a document (its dead anchors, its first places), so no frequent run is ever
gathered or joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspan.llm.common import batch_blocks, join_by_key, materialise
from wattspan.llm.segments import Words, hash_ranges, hash_runs

GRAM = 4
#: Stands for a null id inside: such rows come last.
_LAST = (1 << 63) - 1
_DOCUMENTS = "id long, x long, c int, n_words long, all_sha256 string, k1 long, k2 long, anchors array<long>"


def _int_lists(column) -> list[np.ndarray]:
    """A list column as arrays; null lists are empty."""
    lengths = np.array([0 if n is None else n for n in column.value_lengths().to_pylist()], np.int64)
    return np.split(column.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths)[:-1])


class _Text(Words):
    """Words, runs and anchors of the texts of one block."""

    def __init__(self, texts: list, window: int):
        super().__init__(texts, fold=False)
        self.window = window
        self.hashes = hash_ranges(self.data, self.starts, self.ends, 2)
        wide = window - GRAM + 1
        low = self.grams = hash_runs(self.hashes[0], GRAM)
        size = 1
        while size * 2 <= wide and len(low) > size:  # minima over wide neighbours by doubling
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        rest = wide - size
        self.low = (np.minimum(low[:-rest], low[rest:]) if rest and len(low) > rest else low[:0] if rest else low).view(np.int64)

    def n_words(self, i: int) -> int:
        return int(self.first[i + 1] - self.first[i])

    def runs(self, i: int) -> slice:
        """Where the runs of text i start, as word indexes of the block."""
        return slice(self.first[i], max(self.first[i], self.first[i + 1] - self.window + 1))

    def anchors(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors of text i, sorted, and for each of its runs which of them it has."""
        return np.unique(self.low[self.runs(i)], return_inverse=True)

    def repeated(self, i: int, anchors: np.ndarray) -> np.ndarray:
        """Whether each of these anchors of text i stands in it more than once."""
        grams = self.grams[self.first[i] : self.first[i + 1] - GRAM + 1].view(np.int64)
        where = np.searchsorted(anchors, grams)
        where[where == len(anchors)] = 0
        return np.bincount(where[anchors[where] == grams], minlength=len(anchors)) > 1

    @cached_property
    def all_runs(self) -> tuple[np.ndarray, ...]:
        """Both hashes of the run that starts at each word of the block."""
        return tuple(hash_runs(x, self.window).view(np.int64) for x in self.hashes)

    def run_hashes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.all_runs[0][at], self.all_runs[1][at]

    def sha256(self, i: int, removed: np.ndarray | None = None) -> str:
        return hashlib.sha256(self.joined(i, removed)).hexdigest()


def _live_runs(words: _Text, i: int, dead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of text i the runs with a live anchor: positions in the document, both hashes, and whether the run is new in the document."""
    anchors, which = words.anchors(i)
    if not len(anchors):
        return which, which, which, which.astype(bool)
    live = np.ones(len(anchors), bool)
    live[dead] = False
    live |= words.repeated(i, anchors)  # a dead anchor can still repeat inside its own document
    at = np.flatnonzero(live[which])
    h, c = words.run_hashes(at + words.first[i])
    _, new = np.unique(h, return_index=True)
    first = np.zeros(len(at), bool)
    first[new] = True
    return at, h, c, first


def _read_documents(window: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part, texts in batch_blocks(batches, "text"):
            words = _Text(texts, window)
            anchors = [words.anchors(i)[0] for i in range(len(texts))]
            offsets = np.cumsum([0, *map(len, anchors)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(x) for x in ("id", "x", "c")), pa.array(np.diff(words.first), pa.int64()), pa.array([words.sha256(i) for i in range(len(texts))]), *map(pa.array, words.keys()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *anchors])))],
                ["id", "x", "c", "n_words", "all_sha256", "k1", "k2", "anchors"],
            )

    return run


def _runs(window: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part, texts in batch_blocks(batches, "text"):
            words = _Text(texts, window)
            out: list[list] = [[], [], [], []]
            for i, (doc, dead) in enumerate(zip(part.column("doc").to_pylist(), _int_lists(part.column("dead")), strict=True)):
                at, h, c, first = _live_runs(words, i, dead)
                for column, values in zip(out, (h[first], c[first], np.full(first.sum(), doc), at[first]), strict=True):
                    column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x).astype(np.int64)) for x in out[:3]), pa.array(np.concatenate(out[3]).astype(np.int32))], ["h", "c", "doc", "at"])

    return run


def _spans(window: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part, texts in batch_blocks(batches, "text"):
            words = _Text(texts, window)
            rows = []
            columns = part.column("doc").to_pylist(), _int_lists(part.column("dead")), _int_lists(part.column("firsts"))
            for i, (doc, dead, firsts) in enumerate(zip(*columns, strict=True)):
                at = _live_runs(words, i, dead)[0]
                gone = np.setdiff1d(at, firsts, assume_unique=True)
                edge = np.zeros(words.n_words(i) + 1, np.int32)
                np.add.at(edge, gone, 1)
                np.add.at(edge, gone + window, -1)
                removed = np.cumsum(edge)[:-1] > 0
                turns = np.flatnonzero(np.diff(np.concatenate([[0], removed.astype(np.int8), [0]])))
                rows.append((doc, int(removed.sum()), words.sha256(i, removed), [{"start": a, "end": b} for a, b in turns.reshape(-1, 2).tolist()]))
            if rows:
                doc, n, sha, spans = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(sha), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["doc", "n_removed", "sha", "found"])

    return run


def repeated_spans(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, kept_sha256, spans (start and end of removed word runs).

    Words are runs without ASCII white space. A word goes if a run of ``window`` words covers it that starts earlier too: in
    a row of a smaller doc_id, or earlier in the same row. Runs are judged on the input. Null and empty texts have no words.
    Rows that repeat an id and its words are one document and get equal rows; of rows that share an id but not their words
    the order is fixed by a hash of the words; null ids come last. An empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text).alias("x"), F.hash(text).alias("c"))
    read = materialise(source.mapInArrow(_read_documents(window), _DOCUMENTS), "documents")
    # one row for each distinct sequence of words, numbered in the order of ids; x and c tell texts of one id apart
    slim = read.groupBy("k1", "k2").agg(F.min(F.struct("id", "x", "c")).alias("first"), F.count(F.lit(1)).alias("size"), F.max(F.size("anchors")).alias("n_anchors"))
    slim = slim.select("k1", "k2", "first.*", "size", "n_anchors").orderBy("id", "k1")
    slim = materialise(slim.withColumn("doc", F.monotonically_increasing_id()), "numbered")

    long = read.filter(F.size("anchors") > 0).select("id", "x", "c", "anchors").join(slim.select("id", "x", "c", "doc"), ["id", "x", "c"])
    held = long.select("doc", F.posexplode("anchors").alias("i", "anchor")).groupBy("anchor").agg(F.min("doc").alias("doc"), F.max("doc").alias("last"), F.min("i").alias("i"))
    dead = held.filter(F.col("doc") == F.col("last")).groupBy("doc").agg(F.collect_list("i").alias("dead"))
    lists = slim.filter("n_anchors > 0").join(dead, "doc", "left").select("id", "x", "c", "doc", F.coalesce("dead", F.array().cast("array<int>")).alias("dead"))
    texts = materialise(source.filter("text is not null").join(lists.hint("shuffle_hash"), ["id", "x", "c"]).select("doc", "dead", "text"), "texts", compression="zstd")

    places = texts.mapInArrow(_runs(window), "h long, c long, doc long, at int").groupBy("h", "c").agg(F.min("doc").alias("doc"), F.min_by("at", "doc").alias("at"))
    firsts = places.groupBy("doc").agg(F.collect_list("at").alias("firsts"))
    found = texts.join(firsts.hint("shuffle_hash"), "doc", "left").mapInArrow(_spans(window), "doc long, n_removed long, sha string, found array<struct<start:int,end:int>>").dropDuplicates(["doc"])

    known = slim.join(found, "doc", "left").select("k1", "k2", F.col("id").alias("first_id"), "size", "n_removed", "sha", "found")
    rows = join_by_key(read.drop("anchors"), known, ["k1", "k2"], "size", read.count())
    copy = (F.col("id") != F.col("first_id")) & (F.col("n_words") >= window)
    none = F.array().cast("array<struct<start:int,end:int>>")
    return rows.select(
        F.nullif("id", F.lit(_LAST)).alias("doc_id"), "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", "all_sha256")).alias("kept_sha256"),
        F.when(copy, F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))).otherwise(F.coalesce("found", none)).alias("spans"),
    )
