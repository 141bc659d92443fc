"""N-gram Jaccard join by parity sketches.

A document's set is its distinct word n-grams. Of two sets with a + b members a link at ``percent`` leaves at most
T = (a + b) * (100 - percent) / (100 + percent) members outside the intersection.

1. Size bands: linked sets lie in one band or in neighbouring ones. Each band has its own number of chunks, T + 1 for the
   largest sizes that meet there; a set joins in its own band and in the one below.
2. Parity sketch: the hash of each member picks a chunk and flips one of its 64 bits, so the sketches of two sets differ in
   at most as many bits as the sets have members outside the intersection: a lower bound.
3. Pigeonhole join: at most T members fall into T + 1 chunks, so at least one chunk of a linked pair holds the same members.
   Chunks are joined by their bits and the XOR of their members' hashes. No linked pair is missed.
4. Verify: sketches that differ in more than T bits refuse a pair, then full sets decide.

Documents with the same words are one representative. In a group that shares a chunk, every member is verified against its
most central one; groups that then still lie in several components meet again on their rarest n-grams, by an exact bound of
what two sets can share (see ``near_dedup``), so a large group costs rows in proportion to its size and loses no link.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattspan.llm.common import batch_blocks, join_by_key, key_filter, materialise, with_passes
from wattspan.llm.near_dedup import Method, differ, document_shingles, judged, keyed, lists
from wattspan.llm.segments import Words, mix

FEATURES = "doc_id long, x long, c int, n_shingles long, k1 long, k2 long, bands array<long>"
SETS = "rep long, shingles array<long>, sketch array<long>"
#: Below, chunks hold too few members to tell sets apart.
LEAST_PERCENT = 50
LARGEST = 1 << 40
_PARITY, _XOR, _LEVEL, _CHUNK = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


@cache
def size_bands(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest size of each band, and each band's number of chunks; no link skips a band. A band grows by a twentieth at least."""
    low = [1]
    while low[-1] < LARGEST:
        low.append(max(low[-1] * 100 // percent, low[-1] * 21 // 20) + 1)
    sums = [b + c - 2 for b, c in zip(low[1:], low[2:])]
    return np.array(low[: len(sums)], np.int64), np.array([s * (100 - percent) // (100 + percent) + 1 for s in sums], np.int64)


def chunk_words(members: np.ndarray, owner: np.ndarray, chunks: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the sets of a block, where each one's chunks begin (one more at the end), and the parity bits and XOR of each chunk.

    members: hashes; owner: whose they are; chunks and level: of each set.
    """
    first = np.concatenate([[0], np.cumsum(chunks)])
    parity, xor = np.zeros(first[-1], np.uint64), np.zeros(first[-1], np.uint64)
    if len(members):
        h = mix(members.view(np.uint64) ^ ((level[owner].astype(np.uint64) + np.uint64(1)) * _PARITY))
        chunk = first[owner] + (((h >> np.uint64(32)) * chunks[owner].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(chunk, kind="stable")
        chunk = chunk[order]
        starts = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
        parity[chunk[starts]] = np.bitwise_xor.reduceat(np.uint64(1) << (h[order] & np.uint64(63)), starts)
        xor[chunk[starts]] = np.bitwise_xor.reduceat(mix(members.view(np.uint64) ^ _XOR)[order], starts)
    return first, parity, xor


def _sketches(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """Each set's band (-1: empty), and for its own band and the one below (level, first, parity, xor)."""
    low, chunks = size_bands(percent)
    sizes = np.array([len(s) for s in sets], np.int64)
    band = np.searchsorted(low, sizes, "right") - 1
    members, owner = np.concatenate([np.empty(0, np.int64), *sets]), np.repeat(np.arange(len(sets)), sizes)
    out = []
    for level in (band, band - 1):
        own = np.where(level >= 0, chunks[np.maximum(level, 0)], 0)
        inside = level[owner] >= 0
        out.append((level, *chunk_words(members[inside], owner[inside], own, level)))
    return band, out


def _features(n: int, percent: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part, texts in batch_blocks(batches, "text"):
            words = Words(texts, fold=True)
            sets = list(document_shingles(words, n))
            keys = []
            for level, first, parity, xor in _sketches(sets, percent)[1]:
                of = np.repeat(np.arange(len(sets)), np.diff(first))
                place = (level[of] + 1).astype(np.uint64) * _LEVEL + (np.arange(first[-1]) - first[of]).astype(np.uint64) * _CHUNK
                keys.append(np.split(mix(mix(parity + place) ^ xor).view(np.int64), first[1:-1]))
            both = [np.concatenate(x) for x in zip(*keys, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(x) for x in ("doc_id", "x", "c")), pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, words.keys()), lists(both)],
                ["doc_id", "x", "c", "n_shingles", "k1", "k2", "bands"],
            )

    return run


def _sets(n: int, percent: int):
    """Full sets, each with one flat sketch: size, band, chunks in its own band, then the bits there and in the band below."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: set[int] = set()
        for part, texts in batch_blocks(batches, "text"):
            # rows that repeat id and text meet in a task
            new = [i for i, rep in enumerate(part.column("rep").to_pylist()) if not (rep in seen or seen.add(rep))]
            sets = list(document_shingles(Words([texts[i] for i in new], fold=True), n))
            band, levels = _sketches(sets, percent)
            bits = [np.split(parity.view(np.int64), first[1:-1]) for _, first, parity, _ in levels]
            flat = [np.concatenate([[len(s), b, len(own)], own, below]).astype(np.int64) for s, b, own, below in zip(sets, band.tolist(), *bits)]
            yield pa.RecordBatch.from_arrays([part.column("rep").take(pa.array(new, pa.int64())), lists(sets), lists(flat)], ["rep", "shingles", "sketch"])

    return run


def _placed(reps: DataFrame) -> DataFrame:
    chunks = reps.select("rep", "n_shingles", F.explode("bands").alias("band"))
    shared = materialise(chunks.groupBy("band").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "shared")
    total = reps.agg(F.coalesce(F.sum(F.size("bands")), F.lit(0))).first()[0]
    likely = with_passes(chunks, key_filter(shared, F.col("band")), "band").filter("passes").drop("passes")
    return join_by_key(likely, shared, ["band"], "m", total)


def _close(percent: int) -> Column:
    """The bits that differ, on the level of the smaller band, are at most the members that a link can leave out."""
    size_a, size_b, band_a, band_b = (F.get(f, i) for i in (0, 1) for f in ("fact_a", "fact_b"))
    own = lambda f: F.slice(f, F.lit(4), F.get(f, 2).cast("int"))
    below = lambda f: F.slice(f, (F.get(f, 2) + 4).cast("int"), F.size(f))
    x = F.when(band_a <= band_b, own("fact_a")).otherwise(below("fact_a"))
    y = F.when(band_b <= band_a, own("fact_b")).otherwise(below("fact_b"))
    return (F.abs(band_a - band_b) <= 1) & (differ(x, y) * (100 + percent) <= (size_a + size_b) * (100 - percent))


def ngram_jaccard_join(docs: DataFrame, percent: int = 90, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are runs without ASCII white space, A-Z lower-cased. A document's set is its distinct ``n``-word shingles, or its
    whole word sequence if that is shorter. Documents are linked where 100 * intersection >= percent * union; component_id is
    the smallest id reachable by links, and the document of that id is kept. Null, empty and blank texts have no shingles and
    are linked with nothing. Rows that share an id but not their text, or have a null id, are documents of their own; a null
    id takes the smallest other id of its component, or stays null. Rows that repeat both id and text are one document. An
    empty table gives no rows; other columns are not read. ``percent`` is 50 to 100, else ValueError. Shingles are equal when
    their 64-bit hashes are, texts when 128 bits of a cryptographic hash of their words are.
    """
    if not LEAST_PERCENT <= percent <= 100 or n < 1:
        raise ValueError(f"percent must be {LEAST_PERCENT} to 100, n at least 1")
    method = Method(_features(n, percent), FEATURES, _sets(n, percent), SETS, ("bands",), _placed, lambda reps, sets: sets.select("rep", F.col("sketch").alias("fact")), _close)
    return judged(keyed(docs, id_col, text_col), percent, method).select("doc_id", "n_shingles", "component_id", "kept")
