"""Language identification by string kernels.

A text is the set of its character n-grams of one to four letters (blended spectrum, presence only), kept as a bitmap of
hashed n-grams. The kernel of two texts is the size of the intersection over the geometric mean of the two sizes. Nyström
landmarks, texts of the sample, turn kernel rows into features; one-versus-rest kernel ridge regression on these gives a
value for each language. Blocks of texts are scored by matrix products: bitmaps by landmarks, then features by languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattspan.llm.common import batch_blocks
from wattspan.llm.segments import mix

#: Labelled rows of a fit, landmarks among them, languages at most, hashed n-grams, and the longest n-gram.
SAMPLE, LANDMARKS, LANGUAGES, BUCKETS, LONGEST = 4_000, 160, 200, 8_192, 4
UNKNOWN = "und"

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Whether each code point is a letter; built once a worker."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def presence(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """0/1 matrix of hashed n-grams (one row a text, float32) and whether each text has a letter. Other characters are one space."""
    parts = [("" if x is None else x).lower() for x in texts]
    codes = np.frombuffer("\0".join([*parts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    codes = np.where(letter, codes, np.uint32(32))
    edges = np.cumsum([len(p) + 1 for p in parts])
    row = np.repeat(np.arange(len(parts)), np.diff(edges, prepend=0))
    out = np.zeros((len(parts), BUCKETS), np.float32)
    has = np.zeros(len(parts), bool)
    has[row[letter]] = True
    values = mix(codes.astype(np.uint64) + np.uint64(11))
    rolling = np.zeros(len(codes), np.uint64)
    left = edges[row] - 1 - np.arange(len(codes))  # characters up to the end of the text
    flat = out.reshape(-1)
    for n in range(1, LONGEST + 1):
        rolling = rolling[: len(codes) - n + 1] * np.uint64(0xD6E8FEB86659FD93) + values[n - 1 :]
        bucket = (mix(rolling + np.uint64(n)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
        inside = left[: len(bucket)] >= n
        flat[(row[: len(bucket)] * BUCKETS + bucket)[inside]] = 1.0
    return out, has


def kernel(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Normalised intersections of presence rows with landmark rows."""
    sizes = np.sqrt(np.maximum(x.sum(axis=1), 1.0))
    return (x @ landmarks.T) / sizes[:, None] / np.sqrt(np.maximum(landmarks.sum(axis=1), 1.0))


@dataclass
class LanguageModel:
    languages: list[str]
    landmarks: np.ndarray  # packed bits, one row a landmark
    weights: np.ndarray  # landmarks x languages

    def predict(self, texts: list, landmarks: np.ndarray) -> tuple[list[str], np.ndarray]:
        x, has = presence(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        value = kernel(x, landmarks) @ self.weights
        best = value.argmax(axis=1)
        score = np.where(has, np.clip((value[np.arange(len(texts)), best] + 1) / 2, 0, 1), 0.0)
        return [self.languages[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist(), strict=True)], score

    def unpacked(self) -> np.ndarray:
        return np.unpackbits(self.landmarks, axis=1).astype(np.float32)


def fit_language_id(docs: DataFrame, learn: Column | None = None, sample: int = SAMPLE, landmarks: int = LANDMARKS, ridge: float = 1e-3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from about ``sample`` documents with a language, an equal share for each of the LANGUAGES most frequent ones.

    Rows are chosen by a hash of their id among those where ``learn`` holds. Without any, the model knows no language.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).filter(F.lit(True) if learn is None else learn)
    counts = known.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return LanguageModel([], np.empty((0, BUCKETS // 8), np.uint8), np.empty((0, 0)))
    share = F.create_map(*[x for r in counts for x in (F.lit(r.lang), F.lit(min(1.0, sample / len(counts) / r.n)))])
    # texts of a row that many rows repeat would crowd out others, so the hash is that of the text
    chance = F.pmod(F.xxhash64(text_col), F.lit(1_000_000)) / 1_000_000
    rows = known.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(chance < share[F.col("lang")])
    rows = rows.dropDuplicates(["text"]).limit(2 * sample)

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part, texts in batch_blocks(batches, "text"):
            x, has = presence(texts)
            bits = np.packbits(x.astype(bool), axis=1)
            keep = np.flatnonzero(has)
            yield pa.RecordBatch.from_arrays([part.column("lang").take(pa.array(keep)), pa.array([bits[i].tobytes() for i in keep], pa.binary())], ["lang", "bits"])

    found = rows.mapInArrow(read, "lang string, bits binary").collect()
    found.sort(key=lambda r: (bytes(r.bits), r.lang))
    languages = sorted({r.lang for r in found})
    if not languages:
        return LanguageModel([], np.empty((0, BUCKETS // 8), np.uint8), np.empty((0, 0)))
    bits = np.array([np.frombuffer(r.bits, np.uint8) for r in found])
    own = np.array([languages.index(r.lang) for r in found])
    rng = np.random.default_rng(0)
    each = max(1, landmarks // len(languages))
    chosen = np.concatenate([rng.permutation(np.flatnonzero(own == k))[:each] for k in range(len(languages))])
    mark = np.unpackbits(bits[chosen], axis=1).astype(np.float32)
    values, vectors = np.linalg.eigh(kernel(mark, mark).astype(float))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    z = np.concatenate([kernel(np.unpackbits(bits[i : i + 500], axis=1).astype(np.float32), mark) for i in range(0, len(bits), 500)]).astype(float) @ root
    target = np.where(own[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weights = root @ np.linalg.solve(z.T @ z + ridge * len(z) * np.eye(z.shape[1]), z.T @ target)
    return LanguageModel(languages, bits[chosen], weights)


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, lang_pred, score (0 to 1).

    Null texts and texts without a letter are ``und`` with score 0. Repeated rows and null ids are scored like others; an
    empty table gives no rows; other columns are not read. Nothing is shuffled.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        landmarks = model.unpacked()
        for part, texts in batch_blocks(batches, "text", 500_000):
            for i in range(0, len(texts), 256):
                lang, score = model.predict(texts[i : i + 256], landmarks)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").slice(i, 256), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
