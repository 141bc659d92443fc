"""SentencePiece encoding and decoding by batched Viterbi over distinct segments.

A text is cut where no piece of the vocabulary spans two neighbouring characters, so segments are encoded alone and each
distinct one once. Segments of equal length advance together: at each position the hashes of all substrings that end there
probe the sorted hashes of the pieces, a vectorised maximum chooses the piece, and a backpointer stores it.

Unigram models maximise the sum of piece scores. For BPE models that sum is not what the model defines; there a candidate
counts only if the merges keep it apart from the piece before it, which holds for exactly one candidate a position, so
the maximum gives the library's own result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspan.llm.common import batch_blocks, once_a_worker
from wattspan.llm.segments import BASES, WordIndex, hash_ranges, mix

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Longer segments go position by position, without a batch.
LONG = 48
_NEVER = -1e18


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of one serialised message; nested messages stay bytes."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[i : i + n]
            i += n
        else:
            n = {5: 4, 1: 8}[kind]
            yield key >> 3, struct.unpack("<f" if n == 4 else "<d", data[i : i + n])[0]
            i += n


class PieceModel:
    """Pieces of a model file and the encoder. Only models whose normalisation is the identity are taken."""

    def __init__(self, path: str, cache: int = 1_000_000, model_type: int | None = None):
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        trainer = dict(_fields(next((v for k, v in model if k == 2), b"")))
        normalizer = dict(_fields(next((v for k, v in model if k == 3), b"")))
        if normalizer.get(2):
            raise ValueError("the model's normalisation is not the identity")
        self.bpe = (model_type or trainer.get(3, 1)) == 2
        self.prefix = bool(normalizer.get(3, 1))
        self.trim = bool(normalizer.get(4, 1))
        self.pieces, self.scores, self.types = [], [], []
        for k, v in model:
            if k == 1:
                own = dict(_fields(v))
                self.pieces.append(own[1].decode())
                self.scores.append(own.get(2, 0.0))
                self.types.append(own.get(3, NORMAL))
        if self.trim or USER in self.types or BYTE not in self.types:
            raise ValueError("only models with byte fallback, kept white space and no user-defined pieces are taken")
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.types[i] == BYTE}
        self.id = {p: i for i, p in enumerate(self.pieces) if self.types[i] in (NORMAL, UNUSED)}
        self.score = {p: self.scores[i] for p, i in self.id.items()}
        # candidates: pieces that the model can produce
        usable = [p for p, i in self.id.items() if self.types[i] == NORMAL and (not self.bpe or self._merge(p) == [p])]
        self.usable = frozenset(usable)
        self.longest = max(map(len, usable))
        codes = np.frombuffer("".join(usable).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(p) for p in usable])
        keys = self._hash(codes, ends - [len(p) for p in usable], ends)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array([self.id[p] for p in usable], np.int32)[order]
        self.low_score = min(self.scores) - 10.0
        self.id_scores = np.array([*self.scores, self.low_score])
        self.pairs = pairs = {p[i : i + 2] for p in usable for i in range(len(p) - 1)}
        self.spanned = np.sort(np.array([ord(x[0]) << 32 | ord(x[1]) for x in pairs], np.uint64))
        self.small = np.zeros((512, 512), bool)
        for x in pairs:
            if ord(x[0]) < 512 and ord(x[1]) < 512:
                self.small[ord(x[0]), ord(x[1])] = True
        self.apart: dict[int, bool] = {}
        self.index = WordIndex(cache)
        # bytes of each piece, for decoding
        raw = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace(SPACE, " ").encode() for p, t in zip(self.pieces, self.types, strict=True)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_start = np.cumsum([0, *map(len, raw)])

    @staticmethod
    def _hash(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of substrings by Horner's rule, so that equal substrings agree wherever they stand."""
        out = np.zeros(len(starts), np.uint64)
        values = mix(codes.astype(np.uint64) + np.uint64(1))
        for k in range(int((ends - starts).max(initial=0))):
            live = starts + k < ends
            out[live] = out[live] * np.uint64(BASES[1]) + values[starts[live] + k]
        return out

    def _merge(self, text: str) -> list[str]:
        """Byte-pair merges of a short text: the best-scored, then leftmost, pair first."""
        parts = list(text)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: (self.score.get(parts[i] + parts[i + 1], _NEVER), -i))
            if parts[best] + parts[best + 1] not in self.score:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _stays_apart(self, left: int, right: int) -> bool:
        key = left * len(self.pieces) + right
        if key not in self.apart:
            if len(self.apart) > 2_000_000:
                self.apart.clear()
            a, b = self.pieces[left], self.pieces[right]
            self.apart[key] = a[-1] + b[0] not in self.pairs or self._merge(a + b) == [a, b]
        return self.apart[key]

    def _allowed(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each right piece can follow each left piece (below 0: nothing or a fallback character)."""
        out = left < 0
        at = np.flatnonzero(~out)
        if len(at):
            keys, which = np.unique(left[at].astype(np.int64) * len(self.pieces) + right[at], return_inverse=True)
            n = len(self.pieces)
            known = np.fromiter((self._stays_apart(k // n, k % n) for k in keys.tolist()), bool, len(keys))
            out[at] = known[which]
        return out

    def _batch(self, codes: np.ndarray) -> list[list[int]]:
        """codes: (segments, length). Piece ids of each segment; a character without a piece is -1 - code."""
        m, n = codes.shape
        sums = np.zeros((n + 1, m), np.uint64)
        values = mix(codes.T.astype(np.uint64) + np.uint64(1))
        base = np.uint64(BASES[1])
        for i in range(n):
            sums[i + 1] = sums[i] * base + values[i]
        powers = [np.uint64(pow(BASES[1], k, 1 << 64)) for k in range(self.longest + 1)]
        best = np.full((n + 1, m), _NEVER)
        best[0] = 0
        last = np.full((n + 1, m), -1, np.int32)
        back = np.ones((n + 1, m), np.int32)
        for i in range(1, n + 1):
            best[i] = best[i - 1] + self.low_score * (1 if not self.bpe else 1e9)
            for size in range(1, min(i, self.longest) + 1):
                h = sums[i] - sums[i - size] * powers[size]
                where = np.searchsorted(self.keys, h)
                where[where == len(self.keys)] = 0
                hit = np.flatnonzero(self.keys[where] == h)
                if self.bpe and len(hit):
                    hit = hit[self._allowed(last[i - size, hit], self.key_ids[where[hit]])]
                if not len(hit):
                    continue
                ids = self.key_ids[where[hit]]
                # in BPE models the one candidate that is allowed; fallback characters cost more than any piece
                value = best[i - size, hit] + (0.0 if self.bpe else self.id_scores[ids])
                better = value > best[i, hit]
                hit = hit[better]
                best[i, hit], last[i, hit], back[i, hit] = value[better], ids[better], size
        out: list[list[int]] = [[] for _ in range(m)]
        at = np.full(m, n)
        while (rows := np.flatnonzero(at > 0)).size:
            ids, size = last[at[rows], rows], back[at[rows], rows]
            fallback = -1 - codes[rows, at[rows] - 1].astype(np.int64)
            for r, v in zip(rows.tolist(), np.where(ids < 0, fallback, ids).tolist()):
                out[r].append(v)
            at[rows] -= size
        return [x[::-1] for x in out]

    def _one(self, text: str) -> list[int]:
        """The same recurrence for one long segment."""
        n = len(text)
        best, last, back = [0.0] + [_NEVER] * n, [-1] * (n + 1), [1] * (n + 1)
        for i in range(1, n + 1):
            best[i] = best[i - 1] + self.low_score * (1 if not self.bpe else 1e9)
            for size in range(1, min(i, self.longest) + 1):
                piece = text[i - size : i]
                if piece in self.usable:
                    k = self.id[piece]
                    if self.bpe and last[i - size] >= 0 and not self._stays_apart(last[i - size], k):
                        continue
                    value = best[i - size] + (0.0 if self.bpe else self.scores[k])
                    if value > best[i]:
                        best[i], last[i], back[i] = value, k, size
        out, i = [], n
        while i:
            out.append(last[i] if last[i] >= 0 else -1 - ord(text[i - 1]))
            i -= back[i]
        return out[::-1]

    def encode_segments(self, segments: list[str]) -> list[list[int]]:
        """Ids of each segment; characters without a piece become byte pieces."""
        out: list = [None] * len(segments)
        by_length: dict[int, list[int]] = {}
        for k, s in enumerate(segments):
            by_length.setdefault(len(s), []).append(k)
        for n, rows in by_length.items():
            if n > LONG:
                found = [self._one(segments[k]) for k in rows]
            else:
                codes = np.frombuffer("".join([segments[k] for k in rows]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
                found = [x for i in range(0, len(codes), 20_000) for x in self._batch(codes[i : i + 20_000])]
            for k, ids in zip(rows, found, strict=True):
                out[k] = ids if min(ids) >= 0 else [x for i in ids for x in ([i] if i >= 0 else [self.bytes[b] for b in chr(-1 - i).encode("utf-8", "replace")])]
        return out

    def encode(self, texts: list) -> list[np.ndarray]:
        """One int32 array a text; null and empty texts have no ids."""
        parts = [((SPACE if self.prefix else "") + x.replace(" ", SPACE)) if x else "" for x in texts]
        joined = "".join(parts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(codes)
        if not n:
            return [np.empty(0, np.int32) for _ in texts]
        left, right = codes[:-1], codes[1:]
        low = (left < 512) & (right < 512)
        whole = np.zeros(n - 1, bool)
        whole[low] = self.small[left[low], right[low]]
        high = np.flatnonzero(~low)
        if len(high):
            key = left[high].astype(np.uint64) << np.uint64(32) | right[high]
            where = np.searchsorted(self.spanned, key)
            where[where == len(self.spanned)] = 0
            whole[high] = self.spanned[where] == key
        begins = np.ones(n, bool)
        begins[1:] = ~whole
        edges = np.cumsum([0, *map(len, parts)])
        begins[edges[:-1][edges[:-1] < n]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], n)
        hashes = hash_ranges(codes.view(np.uint8), starts * 4, ends * 4, 2)
        flat, before = self.index.expand(*hashes, lambda at: self.encode_segments([joined[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())]))
        at = before[np.searchsorted(starts, edges)]
        return [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Texts of id arrays: pieces' bytes one after the other, byte pieces as bytes, without the added space."""
        lengths = [len(x) for x in ids]
        flat = np.concatenate([np.empty(0, np.int64), *ids]).astype(np.int64)
        size = self.raw_start[flat + 1] - self.raw_start[flat]
        before = np.concatenate([[0], np.cumsum(size)])
        data = self.raw[np.arange(before[-1]) + np.repeat(self.raw_start[flat] - before[:-1], size)].tobytes()
        edges = before[np.cumsum([0, *lengths])].tolist()
        cut = [data[a:b].decode("utf-8", "replace") for a, b in zip(edges, edges[1:])]
        return [x[1:] if self.prefix and x[:1] == " " else x for x in cut]


@once_a_worker
def shared(path: str) -> PieceModel:
    """One for all tasks of a worker."""
    return PieceModel(path)


def _model_path(path: str | None) -> str:
    if path is not None:
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _id_lists(ids: list[np.ndarray]):
    import pyarrow as pa

    offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *ids]).astype(np.int32)))


def encode_texts(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, ids. Null and empty texts have no ids.

    Ids equal the library's. Repeated rows and null ids are encoded like others; an empty table gives no rows; other columns
    are not read. Nothing is shuffled.
    """
    path = _model_path(model_path)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = shared(path)
        for part, texts in batch_blocks(batches, "text", keep=shared):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), _id_lists(model.encode(texts))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, model_path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row for each row of ``encoded``: doc_id, text. No or null ids give the empty text."""
    path = _model_path(model_path)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = shared(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                ids = [np.asarray(x or [], np.int64) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.decode(ids), pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def encode_digests(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32 (unsigned, of little-endian unsigned 32-bit ids), decoded_sha256, and whether the text came back whole."""
    path = _model_path(model_path)

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        model = shared(path)
        for part, texts in batch_blocks(batches, "text", keep=shared):
            ids = model.encode(texts)
            back = model.decode(ids)
            same = [b == (t or "").replace(SPACE, " ") for b, t in zip(back, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array([hashlib.sha256(b.encode()).hexdigest() for b in back]), pa.array(same)],
                ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
