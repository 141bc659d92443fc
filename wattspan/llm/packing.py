"""Sum-of-squares online packing of tokenised documents into fixed windows.

Each task packs the documents of its own input split as they come: full windows are cut off a long document, and the
rest goes to the open window whose fill level keeps the sum of squared level counts smallest. What is still open at the
end, or when too many windows are open, is consolidated: the emptiest windows are cut to fill the fullest, and the one
that remains is cut at powers of two, at which a sequence needs no padding. No document crosses tasks, so there is no
shuffle and a lost task is simply run again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspan.llm.common import batch_blocks, map_texts

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Open windows of a task; beyond this they are consolidated, which loses nothing.
MAX_OPEN = 4096
#: Bytes of text that are cut and looked up at once; the arrays of a block take about forty times as much.
BLOCK = 250_000


class Packer:
    """Windows of one task. A piece is (doc, start, ids, doc_tokens); ids is an int32 array."""

    def __init__(self, window: int, first_sequence: int = 0, max_open: int = MAX_OPEN):
        self.window, self.sequence, self.max_open = window, first_sequence, max_open
        #: counts[h]: open windows of fill h; open[h]: those windows, each a list of pieces.
        self.counts = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = {}
        self.n_open = 0

    def _close(self, pieces: list) -> list[tuple]:
        out, offset = [], 0
        for doc, start, ids, total in pieces:
            out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1
        return out

    def add(self, doc, ids: np.ndarray) -> list[tuple]:
        """Place one document; returns the rows of the windows that it fills."""
        out, total, cut = [], len(ids), len(ids) - len(ids) % self.window
        for at in range(0, cut, self.window):
            out += self._close([(doc, at, ids[at : at + self.window], total)])
        if cut < total:
            out += self._place((doc, cut, ids[cut:].copy(), total))
        if self.n_open > self.max_open:
            out += self.consolidate(last=False)
        return out

    def _place(self, piece: tuple) -> list[tuple]:
        size, window, counts = len(piece[2]), self.window, self.counts
        # change of the sum of squares for each level that fits; level 0 opens a window
        change = np.zeros(window - size + 1, np.int64)
        change[:-1] = 2 * counts[size:window] + 1
        change[1:] += np.where(counts[1 : window - size + 1] > 0, 1 - 2 * counts[1 : window - size + 1], 1 << 40)
        level = len(change) - 1 - int(np.argmin(change[::-1]))
        if level:
            pieces = self.open[level].pop()
            counts[level] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        if level + size == window:
            return self._close(pieces)
        self._keep(level + size, pieces)
        return []

    def _keep(self, fill: int, pieces: list) -> None:
        self.open.setdefault(fill, []).append(pieces)
        self.counts[fill] += 1
        self.n_open += 1

    def consolidate(self, last: bool) -> list[tuple]:
        """Fill the fullest open windows with cuts of the emptiest until one is left; at the end cut that one at powers of two."""
        out: list[tuple] = []
        windows = [(h, w) for h in sorted(self.open) for w in self.open[h]]
        self.open, self.n_open = {}, 0
        self.counts[:] = 0
        spare: list = []
        while windows:
            fill, pieces = windows.pop()
            while fill < self.window and (spare or windows):
                if not spare:
                    spare = windows.pop(0)[1][::-1]
                doc, start, ids, total = spare.pop()
                room = self.window - fill
                pieces.append((doc, start, ids[:room], total))
                fill += min(room, len(ids))
                if len(ids) > room:
                    spare.append((doc, start + room, ids[room:], total))
            if fill == self.window:
                out += self._close(pieces)
            elif last:
                out += self._powers(pieces, fill)
            else:
                self._keep(fill, pieces)
            if not windows and spare:
                windows, spare = [(sum(len(p[2]) for p in spare), spare[::-1])], []
        return out

    def _powers(self, pieces: list, fill: int) -> list[tuple]:
        out, rest = [], pieces[::-1]
        while fill:
            room = size = 1 << (fill.bit_length() - 1)
            own = []
            while room:
                doc, start, ids, total = rest.pop()
                own.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    rest.append((doc, start + room, ids[room:], total))
                room -= len(own[-1][2])
            out += self._close(own)
            fill -= size
        return out


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document of ``docs`` into windows of at most ``window`` ids.

    A document is its word-BPE ids and then ``end_id``; null and empty texts are the end id alone. Returns one row a piece:
    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Null ids stay null; repeated rows are separate
    documents; an empty table gives no rows; other columns are not read.
    """
    from public_tokenizers import path

    where = tokenizer_path or path("word_bpe_49k.json")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        from wattspan.llm.tokens import shared

        bpe = shared(where)
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        types = [pa.int64()] * 7
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        end = np.array([end_id], np.int32)

        def table(rows: list[tuple]):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for part, texts in batch_blocks(batches, "_text", BLOCK, keep=shared):
            rows: list[tuple] = []
            for doc, ids in zip(part.column("_id").to_pylist(), bpe.ids(texts), strict=True):
                rows += packer.add(doc, np.concatenate([ids, end]))
            if rows:
                yield table(rows)
        if rows := packer.consolidate(last=True):
            yield table(rows)

    return map_texts(docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")), run, SCHEMA)
