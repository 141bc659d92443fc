"""Batch ids of the lower-case word-BPE vocabulary, equal to tokenizers' own.

Latin-1 text is cut into pre-tokens by byte classes for a whole block at once; every distinct pre-token goes to the
vocabulary's BPE model once a worker. Any other text goes to the tokenizer whole.
"""

from __future__ import annotations

import re
import numpy as np

from wattspan.llm.common import once_a_worker
from wattspan.llm.segments import WordIndex, hash_ranges

#: Texts of these characters only, without special-token strings, are cut by byte class.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]*")
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 13, 32]] = _SPACE
_CLASS[[*range(65, 91), *range(97, 123), 0xAA, 0xB5, 0xBA, *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]] = _LETTER
_CLASS[[*range(48, 58), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = _DIGIT


def pretokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the vocabulary's pre-tokens in lower-case Latin-1 bytes: contractions, letter runs, single digits, other runs."""
    kind = _CLASS[data]
    n = len(data)
    begins = np.empty(n, bool)
    begins[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins |= kind == _DIGIT
    quote = np.flatnonzero(begins & (data == 39))
    quote = quote[quote + 1 < n]
    if len(quote):
        after = data[quote + 1]
        then = data[np.minimum(quote + 2, n - 1)]
        two = np.isin(after, list(b"stmd"))
        three = (quote + 2 < n) & (((after == 114) | (after == 118)) & (then == 101) | (after == 108) & (then == 108))
        for hit, length in ((two, 2), (three, 3)):
            at = quote[hit]
            begins[at + 1] = False
            rest = at + length
            rest = rest[rest < n]
            begins[rest] |= kind[rest] == _LETTER
    at = np.flatnonzero(begins)
    ends = np.append(at[1:], n)
    keep = kind[at] != _SPACE
    return at[keep], ends[keep]


class WordBpe:
    """ids(texts) for one worker; the cache of distinct pre-tokens is bounded."""

    def __init__(self, path: str, cache: int = 150_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.index = WordIndex(cache)

    def _encode(self, words: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(words)
        odd = [i for i, w in enumerate(words) if not w.isascii()]
        for i, x in zip(odd, self.tokenizer.encode_batch_fast([words[i].decode("latin-1") for i in odd], add_special_tokens=False), strict=True):
            out[i] = x.ids
        bpe = self.tokenizer.model.tokenize
        return [[t.id for t in bpe(w.decode())] if x is None else x for w, x in zip(words, out, strict=True)]

    def ids(self, texts: list) -> list[np.ndarray]:
        """One int32 array a text; null counts as empty."""
        texts = ["" if x is None else x for x in texts]
        out: list = [None] * len(texts)
        plain = [i for i, x in enumerate(texts) if "<|" not in x and _PLAIN.fullmatch(x)]
        if plain:
            parts = [texts[i].lower().encode("latin-1") for i in plain]
            joined = b"\n".join(parts)
            data = np.frombuffer(joined, np.uint8)
            starts, ends = pretokens(data)
            flat, before = self.index.expand(
                *hash_ranges(data, starts, ends, 2), lambda at: self._encode([joined[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())])
            )
            at = before[np.searchsorted(starts, np.cumsum([0, *(len(p) + 1 for p in parts)]))]
            for k, i in enumerate(plain):
                out[i] = flat[at[k] : at[k + 1]]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.asarray(x.ids, np.int32)
        return out


@once_a_worker
def shared(path: str) -> WordBpe:
    """One for all tasks of a worker."""
    return WordBpe(path)
