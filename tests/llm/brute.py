"""Plain restatements of the operators' contracts, for small inputs."""

from __future__ import annotations


def fold(text: str) -> bytes:
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


def shingle_set(text: str | None, n: int = 5) -> frozenset:
    words = fold(text).split()
    if len(words) < n:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def near_components(docs: list[tuple[int, str | None]], percent: int, n: int = 5) -> dict[int, tuple[int, int]]:
    sets = {d: shingle_set(t, n) for d, t in docs}
    where: dict = {}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, s in sets.items():
        common: dict = {}
        for x in s:
            for o in where[x]:
                if o < d:
                    common[o] = common.get(o, 0) + 1
        for o, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[o]) - n):
                a, b = find(d), find(o)
                root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def repeated_words(docs: list[tuple[int, str | None]], window: int = 20) -> dict[int, list[bool]]:
    """For each document, which of its words a window covers that starts earlier too."""
    first: dict = {}
    words = {d: (t or "").encode().split() for d, t in sorted(docs)}
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if first.setdefault(key, (d, i)) != (d, i):
                gone[i : i + window] = [True] * window
        out[d] = gone
    return out


def base_spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    import re

    text = text or ""
    assign = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    return {
        "assign": [m.span() for m in assign.finditer(text) if len(m[2]) >= 6],
        "access": [m.span() for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20],
        "hex": [m.span() for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 24],
    }


def base_digest(text: str | None) -> tuple[int, int, int, str]:
    import hashlib

    found = base_spans(text)
    listed = sorted((a, i, b, k) for i, k in enumerate(("assign", "access", "hex")) for a, b in found[k])
    return (*(len(found[k]) for k in ("assign", "access", "hex")), hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in listed).encode()).hexdigest())


def _integers(vector, scale: int = 256) -> list[int] | None:
    import math

    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return [math.floor(scale * x) for x in vector]


def hard_negatives(rows: list[tuple], asks, k: int = 5, m: int = 3, low: int = 50, high: int = 95) -> list[tuple]:
    """(anchor, positive, rank, negative, positive score, negative score) of rows (id, label, vector)."""
    own = [(i, label, v) for i, label, v in ((i, label, _integers(v)) for i, label, v in rows) if None not in (i, label, v)]
    out = []
    for anchor, label, a in own:
        if asks(anchor):
            scores = sorted((-sum(x * y for x, y in zip(a, v, strict=True)), i, other) for i, other, v in own)
            for p, i, _ in [s for s in scores if s[2] == label and s[1] != anchor][:k]:
                found = [(j, -s) for s, j, other in scores if other != label and low * -p <= 100 * -s <= high * -p][:m]
                out += [(anchor, i, rank, j, -p, s) for rank, (j, s) in enumerate(found, 1)]
    return out


def vector_codes(rows: list[tuple], parts: int, entries: int, rounds: int) -> tuple[dict, list]:
    """{id: (code, error, label error)} of rows (id, label, vector), and the codebooks."""
    own = sorted((i, label, v) for i, label, v in ((i, label, _integers(v)) for i, label, v in rows) if v is not None)
    width = len(own[0][2]) // parts
    cut = {i: [v[p * width : (p + 1) * width] for p in range(parts)] for i, _, v in own}
    books = [[cut[i][p] for i, _, _ in own[:entries]] for p in range(parts)]

    def assign():
        return {i: [min((sum((a - b) ** 2 for a, b in zip(x, e)), n) for n, e in enumerate(books[p])) for p, x in enumerate(xs)] for i, xs in cut.items()}

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                if members := [cut[i][p] for i in cut if got[i][p][1] == e]:
                    books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    got = assign()
    errors = {i: sum(d for d, _ in x) for i, x in got.items()}
    labels = {i: label for i, label, _ in own}
    return {i: ("".join(f"{e:02x}" for _, e in x), errors[i], sum(errors[j] for j in cut if labels[j] == labels[i])) for i, x in got.items()}, books


def redacted(text: str | None, live: list[tuple[int, int]], mark: str = "[secret]") -> str | None:
    """The text with the ranges of code points replaced, ranges that overlap or touch by one mark."""
    if text is None or not live:
        return text
    inside = [False] * len(text)
    for a, b in live:
        inside[a:b] = [True] * (b - a)
    out = []
    for i, c in enumerate(text):
        if not inside[i]:
            out.append(c)
        elif i == 0 or not inside[i - 1]:
            out.append(mark)
    return "".join(out)
