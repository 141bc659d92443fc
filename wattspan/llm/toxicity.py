"""Toxicity by a learned lexicon, misspelling automata and context windows.

Fit, on a bounded sample of labelled documents: Spark counts in how many toxic and clean documents each word and each word
beginning stands; those that lean strongly to toxic documents form a lexicon trie. Score: the trie is intersected with
Levenshtein automata of one edit; the product is made deterministic lazily, so a word is read once, letter by letter, and
most words die after two letters. Each hit is weighed by a window of words around it: inside quotation marks, or near a
reporting word, it counts as a quotation and not as abuse. A logistic regression on these window scores gives the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattspan.llm.common import batch_blocks, map_texts, materialise

#: Labelled rows of a fit, lexicon entries and words known to be clean: the bounds of all that the driver holds.
SAMPLE, LEXICON, CLEAN = 12_000, 3_000, 5_000
#: A word; digits and a few signs inside it may stand for letters.
_WORD = re.compile(r"[^\W_](?:[\w@*!$]*[^\W_])?")
_QUOTES = re.compile('["“”„«»]')
#: Words that report somebody else's words.
REPORTING = frozenset("said says wrote writes quote quoted quotes quoting called term word sagte schrieb zitat wort dit écrit mot dijo escribió palabra cita".split())
FEATURES = ("hits", "terms", "misspelt", "density", "window", "quoted", "mass")
_STEMS = (4, 5, 6)


class LexiconAutomaton:
    """Levenshtein automata of one edit intersected with a lexicon trie, as a lazily built deterministic automaton.

    match(word) is (weight, edits) of the best lexicon entry, or None. Entries of five letters and more allow one edit after
    their first letter; a stem matches, without edits, every word that begins with it.
    """

    def __init__(self, terms: dict[str, float], stems: dict[str, float], clean: frozenset = frozenset(), max_states: int = 100_000, cache: int = 400_000):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[float | None] = [None]
        self.stem: list[float | None] = [None]
        self.depth = [0]
        self.clean, self.max_states, self.cache_limit = clean, max_states, cache
        for entries, ends in ((terms, self.term), (stems, self.stem)):
            for word, weight in entries.items():
                node = 0
                for c in word:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                        self.term.append(None)
                        self.stem.append(None)
                        self.depth.append(self.depth[node] + 1)
                    node = self.children[node][c]
                ends[node] = weight
        self._reset()
        self.cache: dict[str, tuple[float, int] | None] = {}

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.begin = self._id(frozenset([(0, 0)]))

    def _id(self, states: frozenset) -> int:
        if states not in self.ids:
            self.ids[states] = len(self.sets)
            self.sets.append(states)
            self.moves.append({})
        return self.ids[states]

    def _step(self, states: frozenset, c: str) -> frozenset:
        out = set()
        for node, edits in states:
            below = self.children[node]
            if c in below:
                out.add((below[c], edits))
                if edits == 0:  # the next letter of the entry is missing
                    out.update((n, 1) for n in self.children[below[c]].values())
            if edits == 0 and node:
                out.add((node, 1))  # a letter too many
                out.update((n, 1) for n in below.values())  # another letter
        return frozenset(out)

    def _read(self, word: str) -> tuple[float, int] | None:
        if len(self.sets) > self.max_states:
            self._reset()
        state, stem = self.begin, None
        for c in word:
            following = self.moves[state].get(c)
            if following is None:
                following = self.moves[state][c] = self._id(self._step(self.sets[state], c))
            state = following
            states = self.sets[state]
            if not states:
                break
            for node, edits in states:
                if edits == 0 and self.stem[node] is not None:
                    stem = (self.stem[node], 0)
        best = stem
        for node, edits in self.sets[state]:
            if self.term[node] is not None and (edits == 0 or self.depth[node] >= 5 and word not in self.clean):
                if best is None or (edits, -self.term[node]) < (best[1], -best[0]):
                    best = (self.term[node], edits)
        return best

    def match(self, word: str) -> tuple[float, int] | None:
        try:
            return self.cache[word]
        except KeyError:
            if len(self.cache) >= self.cache_limit:
                self.cache.clear()
            out = self.cache[word] = self._read(word)
            return out


def window_features(text: str | None, automaton: LexiconAutomaton, window: int = 8) -> list[float]:
    """FEATURES of a text; all zero when no word hits the lexicon, as for null and empty texts."""
    text = (text or "").lower()
    words = _WORD.findall(text)
    match = automaton.match
    hits = [(i, m) for i, m in enumerate(map(match, words)) if m is not None]
    if not hits:
        return [0.0] * len(FEATURES)
    at = [m.start() for m in _WORD.finditer(text)]
    abuse, quoted, misspelt, mass, terms, places = 0.0, 0.0, 0.0, 0.0, set(), []
    for i, (weight, edits) in hits:
        line = text.rfind("\n", 0, at[i]) + 1
        inside = len(_QUOTES.findall(text, line, at[i])) % 2 == 1 and _QUOTES.search(text, at[i], at[min(i + window, len(at) - 1)] + 1) is not None
        share = 0.05 if inside else 0.5 if not REPORTING.isdisjoint(words[max(0, i - window) : i + window]) else 1.0
        quoted += 1 - share
        abuse += share
        misspelt += share * edits
        mass += share * weight
        if share > 0.4:
            terms.add(words[i])
            places.append(i)
    near = max((j - k + 1 for k, j in zip(range(len(places)), np.searchsorted(places, np.asarray(places) + window, side="right") - 1)), default=0)
    return [float(np.log1p(abuse)), float(np.log1p(len(terms))), float(np.log1p(misspelt)), min(1.0, 20 * abuse / len(words)), float(np.log1p(near)), float(np.log1p(quoted)), float(np.log1p(mass))]


@dataclass
class ToxicityModel:
    terms: dict[str, float]
    stems: dict[str, float]
    clean: frozenset = frozenset()
    weights: list[float] = field(default_factory=lambda: [0.0] * (len(FEATURES) + 1))

    def automaton(self) -> LexiconAutomaton:
        return LexiconAutomaton(self.terms, self.stems, self.clean)

    def probability(self, features: np.ndarray) -> np.ndarray:
        z = features @ np.asarray(self.weights[:-1]) + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _word_counts(batches: Iterator) -> Iterator:
    """Documents by class in which each word (stem 0) and each word beginning (stem: its letters) stands."""
    import pyarrow as pa

    for part, texts in batch_blocks(batches, "text", 8_000_000):
        counts: dict = {}
        for text, toxic in zip(texts, part.column("toxic").to_pylist(), strict=True):
            words = set(_WORD.findall((text or "").lower()))
            for key in {(w, 0) for w in words} | {(w[:k], k) for w in words for k in _STEMS if len(w) > k}:
                pair = counts.setdefault(key, [0, 0])
                pair[toxic] += 1
        if counts:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in counts]), pa.array([k[1] for k in counts], pa.int32()), pa.array([v[1] for v in counts.values()], pa.int64()), pa.array([v[0] for v in counts.values()], pa.int64())], ["term", "stem", "pos", "neg"]
            )


def _feature_rows(model: ToxicityModel, keep: list[str]):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        automaton = model.automaton()
        for part, texts in batch_blocks(batches, "text"):
            features = [window_features(t, automaton) for t in texts]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(features, pa.list_(pa.float64()))], [*keep, "features"])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column | None = None, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learn from at most ``sample`` labelled documents, chosen by a hash of their id among those where ``learn`` holds.

    Labels and texts that are null are left out. Without toxic or without clean documents the model calls nothing toxic.
    """
    chosen = labels.filter(F.col(label_col).isin(0, 1)).filter(F.lit(True) if learn is None else learn)
    chosen = chosen.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("toxic")).orderBy(F.xxhash64("_id"), "toxic").limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null")
    rows = rows.join(F.broadcast(chosen), rows.doc_id == F.col("_id")).select("text", "toxic")
    n_neg, n_pos = (rows.filter(F.col("toxic") == k).count() for k in (0, 1))
    if not n_pos or not n_neg:
        return ToxicityModel({}, {}, weights=[0.0] * len(FEATURES) + [-5.0])
    counts = map_texts(rows, _word_counts, "term string, stem int, pos long, neg long").groupBy("term", "stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counts = materialise(counts, "words")
    odds = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1))
    # so many toxic documents that no word out of exp(12) would gather them by chance
    least = max(3, int(np.ceil(12 / np.log((n_pos + n_neg) / n_pos))), n_pos // 200)
    strong = counts.withColumn("odds", odds).filter((F.col("odds") > 1.5) & (F.col("pos") >= F.when(F.col("stem") == 0, least).otherwise(3)) & (F.col("neg") * 20 <= F.col("pos")))
    # a stem stands in several words, each of which counts; or a rare word in a few copies would make one
    words = counts.filter("stem = 0 and pos > 0").select("term", "pos", F.explode(F.array(*map(F.lit, _STEMS))).alias("stem")).filter(F.length("term") > F.col("stem"))
    several = words.groupBy(F.expr("substring(term, 1, stem)").alias("term"), "stem").agg(F.count(F.lit(1)).alias("words"), F.sum("pos").alias("stands")).filter((F.col("words") >= 4) & (F.col("stands") >= 2 * least))
    strong = strong.filter("stem = 0").unionByName(strong.join(several.select("term", "stem"), ["term", "stem"], "left_semi"))
    best = strong.orderBy(F.desc(F.col("pos") * F.col("odds")), "term", "stem").limit(LEXICON).collect()
    stems = {r.term: float(r.odds) for r in best if r.stem}
    terms = {r.term: float(r.odds) for r in best if not r.stem}
    model = ToxicityModel(terms, stems)
    clean = counts.filter("stem = 0 and neg > 0 and pos <= 3 * neg").select("term", "neg").mapInArrow(_fuzzy_words(model), "term string, neg long")
    model.clean = frozenset(r.term for r in clean.orderBy(F.desc("neg"), "term").limit(CLEAN).collect())
    learned = map_texts(rows, _feature_rows(model, ["toxic"]), "toxic int, features array<double>").collect()
    model.weights = _logistic(np.array([r.features for r in learned]), np.array([r.toxic for r in learned], float))
    return model


def _fuzzy_words(model: ToxicityModel):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        automaton = model.automaton()
        for part in batches:
            hit = [(m := automaton.match(w)) is not None and m[1] > 0 for w in part.column("term").to_pylist()]
            yield part.filter(pa.array(hit, pa.bool_()))

    return run


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> list[float]:
    """Newton's method with an L2 penalty on all but the constant; weights never count a quotation as abuse."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.diag([*([penalty] * (x.shape[1] - 1)), 1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    w[FEATURES.index("quoted")] = min(w[FEATURES.index("quoted")], 0.0)
    return w.tolist()


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, score (0 to 1), predicted (1 if score >= 0.5), features.

    Null and empty texts get the score of a text without hits. Repeated rows and null ids are scored like others; an empty
    table gives no rows; other columns are not read. Nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in _feature_rows(model, ["doc_id"])(batches):
            features = np.array(part.column("features").to_pylist(), float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.probability(features)), part.column("features")], ["doc_id", "score", "features"])

    scored = map_texts(rows, run, "doc_id long, score double, features array<double>")
    return scored.select("doc_id", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "features")


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the model calls toxic; all columns stay and nothing is shuffled."""
    fields, columns = docs.schema, docs.columns

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        automaton = model.automaton()
        for part, texts in batch_blocks(batches, text_col):
            features = np.array([window_features(t, automaton) for t in texts], float).reshape(-1, len(FEATURES))
            yield part.filter(pa.array(model.probability(features) < 0.5))

    return map_texts(docs.select(*columns), run, fields)
