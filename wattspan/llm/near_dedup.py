"""Near-duplicate documents by MinHash bands, odd sketches and an exact check on full shingle sets.

1. Each document's distinct five-word shingles give 160 MinHash samples: 32 bands of five, and an odd sketch, a bitmap of
   1024 parities in which every sample flips one bit.
2. Documents with the same words collapse to one representative, so copies cost a row a task.
3. Every representative is compared with the most central member, the leader, of each band that it shares: sizes decide
   first, then the XOR population count of the two odd sketches, which estimates their similarity, then full shingle sets.
4. A band whose other members still lie in several components is open. Two members of it can only be linked if their sets
   agree in all but a few shingles, so they share one of their rarest. Members of open bands meet on these (see
   ``_open_pairs``); sketches and full sets decide again. Nothing is compared that cannot be linked, so a large group of
   texts around the threshold costs rows in proportion to its size, and no pair that shares a band is left out.

A pair at similarity 0.85 shares no band with a probability below 1e-8; the sketch refuses it below 1e-15.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattspan.llm.common import HOT_SHARE, batch_blocks, components, discard, join_by_key, key_filter, map_texts, materialise, with_passes, without
from wattspan.llm.segments import Words, hash_ranges, hash_runs, mix

SHINGLE, SAMPLES, ROWS, BITS = 5, 160, 5, 1024
FEATURES = "doc_id long, x long, c int, n_shingles long, k1 long, k2 long, bands array<long>, sketch array<long>"
SETS = "rep long, shingles array<long>"
#: Sketches that differ in more bits belong to pairs of an estimated similarity below 0.6.
MAX_XOR = int(BITS / 2 * (1 - np.exp(-4 * SAMPLES * 0.4 / BITS)))
#: Sets of at most so many shingles are broadcast where they stand in very many pairs.
BROADCAST_SET = 2_000
#: The bands miss a pair at this similarity in hundredths with a probability of 3e-6, one at 70 with 0.3 %, one at 60 with 7 %.
LEAST_PERCENT = 80
#: Parts over which the postings of one shingle are spread where they meet.
SALTS = 8

_RNG = np.random.default_rng(20240607)
_MULTIPLY = (_RNG.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * 2 + 1)[:, None]
_FLIP = _RNG.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)[:, None]
_SAMPLE = np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_ROW = _RNG.integers(0, 1 << 63, (SAMPLES // ROWS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def document_shingles(words: Words, n: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text of a block its distinct hashes of n words, sorted; a text of fewer words has one of all its words."""
    hashes = hash_ranges(words.data, words.starts, words.ends)[0]
    runs = hash_runs(hashes, n).view(np.int64)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        yield np.unique(runs[a : b - n + 1]) if b - a >= n else hash_runs(hashes[a:b], b - a).view(np.int64) if b > a else runs[:0]


def minhash(shingles: np.ndarray) -> np.ndarray:
    """160 uint32 samples of a shingle set that is not empty."""
    x = (shingles.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    out = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(out, (((x[i : i + 1024] ^ _FLIP) * _MULTIPLY)).min(axis=1), out=out)
    return out


def bands(samples: np.ndarray) -> np.ndarray:
    return mix((samples.reshape(-1, ROWS).astype(np.uint64) * _ROW).sum(axis=1, dtype=np.uint64)).view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """16 longs of parities: each sample flips the bit that its index and value hash to."""
    bit = mix(samples.astype(np.uint64) + _SAMPLE) >> np.uint64(64 - BITS.bit_length() + 1)
    return np.packbits((np.bincount(bit.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def lists(values: list[np.ndarray]):
    import pyarrow as pa

    offsets = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *values])))


def _features(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for part, texts in batch_blocks(batches, "text"):
        words, n, own_bands, sketches = Words(texts, fold=True), [], [], []
        for shingles in document_shingles(words):
            n.append(len(shingles))
            samples = minhash(shingles) if len(shingles) else None
            own_bands.append(bands(samples) if len(shingles) else shingles)
            sketches.append(odd_sketch(samples) if len(shingles) else shingles)
        yield pa.RecordBatch.from_arrays(
            [*(part.column(x) for x in ("doc_id", "x", "c")), pa.array(n, pa.int64()), *map(pa.array, words.keys()), lists(own_bands), lists(sketches)],
            ["doc_id", "x", "c", "n_shingles", "k1", "k2", "bands", "sketch"],
        )


def _sets(batches: Iterator) -> Iterator:
    import pyarrow as pa

    seen: set[int] = set()
    for part, texts in batch_blocks(batches, "text"):
        # rows that repeat id and text meet in a task
        new = [i for i, rep in enumerate(part.column("rep").to_pylist()) if not (rep in seen or seen.add(rep))]
        own = list(document_shingles(Words([texts[i] for i in new], fold=True)))
        yield pa.RecordBatch.from_arrays([part.column("rep").take(pa.array(new, pa.int64())), lists(own)], ["rep", "shingles"])


def differ(x: str, y: str) -> Column:
    """Bits in which two odd sketches differ."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, n: s + n)


@dataclass(frozen=True)
class Method:
    """How candidate pairs are found and refused before full sets decide; shared by the joins on shingle sets."""

    #: mapInArrow functions from texts to features and to full sets, with their schemas.
    features: Callable
    features_schema: str
    sets: Callable
    sets_schema: str
    #: Columns of a feature row that a representative keeps.
    columns: tuple[str, ...]
    #: (band, m, rep, n_shingles) of the representatives (reps, discarding nothing) that share a band with m - 1 others.
    placed: Callable[[DataFrame], DataFrame]
    #: (rep, fact) from reps and sets, and the condition on fact_a and fact_b that every linked pair meets.
    facts: Callable[[DataFrame, DataFrame], DataFrame]
    close: Callable[[int], Column]


def _with_facts(pairs: DataFrame, facts: DataFrame, total: int) -> DataFrame:
    """pairs (a, b) with the fact (rep, fact) of both sides, as fact_a and fact_b; a leader, a, may stand in very many pairs.

    Facts with many values are not broadcast, however often they are asked for.
    """
    of = lambda side: facts.select(F.col("rep").alias(side), F.col("fact").alias(f"fact_{side}"))
    often = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("w"))
    leaders = of("a").join(often, "a").withColumn("w", F.when(F.size("fact_a") <= BROADCAST_SET, F.col("w")).otherwise(0))
    return join_by_key(pairs.join(of("b"), "b"), leaders, ["a"], "w", total).drop("w")


def _links(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, method: Method) -> DataFrame:
    """The distinct pairs (a, b) whose sets reach the similarity: sketches first, then whole sets."""
    near = _with_facts(pairs, method.facts(reps, sets), pairs.count()).filter(method.close(percent)).select("a", "b")
    near = materialise(near, "near")
    full = _with_facts(near, sets.select("rep", F.col("shingles").alias("fact")), near.count())
    both = F.size(F.array_intersect("fact_a", "fact_b"))
    linked = materialise(full.filter(both * (100 + percent) >= (F.size("fact_a") + F.size("fact_b")) * percent).select("a", "b"), "linked")
    discard(near)
    return linked


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, and two hashes of the text: rows that are equal in id and text are one document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text).alias("x"), F.hash(text).alias("c"))


def _numbered(reps: DataFrame) -> DataFrame:
    """reps with ``rep``, a number of their own in order of id: the id where ids tell all apart, else a place in that order.

    Null ids come last. Different texts can share an id, or have none.
    """
    if reps.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("id is null or n > 1").isEmpty():
        return reps.withColumn("rep", F.col("id"))
    order = reps.select("id", "k1", "k2").orderBy(F.asc_nulls_last("id"), "k1", "k2").select("k1", "k2", F.monotonically_increasing_id().alias("rep"))
    return materialise(reps.join(materialise(order, "order"), ["k1", "k2"]), "numbered")


def judged(source: DataFrame, percent: int, method: Method) -> DataFrame:
    """doc_id, x, c, n_shingles, component_id and kept of each row of ``source`` (see keyed)."""
    features = materialise(map_texts(source, method.features, method.features_schema), "features")
    same = features.filter("n_shingles > 0").groupBy("k1", "k2")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "x", "c")).alias("first")
    reps = same.agg(first, F.count(F.lit(1)).alias("size"), *(F.any_value(c).alias(c) for c in ("n_shingles", *method.columns)))
    own = [F.col(f"first.{c}").alias(n) for c, n in (("doc_id", "id"), ("x", "x"), ("c", "c"))]
    reps = _numbered(materialise(reps.select("k1", "k2", "size", "n_shingles", *method.columns, *own), "reps"))
    roots = _roots(source, reps, percent, method)
    # a component is named by its root's id; the root's first row is the one that stays
    named = roots.join(reps.select(F.col("rep").alias("root"), F.col("id").alias("root_id")), "root").select("node", "root", "root_id")
    keyed = reps.join(named, reps.rep == named.node, "left").select(
        "k1", "k2", "size", F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("root_id")).alias("component_id"),
        F.coalesce(F.col("root") == F.col("rep"), F.lit(True)).alias("is_root"), F.col("id").alias("own_id"), F.col("x").alias("own_x"), F.col("c").alias("own_c"),
    )
    out = join_by_key(features.filter("n_shingles > 0").select("doc_id", "x", "c", "n_shingles", "k1", "k2"), keyed, ["k1", "k2"], "size", features.count())
    stays = F.col("is_root") & F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("x") == F.col("own_x")) & (F.col("c") == F.col("own_c"))
    out = out.select("doc_id", "x", "c", "n_shingles", "component_id", stays.alias("kept"))
    return out.unionByName(features.filter("n_shingles = 0").select("doc_id", "x", "c", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))


def _check(percent: int) -> None:
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent must be {LEAST_PERCENT} to 100")


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are runs without ASCII white space, A-Z lower-cased. A document's set is its distinct five-word shingles, or its
    whole word sequence if that is shorter. Documents are linked where 100 * intersection >= percent * union; component_id is the
    smallest id reachable, and the document of that id is kept. Null, empty and blank texts have no shingles, are linked with
    nothing and are kept. Rows that share an id but not their text, or have a null id, are documents of their own; a null id
    takes the smallest other id of its component, or stays null, and is kept only where no row with an id is linked. Rows
    that repeat both id and text are one document. An empty table gives no rows; other columns are not read. ``percent`` is
    80 to 100; below, the bands would lose links, so ValueError is raised.
    """
    _check(percent)
    return judged(keyed(docs, id_col, text_col), percent, MINHASH).select("doc_id", "n_shingles", "component_id", "kept")


def _in_shared_bands(reps: DataFrame) -> DataFrame:
    banded = reps.select("rep", "n_shingles", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    return join_by_key(banded, shared, ["band"], "m", reps.count() * (SAMPLES // ROWS))


#: MinHash bands and odd sketches.
MINHASH = Method(
    _features, FEATURES, _sets, SETS, ("bands", "sketch"), _in_shared_bands,
    lambda reps, sets: reps.select("rep", F.col("sketch").alias("fact")), lambda percent: differ("fact_a", "fact_b") <= MAX_XOR,
)


def _leader_pairs(placed: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(band, m, rep, leader) of the members of shared bands, and the pairs (a, b) of leaders and members whose sizes allow a link."""
    # a text that shares most with most others is central: its edits, if any, are fewest
    central = placed.groupBy("rep").agg(F.sum("m").alias("ties"))
    best = placed.join(central, "rep").groupBy("band", "m").agg(F.max_by(F.struct("rep", "n_shingles"), F.struct("ties", -F.col("rep"))).alias("best"))
    leaders = best.select("band", F.col("m").alias("rows"), F.col("best.rep").alias("leader"), F.col("best.n_shingles").alias("size"))
    members = materialise(join_by_key(placed, leaders, ["band"], "rows", placed.count()).filter("rep <> leader").drop("rows"), "members")
    discard(placed)
    fits = F.least("n_shingles", "size") * 100 >= F.greatest("n_shingles", "size") * percent
    pairs = materialise(members.filter(fits).select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    return members, pairs


def _several(groups: DataFrame, key: str, count: str) -> DataFrame:
    """The keys whose rows lie in more than one component."""
    found = groups.groupBy(key).agg(F.count(F.lit(1)).alias(count), F.min("comp").alias("lo"), F.max("comp").alias("hi_comp"))
    return found.filter("lo <> hi_comp").drop("lo", "hi_comp")


def _postings(sets: DataFrame, percent: int) -> DataFrame:
    """(s, rep, comp, n, most) of those shingles of each set by which a link can be found first.

    Sets are put in order of rarity. Where the first shingle that two sets share stands at position k in one of n shingles,
    they share at most n - k, so the other has at most ``most`` shingles if they are linked. Shingles of one set alone share
    nothing and only move the others back; shingles too far back to leave a partner of any size are left out.
    """
    total = sets.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0))).first()[0]
    often = sets.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    often = materialise(often, "often")
    # shingles of more than one in HOT_SHARE places are few: each set looks its own up; all others are joined
    hot = often.filter(F.col("df") * HOT_SHARE > total).collect()
    names, counts = (F.lit([r[c] for r in hot]).cast("array<long>") if hot else F.array().cast("array<long>") for c in ("s", "df"))
    cold = F.filter("shingles", lambda x: ~F.array_contains(names, x))
    rare = sets.select("rep", F.explode(cold).alias("s")).join(often.filter(F.col("df") * HOT_SHARE <= total), "s").groupBy("rep").agg(F.collect_list(F.struct("df", "s")).alias("rare"))
    none = F.array().cast("array<struct<df:bigint,s:bigint>>")
    frequent = F.transform(F.array_intersect("shingles", names), lambda x: F.struct(F.get(counts, F.array_position(names, x).cast("int") - 1).alias("df"), x.alias("s")))
    ranked = sets.join(rare, "rep", "left").select("rep", "comp", F.size("shingles").alias("n"), F.array_sort(F.concat(F.coalesce("rare", none), frequent)).alias("l"))
    own = F.col("n") - F.size("l")
    reach = F.floor(F.col("n") * (100 - percent) / 100) + 1 - own
    placed = ranked.filter(reach > 0).select("rep", "comp", "n", own.alias("own"), F.posexplode(F.slice("l", 1, reach.cast("int"))).alias("i", "t"))
    most = F.floor((F.col("n") - F.col("own") - F.col("i")) * (100 + percent) / percent).cast("long") - F.col("n")
    out = materialise(placed.select("t.s", "rep", "comp", F.col("n").cast("long").alias("n"), most.alias("most")), "postings")
    discard(often)
    return out


def _open_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets of different components that can reach the similarity; sets: rep, comp, shingles.

    Two postings of a shingle fit if each has at most as many shingles as the other allows. First the postings go that no
    posting of the shingle fits, by the largest ``most`` of each size (their number is bounded by sizes, not by postings);
    then, in each shingle that still has several components, all components but the largest meet all postings.
    """
    postings = _postings(sets, percent)
    by_size = postings.groupBy("s", "n").agg(F.max("most").alias("most"), F.count(F.lit(1)).alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    sizes = by_size.groupBy("s").agg(F.collect_list(F.struct("n", "most", "df")).alias("sizes"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo <> hi")
    fitting = lambda x: F.transform(F.filter("sizes", lambda y: (y["most"] >= x["n"]) & ((y["n"] != x["n"]) | (y["df"] > 1))), lambda y: y["n"])
    least = sizes.select("s", F.explode(F.transform("sizes", lambda x: F.struct(x["n"].alias("n"), x["df"].alias("df"), F.array_min(fitting(x)).alias("least")))).alias("z")).select("s", "z.*")
    fit = materialise(join_by_key(postings, least.filter("least is not null"), ["s", "n"], "df", postings.count()).filter("most >= least").drop("df", "least"), "fit")
    discard(postings)

    by_component = fit.groupBy("s", "comp").agg(F.count(F.lit(1)).alias("w"))
    largest = by_component.groupBy("s").agg(F.max_by("comp", F.struct("w", -F.col("comp"))).alias("largest"), F.count(F.lit(1)).alias("comps"), F.sum("w").alias("df")).filter("comps > 1")
    meet = materialise(join_by_key(fit, largest, ["s"], "df", fit.count()).drop("df", "comps"), "meet")
    discard(fit)
    all_ = meet.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int"))
    few = meet.filter("comp <> largest").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    once = (F.col("o.comp") == F.col("o.largest")) | (F.col("f.rep") < F.col("o.rep"))
    fits = (F.col("f.comp") != F.col("o.comp")) & (F.col("f.n") <= F.col("o.most")) & (F.col("o.n") <= F.col("f.most"))
    same = (F.col("f.s") == F.col("o.s")) & (F.col("f.salt") == F.col("o.salt"))
    pairs = few.alias("f").join(all_.alias("o"), same & fits & once).select(F.least("f.rep", "o.rep").alias("a"), F.greatest("f.rep", "o.rep").alias("b"))
    out = materialise(pairs.distinct(), "pairs")
    discard(meet)
    return out


def _roots(source: DataFrame, reps: DataFrame, percent: int, method: Method) -> DataFrame:
    """(node, root) of the representatives that are linked with others."""
    members, pairs = _leader_pairs(materialise(method.placed(reps), "placed"), percent)
    # full sets are needed of all that are compared, now or later
    often = members.groupBy("band").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("band")
    open_ = members.join(often, "band", "left_semi").select("rep")
    involved = pairs.select(F.col("b").alias("rep")).unionByName(pairs.select(F.col("a").alias("rep"))).unionByName(open_).distinct()
    involved = materialise(involved.join(reps.select("rep", "id", F.col("x").alias("rx"), F.col("c").alias("rc")), "rep"), "involved")
    keys = key_filter(involved, F.xxhash64("id", "rx", "rc"))
    texts = with_passes(source.withColumn("key", F.xxhash64("doc_id", "x", "c")), keys, "key").filter("passes")
    own = texts.doc_id.eqNullSafe(F.col("id")) & (texts.x == F.col("rx")) & (texts.c == F.col("rc"))
    sets = materialise(map_texts(texts.join(involved.hint("shuffle_hash"), own).select("rep", "text"), method.sets, method.sets_schema), "sets")
    links = _links(pairs, reps, sets, percent, method)
    discard(pairs, involved)

    roots = components(links)
    comp = F.coalesce("v", "rep").alias("comp")
    placed = members.join(roots, F.col("rep") == F.col("u"), "left").select("band", "rep", comp)
    open_bands = materialise(_several(placed, "band", "m"), "open")
    open_reps = join_by_key(placed, open_bands, ["band"], "m", members.count()).select("rep", "comp").distinct()
    pairs = _open_pairs(sets.select("rep", "shingles").join(open_reps, "rep"), percent)
    found = _links(pairs, reps, sets, percent, method)
    if not found.isEmpty():
        more = components(links.unionByName(found))
        discard(roots)
        roots = more
    discard(members, open_bands, pairs, sets, links, found)
    return roots.select(F.col("u").alias("node"), F.col("v").alias("root"))


def keep_representatives(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that a smaller id's component holds. Rows that repeat both a kept id and text all stay.

    Null, empty and blank texts stay, with or without an id; an empty table stays empty.
    """
    _check(percent)
    dropped = materialise(judged(keyed(docs, id_col, text_col), percent, MINHASH).filter("not kept").select("doc_id", "x", "c").distinct(), "dropped")
    text = F.coalesce(F.col(text_col), F.lit(""))
    return without(docs, dropped, [F.col(id_col).cast("long"), F.xxhash64(text), F.hash(text)])
