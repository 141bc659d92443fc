"""Secret scans with corpus-wide ownership frequency, in DataFrame operations alone.

Base kinds (assign, access, hex) are found by their patterns. The method adds candidates of other shapes (vendor
prefixes, key blocks, tokens of three parts) and judges every candidate value by who owns it: values are hashed and
counted by distinct repositories and distinct owners over the corpus (``repository_col`` and ``owner_col``; documents
know only their source, which stands for both by default). A value that many owners carry is an example; one that few
owners carry, in however many repositories of theirs, is live unless it is a placeholder (a key block without a body, or
a value without digits that repeats a few letters) or plain words, as prose has them behind "token:". How many owners are few
grows with the logarithm of all owners of the corpus.

A key block reaches from its BEGIN to its END line; if no END line follows, as far as lines of base64 go. Its body without
line breaks and indents is what is counted.

Positions come from split and regexp_extract_all with the same pattern: gaps and matches alternate, so running sums of
their lengths are the offsets, in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattspan.llm.common import join_by_key, key_filter, materialise, with_passes

#: The base patterns, then the added shapes, in the order in which spans of one start are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
VENDOR = r"(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|sk-|AIza|ya29\.|npm_|SG\.)[A-Za-z0-9_.-]{16,}"
_BEGIN, _END = r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY(?: BLOCK)?-----", r"-----END [A-Z ]{0,24}PRIVATE KEY(?: BLOCK)?-----"
#: Possessive groups run without recursion, so a body can have any length.
_CLOSED = rf"[^-]*+(?:-(?!----)[^-]*+)*+{_END}"
_BREAKS = r"""(?:[\s"'+,>#*]|\\[nrt])*+"""
_OPEN = rf"(?:{_BREAKS}(?:Proc-Type|DEK-Info|Version|Comment|Hash):[^\n\\]*+)*+(?:{_BREAKS}[A-Za-z0-9+/]{{16,}}+={{0,2}}+)*+(?:{_BREAKS}[A-Za-z0-9+/]{{1,15}}+={{1,2}}+)?+"
KEY_BLOCK = rf"{_BEGIN}(?:{_CLOSED}|{_OPEN})"
JWT = r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
KINDS = ("assign", "access", "hex", "vendor", "keyblock", "jwt")
_PATTERNS = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, VENDOR, KEY_BLOCK, JWT)))
#: A value without digits is a placeholder if it has fewer different letters behind its prefix.
LETTERS = 4
_PREFIX = r"^(?:AKIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|sk-|AIza|ya29\.|npm_|SG\.)"
#: Up to two words of prose with punctuation between or behind them: letters of one case, or with a capital first.
_WORD = r"(?:[A-Za-z][a-z]{0,10}|[A-Z]{1,11})"
_PLAIN = rf"^{_WORD}(?:[-_./+=]+{_WORD})?[-_./+=]*$"
#: Matches of a text that are put in place together.
CHUNK = 256
_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _spans(text: Column, kind: str) -> Column:
    """Leftmost, non-overlapping matches of a kind as an array of (start, kind, end, value); end is exclusive."""
    pattern, order = F.lit(_PATTERNS[kind]), KINDS.index(kind)
    whole = F.regexp_extract_all(text, pattern, 0)
    value = F.regexp_extract_all(text, pattern, 2) if kind == "assign" else whole
    parts = F.zip_with(F.split(text, _PATTERNS[kind]), whole, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("size")))
    parts = F.zip_with(F.slice(parts, 1, F.size(whole)), value, lambda p, v: F.struct(p["gap"].alias("gap"), p["size"].alias("size"), v.alias("value")))
    # running sums in chunks: places within a chunk, then the chunks' own offsets, so that many matches cost no square
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / CHUNK).cast("int")), lambda i: F.slice(parts, i * CHUNK + 1, CHUNK))
    span = lambda at, p: F.struct((at + p["gap"]).alias("start"), F.lit(order).alias("kind"), (at + p["gap"] + p["size"]).alias("end"), p["value"].alias("value"))
    within = F.transform(chunks, lambda chunk: F.aggregate(
        chunk, F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out")),
        lambda s, p: F.struct((s["at"] + p["gap"] + p["size"]).alias("at"), F.concat(s["out"], F.array(span(s["at"], p))).cast(_SPAN).alias("out")),
    ))
    offsets = F.aggregate(within, F.array(F.lit(0)), lambda s, w: F.concat(s, F.array(F.element_at(s, -1) + w["at"])))
    moved = lambda w, by: F.transform(w["out"], lambda x: F.struct((x["start"] + by).alias("start"), x["kind"].alias("kind"), (x["end"] + by).alias("end"), x["value"].alias("value")))
    placed = F.flatten(F.zip_with(within, F.slice(offsets, 1, F.size(within)), moved)).cast(_SPAN)
    if kind == "assign":
        placed = F.filter(placed, lambda s: F.length(s["value"]) >= 6)
    return F.when(text.rlike(_PATTERNS[kind]), placed).otherwise(F.array().cast(_SPAN))


def _joined(spans: Column) -> Column:
    """kind:start:end, comma-joined; spans are in order."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _key_body(value: Column) -> Column:
    """The base64 of a key block, however its lines are broken, escaped or indented."""
    return F.regexp_replace(value, rf"{_BEGIN}|{_END}|(?:Proc-Type|DEK-Info|Version|Comment|Hash):[^\n\\]*+|\\[nrt]|[^A-Za-z0-9+/=]", "")


def _value_hash(span: Column) -> Column:
    """What is counted over the corpus; a key block counts by its body."""
    is_key = span["kind"] == KINDS.index("keyblock")
    return F.xxhash64(F.when(is_key, F.concat(F.lit("keyblock:"), _key_body(span["value"]))).otherwise(span["value"]))


def _looks_real(span: Column) -> Column:
    """Not a placeholder: a key block with a body, a value with a digit, or one of several different letters that isn't plain words."""
    letters = F.regexp_replace(F.lower(F.regexp_replace(span["value"], _PREFIX, "")), "[^a-z]", "")
    varied = (F.size(F.array_distinct(F.split(letters, ""))) >= LETTERS) & ~span["value"].rlike(_PLAIN)
    return F.when(span["kind"] == KINDS.index("keyblock"), _key_body(span["value"]) != "").otherwise(span["value"].rlike("[0-9]") | varied)


def _text_hashes(text_col: str) -> tuple[Column, Column]:
    """Rows that are equal in id and these are one document: its spans, and which of them are live, are the same."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.xxhash64(text), F.hash(text)


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str = "source") -> DataFrame:
    """doc_id, owner, repository, the spans of every kind in order of start, then kind, and x and c, hashes of the text. Null texts count as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    every = F.array_sort(F.concat(*[_spans(text, k) for k in KINDS]))
    named = [F.col(c).cast("string").alias(n) for c, n in ((owner_col, "owner"), (repository_col, "repository"))]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), *named, every.alias("spans"), *(h.alias(n) for h, n in zip(_text_hashes(text_col), "xc", strict=True)))


def ownership(candidates: DataFrame) -> DataFrame:
    """value_hash, rows, distinct owners and distinct repositories over the corpus. Equal values of one repository meet before they are counted."""
    values = candidates.select("owner", "repository", F.explode("spans").alias("s")).select(_value_hash(F.col("s")).alias("value_hash"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("owner", "repository")))
    each = values.groupBy("value_hash", "owner", "repository").agg(F.count(F.lit(1)).alias("rows"))
    return each.groupBy("value_hash").agg(F.sum("rows").alias("rows"), F.countDistinct("owner").alias("owners"), F.countDistinct("repository").alias("repositories"))


def owner_limit(owners: int, max_owners: int) -> int:
    """How many owners a live value can have: ``max_owners``, or one less than the binary logarithm of all owners."""
    return max(max_owners, owners.bit_length() - 2)


def scan_secrets(docs: DataFrame, max_owners: int = 2, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str = "source") -> DataFrame:
    """One row for each row of ``docs``: doc_id, found (spans with value, owners, repositories and rows of the value, and live).

    A value is live when at most ``owner_limit`` distinct owners carry it (``max_owners`` in a corpus of up to 15 owners, 3
    from 16 on, 4 from 32 on, 18 in one of a million) and it is neither placeholder nor plain words (see above); other
    values are widely copied examples or no secrets. Null and empty texts have no spans; a null owner or repository counts
    as one of its own; rows that repeat are separate documents; an empty table gives no rows; other columns are not read.
    """
    return _scanned(docs, max_owners, id_col, text_col, owner_col, repository_col).select("doc_id", "found")


def _scanned(docs: DataFrame, max_owners: int, id_col: str, text_col: str, owner_col: str, repository_col: str) -> DataFrame:
    """scan_secrets with the text's hashes x and c."""
    rows = materialise(find_candidates(docs, id_col, text_col, owner_col, repository_col).withColumn("row", F.monotonically_increasing_id()), "candidates")
    owned = materialise(ownership(rows), "owners")
    single = rows.filter(F.size("spans") > 0).select("row", F.explode("spans").alias("s")).withColumn("value_hash", _value_hash(F.col("s")))
    total = owned.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    judged = join_by_key(single, owned, ["value_hash"], "rows", total)
    everyone = rows.select(F.coalesce("owner", F.lit("")).alias("owner")).distinct().count()
    live = (F.col("owners") <= owner_limit(everyone, max_owners)) & _looks_real(F.col("s"))
    one = F.struct(*(F.col(f"s.{c}").alias(c) for c in ("start", "kind", "end", "value")), "owners", "repositories", "rows", live.alias("live"))
    found = judged.groupBy("row").agg(F.array_sort(F.collect_list(one)).alias("found"))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string,owners:bigint,repositories:bigint,rows:bigint,live:boolean>>")
    return rows.select("row", "doc_id", "x", "c").join(found, "row", "left").select("doc_id", "x", "c", F.coalesce("found", empty).alias("found"))


def digest(scanned: DataFrame) -> DataFrame:
    """The counts, the digest of the base spans, and the live and copied values of each document."""
    base = F.filter("found", lambda s: s["kind"] < 3)
    n = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda s: s["live"])).cast("long").alias("n_live"), F.size(F.filter("found", lambda s: ~s["live"])).cast("long").alias("n_example"),
    )


def redact(docs: DataFrame, mark: str = "[secret]", max_owners: int = 2, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str = "source", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with the value of every live candidate replaced by ``mark``; widely copied examples stay, no row goes.

    Values are replaced where they were found, so nothing else in a text changes; values that overlap or touch become one
    mark. Rows that share an id, or have none, are told apart by
    their texts; null and empty texts stay as they are; an empty table stays empty; other columns may have any name.
    ``length_col`` is set anew where a text changed. Only rows that may hold a live value are shuffled with their texts.
    """
    scanned = _scanned(docs, max_owners, id_col, text_col, owner_col, repository_col)
    # the value is the end of its span
    place = lambda s: F.struct((s["end"] - F.length(s["value"])).alias("start"), s["end"].alias("end"))
    values = F.array_sort(F.array_distinct(F.transform(F.filter("found", lambda s: s["live"]), place)))
    keys = F.col("doc_id").alias("of_id"), F.col("x").alias("of_x"), F.col("c").alias("of_c")
    live = materialise(scanned.select(*keys, values.alias("live")).filter(F.size("live") > 0).dropDuplicates(["of_id", "of_x", "of_c"]), "live")
    x, c = _text_hashes(text_col)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), x.alias("x"), c.alias("c")).withColumn("key", F.xxhash64("id", "x", "c"))
    rows = with_passes(rows, key_filter(live, F.xxhash64("of_id", "of_x", "of_c")), "key")
    own = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("x") == F.col("of_x")) & (F.col("c") == F.col("of_c"))
    held = rows.filter("passes").join(live, own, "left")
    whole = F.col("row").getField(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    between = lambda s, v: F.when(v["start"] > s["at"], F.concat(F.substring(whole, s["at"] + 1, v["start"] - s["at"]), F.lit(mark))).otherwise(F.when(v["start"] == 0, mark).otherwise(""))
    step = lambda s, v: F.struct(F.greatest(s["at"], v["end"]).alias("at"), F.concat(s["out"], between(s, v)).alias("out"))
    text = F.aggregate("live", start, step, lambda s: F.concat(s["out"], F.substring(whole, s["at"] + 1, F.length(whole))))
    changed = F.col("row").withField(f"`{text_col}`", text)
    if length_col in docs.columns:
        changed = changed.withField(f"`{length_col}`", F.length(text).cast(docs.schema[length_col].dataType))
    out = held.select(F.when(F.col("live").isNull(), F.col("row")).otherwise(changed).alias("row"))
    return rows.filter("not passes").select("row").unionByName(out).select("row.*")
