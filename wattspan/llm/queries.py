"""One query for each operator over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattspan.llm.exact_dedup import exact_duplicates
from wattspan.llm.hard_negatives import mine_hard_negatives
from wattspan.llm.language_id import fit_language_id, identify_languages
from wattspan.llm.line_dedup import dedup_lines
from wattspan.llm.near_dedup import near_duplicates
from wattspan.llm.ngram_join import ngram_jaccard_join
from wattspan.llm.nearest import nearest_neighbours
from wattspan.llm.packing import pack_documents
from wattspan.llm.secrets import digest, scan_secrets
from wattspan.llm.sentencepiece import encode_digests
from wattspan.llm.substring_dedup import repeated_spans
from wattspan.llm.toxicity import fit_toxicity, score_toxicity
from wattspan.llm.vector_codes import compress_vectors

_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(folds: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % folds


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, _table(spark, sf_dir, "labels"), learn=_fold(5) != 0)
    return score_toxicity(docs, model).select("doc_id", F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"), keep="largest")


_SQL["op3_exact_dedup"] = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (
  SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit_language_id(docs, learn=_fold(4) != 2)
    return identify_languages(docs, model).select("doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan_secrets(_table(spark, sf_dir, "documents")))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(_table(spark, sf_dir, "documents"), run=2)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_SQL["op10_line_dedup"] = """
WITH s AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM s
), w AS (
  SELECT doc_id, pos, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM l
), r AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS n
  FROM w WHERE regexp_matches(run, '[^ \t\r\n]')
), gone AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM r CROSS JOIN (VALUES (0), (1)) AS t(k) WHERE n > 1
)
SELECT l.doc_id, count(*) AS n_lines, count(gone.pos) AS n_removed,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE gone.pos IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos
GROUP BY l.doc_id
"""


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


_SQL["op11_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 3
"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(_table(spark, sf_dir, "embeddings"))


def _round_sql(n: int) -> str:
    """The n-th assignment of all parts, and the codebook after it; the least of distance * 64 + index breaks ties."""
    return f"""
, a{n} AS (
  SELECT vec_id, label, r, t.p, t.x, min(CAST(list_inner_product(t.x, t.x) - 2 * list_inner_product(t.x, c.x) + list_inner_product(c.x, c.x) AS BIGINT) * 64 + c.e) AS best
  FROM part t JOIN c{n} c ON t.p = c.p GROUP BY ALL
), u{n} AS (
  SELECT p, best % 64 AS e, i, floor(sum(x[i]) / count(*)) AS y FROM a{n}, place WHERE i <= len(x) GROUP BY ALL
), c{n + 1} AS (
  SELECT c.p, c.e, coalesce(u.x, c.x) AS x FROM c{n} c LEFT JOIN (SELECT p, e, list(y ORDER BY i) AS x FROM u{n} GROUP BY p, e) u ON c.p = u.p AND c.e = u.e
)"""


_SQL["op12_vector_codes"] = f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q, row_number() OVER (ORDER BY vec_id) AS r
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), place AS (
  SELECT unnest(range(1, 1 + (SELECT max(len(q)) // 16 FROM v))) AS i
), part AS (
  SELECT vec_id, label, r, p, q[p * (len(q) // 16) + 1 : (p + 1) * (len(q) // 16)] AS x FROM v, (SELECT unnest(range(16)) AS p)
), c0 AS (
  SELECT p, r - 1 AS e, x FROM part WHERE r <= 64
){_round_sql(0)}{_round_sql(1)}{_round_sql(2)}
, coded AS (
  SELECT vec_id, label, r, string_agg(printf('%02x', best % 64), '' ORDER BY p) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM a2 GROUP BY ALL
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(CAST(x[i] AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) FROM c2, place) AS codebooks_sha256
FROM coded
"""


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"), percent=90).select("doc_id", "n_shingles", "component_id")


def _components_sql(words: int, percent: int) -> str:
    """Shingle sets, links by shared shingles, and the smallest id that links reach; ``judged`` has n_shingles and component_id."""
    white = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE folded AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || {white}, 'abcdefghijklmnopqrstuvwxyz     ') AS t FROM documents
), words AS (
  SELECT doc_id, list_filter(string_split(t, ' '), lambda w: w <> '') AS w FROM folded
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(len(w) - {words - 1}), lambda i: array_to_string(w[i + 1 : i + {words}], ' '))) END AS s FROM words
), member AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), distinct_sets AS (
  SELECT min(doc_id) AS rep, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)
), rep AS (
  SELECT s.doc_id, d.rep FROM sets s JOIN distinct_sets d ON list_sort(s.s) = d.s
), m AS (
  SELECT member.* FROM member JOIN rep ON member.doc_id = rep.doc_id AND rep.doc_id = rep.rep
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS shared
  FROM m a JOIN m b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) GROUP BY ALL
), link AS (
  SELECT a, b FROM common WHERE 100 * shared >= {percent} * (na + nb - shared)
), both_ways AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT a AS node, a AS other FROM both_ways UNION SELECT node, b FROM reach JOIN both_ways ON other = a
), root AS (
  SELECT node, min(other) AS root FROM reach GROUP BY node
), judged AS (
  SELECT sets.doc_id, len(sets.s) AS n_shingles, coalesce(root.root, rep.rep, sets.doc_id) AS component_id
  FROM sets LEFT JOIN rep ON rep.doc_id = sets.doc_id LEFT JOIN root ON root.node = rep.rep
)"""


_SQL["op13_ngram_join"] = _components_sql(3, 90) + " SELECT doc_id, n_shingles, component_id FROM judged"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The operators' queries, and the pipeline of the script at the repository top."""
    import corpus_pipeline

    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
