"""Registered queries of this subpackage and, where SQL can express them, their statements for DuckDB."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, edit_fingerprint, exact_dedup, hard_negatives, html_text, language, licenses, line_dedup, mixing, ngram_join, packing, spelling, token_files)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return wrap


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@query()
def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract_pages(spark.read.parquet(f"{folder}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))


@query()
def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The predicted language of every document, by a model that saw no held-out one."""
    docs = _documents(spark, folder)
    model = language.fit_language_model(docs)
    told = language.identify(docs.select("doc_id", "text"), model)
    return told.select("doc_id", language.held_out("doc_id").alias("held_out"), F.col("language.pred").alias("lang_pred"),
                       F.col("language.score").alias("score"), F.col("language.rejected").alias("rejected"))


OP3_SQL = """
WITH sized AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS ord,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM src),
weighted AS (SELECT *, CAST(rk % 3 + 1 AS DOUBLE) AS weight, (source_size * 3) / CAST(rk % 3 + 1 AS DOUBLE) AS fills_at FROM ranked),
filled AS (
  SELECT *, coalesce(sum(source_size * 3) OVER (ORDER BY fills_at, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
         sum(weight) OVER (ORDER BY fills_at, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left,
         sum(source_size) OVER () AS everything
  FROM weighted),
levels AS (SELECT *, CAST(everything - full_before AS DOUBLE) / weight_left AS level FROM filled),
settled AS (SELECT *, max(CASE WHEN level <= fills_at THEN level END) OVER () AS settled FROM levels),
targets AS (SELECT source, source_size, coalesce(least(settled * weight, CAST(source_size * 3 AS DOUBLE)), CAST(source_size * 3 AS DOUBLE)) AS target FROM settled),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_at
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
counted AS (
  SELECT *, (CASE WHEN start_at * 2 + size <= target * 2 THEN 1 ELSE 0 END
           + CASE WHEN size > 0 AND source_size * 2 + start_at * 2 + size <= target * 2 THEN 1 ELSE 0 END
           + CASE WHEN size > 0 AND source_size * 4 + start_at * 2 + size <= target * 2 THEN 1 ELSE 0 END) AS copies
  FROM placed)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS INTEGER) AS copies FROM counted
"""


@query(OP3_SQL)
def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with what the curriculum takes of it, in training order of its first copy.

    Untaken documents come last by id, so that their ranges can be split as well.
    """
    docs = _documents(spark, folder).select("doc_id", "text", "source")
    placed = mixing.assign_positions(docs).select("doc_id", "mix.*")
    return (placed.orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), "doc_id")
            .select("doc_id", "size", "source_size", "target", "taken", "copies"))


@query()
def op4_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """The near-duplicate class of every document and its number of links."""
    found = ngram_join.near_classes(_documents(spark, folder).select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "class_id", F.col("links").alias("n_links"))


@query()
def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without later repeats of runs of lines."""
    return line_dedup.dedup_lines(_documents(spark, folder).select("doc_id", "text"))


@query()
def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document and what they decode to, as digests."""
    return bpe.encode_documents(_documents(spark, folder), with_ids=False)


@query()
def op7_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return edit_fingerprint.fingerprints_with_edits(_documents(spark, folder))


OP8_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY body)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.body) AS text_sha256
FROM d JOIN g ON d.body = g.body
"""


@query(OP8_SQL)
def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The group of equal texts of every document."""
    return exact_dedup.exact_groups(_documents(spark, folder))


@query()
def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Token files are written and read back: place, length and checksum of every document's ids."""
    path = token_files.write_token_files(_documents(spark, folder))
    return token_files.token_summary(spark, path)


@query()
def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every place of a document that holds a license notice."""
    return licenses.scan_licenses(_documents(spark, folder))


@query()
def op11_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document in full windows of 2,048 tokens."""
    return packing.pack_documents(_documents(spark, folder), with_ids=False)


OP12_SQL = """
WITH RECURSIVE
steps AS (SELECT n, 0 AS k, n AS v FROM range(256) r(n)
          UNION ALL SELECT n, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY n) AS t FROM steps WHERE k = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS run
  FROM documents),
kinds AS (SELECT doc_id, run, count(*) AS times FROM runs WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (
  SELECT k.*, xor(list_reduce(
      list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || run, ''),
        lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + unicode(c)::BIGINT // 64, 128 + unicode(c)::BIGINT % 64] END))),
      lambda a, b: xor(t[xor(a & 255, b) + 1]::BIGINT, a >> 8)), 4294967295) AS h
  FROM kinds k, crc),
words AS (
  SELECT word, sum(times)::BIGINT AS n
  FROM (SELECT times, CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
cut AS (SELECT word, n, i, left(word, i::INTEGER - 1) || substr(word, i::INTEGER + 1) AS less FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
shorter AS (SELECT DISTINCT c.word AS big, c.n AS big_n, w.word AS small, w.n AS small_n FROM cut c JOIN words w ON c.less = w.word),
near AS (
  SELECT big AS word, small AS near, small_n AS near_n FROM shorter UNION ALL SELECT small, big, big_n FROM shorter
  UNION ALL SELECT a.word, b.word, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.less = b.less AND length(a.word) = length(b.word) AND a.word <> b.word),
best AS (SELECT word, count(*)::BIGINT AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n)::BIGINT AS near_n FROM near GROUP BY word),
told AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 2 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 2 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
paths AS (SELECT word, word AS root FROM told UNION ALL SELECT p.word, t.form FROM paths p JOIN told t ON p.root = t.word WHERE t.form IS NOT NULL),
ends AS (SELECT p.word, p.root FROM paths p JOIN told t ON p.root = t.word WHERE t.form IS NULL)
SELECT t.word, t.form, e.root, t.n, t.n_near, t.form_n FROM told t JOIN ends e ON t.word = e.word
"""


@query(OP12_SQL)
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Words that are one edit apart, and the form and root that each is a variant of."""
    words = spelling.count_words(_documents(spark, folder), change=spelling.delete_letter(97), id_col="doc_id")
    return spelling.group_variants(words)


OP13_SQL = """
WITH used AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, c.label = a.label AS same, CAST(list_inner_product(a.vec, c.vec) AS BIGINT) AS score
  FROM used a, used c WHERE a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id) AS INTEGER) AS "rank",
       n.id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
WHERE 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
QUALIFY "rank" <= 5
"""


@query(OP13_SQL)
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector against all vectors."""
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(rows, label_col=label)
