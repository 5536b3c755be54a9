"""The registered queries of this package: each applies one operator, with
production parameters, to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import UrlRule, filter_urls

    rules = (
        UrlRule("block", "com/en/"),
        UrlRule("allow", "example.com/en/7"),
        UrlRule("allow", "net/de/"),
        UrlRule("block", "example.net/de/8"),
        UrlRule("block", "org/es/"),
    )
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict", "url_score")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_pages

    bounded_batches(spark)
    out = extract_pages(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge_documents

    bounded_batches(spark)
    return judge_documents(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_duplicates

    bounded_batches(spark)
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    bounded_batches(spark)
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines, file_batches

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs, file_batches(docs, 4))
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return out.select("doc_id", F.col("__line_n").alias("n_lines"), F.col("__line_dropped").alias("n_dropped"), sha.alias("kept_sha256"))


OP6_SQL = r"""
WITH lines AS (
  SELECT rowid AS r, doc_id, unnest(split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(split(coalesce(text, ''), chr(10)), 1) AS k
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10
), marked AS (
  SELECT keyed.*, common.key IS NOT NULL AS gone FROM keyed LEFT JOIN common ON keyed.key = common.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import digest_documents

    bounded_batches(spark)
    return digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica of the archive of all pages in which every record whose
    id leaves 13 modulo 97 has another first byte."""
    from .warc import audit, layout

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    damaged = (F.col("page_id") % 97 == 13) & (F.octet_length(F.substring("html", 1, 1)) == 1) & (F.substring("html", 1, 1) != "#")
    replica = pages.withColumn("html", F.when(damaged, F.concat(F.lit("#"), F.expr("substring(html, 2)"))).otherwise(F.col("html")))
    found = audit(materialise(layout(pages), "layout"), materialise(layout(replica), "layout"))
    return found.select("file", "place", "start", "stop", F.col("record_id").alias("page_id"), "copy", "sha256", "status")


OP8_SQL = r"""
WITH body AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
         coalesce(page_id % 97 = 13 AND strlen(substr(html, 1, 1)) = 1 AND substr(html, 1, 1) <> '#', false) AS damaged
  FROM pages
), record AS (
  SELECT page_id, damaged, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10)
    || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html)::VARCHAR || chr(13) || chr(10) || chr(13) || chr(10)
    || html || chr(13) || chr(10) || chr(13) || chr(10) AS r
  FROM body
), hashed AS (
  SELECT page_id, damaged, strlen(r) AS size, sha256(r) AS sha256,
         row_number() OVER (PARTITION BY page_id, sha256(r)) - 1 AS copy
  FROM record
), dealt AS (
  SELECT *, ('0x' || substr(md5(coalesce(page_id::VARCHAR, '') || '/' || copy::VARCHAR), 1, 8))::BIGINT
            % greatest(1, (SELECT (count(*) + 999) // 1000 FROM pages)) AS file
  FROM hashed
), placed AS (
  SELECT *, row_number() OVER w - 1 AS place, CAST(sum(size) OVER w AS BIGINT) AS stop
  FROM dealt WINDOW w AS (PARTITION BY file ORDER BY page_id NULLS FIRST, sha256, copy ROWS UNBOUNDED PRECEDING)
)
SELECT file, place, stop - size AS start, stop, page_id, copy, sha256, CASE WHEN damaged THEN 'changed' ELSE 'intact' END AS status
FROM placed
"""


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 20 = 0"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_documents

    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


QUERIES: dict[str, Query] = {
    "op1_url_filter": op1_url_filter,
    "op2_html_extract": op2_html_extract,
    "op3_quality_cascade": op3_quality_cascade,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_line_dedup": op6_line_dedup,
    "op7_bpe": op7_bpe,
    "op8_warc_fixity": op8_warc_fixity,
    "op9_ann": op9_ann,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op6_line_dedup": OP6_SQL,
    "op8_warc_fixity": OP8_SQL,
}
