"""The corpus operators as queries over the driver tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linewatch.llm import (
    centroids, decontaminate, exact_dedup, html_extract, license_scan, line_dedup, mixing, ngram_trie, prefix_trie,
    quality, simhash, substring_dedup, token_files,
)
from linewatch.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.license_scan(table(spark, folder, "documents"))


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substring_dedup.substring_dedup(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, folder, "pages"))


def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.encode_documents(table(spark, folder, "documents"), cache_words=1_300_000)


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, folder, "documents"), short_lines=True)


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"), keep="largest")


def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    found = quality.posteriors(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.selectExpr(
        "_doc.doc_id as doc_id", "evidence", "host_rate", "path_rate", "score", f"score >= {quality.THRESHOLD} as kept"
    )


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("spans")


def op10_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed_words(table(spark, folder, "documents"))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, folder, "conversations"), family=20)


def op12_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_trie.language_model_scores(table(spark, folder, "documents"))


def op13_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.centroid_clusters(table(spark, folder, "embeddings"))


def all_queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_license_scan, op2_simhash, op3_substring_dedup, op4_html_extraction, op5_token_files, op6_line_dedup, op7_exact_dedup,
        op8_quality_classifier, op9_decontamination, op10_source_mix, op11_prefix_trie, op12_language_model,
        op13_centroid_clusters,
    )}


_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_EXACT = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

_LEAKS = f"""
WITH items AS (
  SELECT item_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS run, least(10, len(w)) AS n
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM items WHERE len(w) > 0)
), docs AS (
  SELECT doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM documents
), sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM docs, sizes WHERE len(w) >= n
), found AS (
  SELECT doc_id, p, places.n, item_id
  FROM places JOIN windows ON windows.n = places.n AND array_to_string(w[p:p + places.n - 1], ' ') = run
), hits AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM found)) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id
)
SELECT docs.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def all_sql() -> dict[str, str]:
    return {"op7_exact_dedup": _EXACT, "op9_decontamination": _LEAKS}
