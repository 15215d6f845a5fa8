"""Substring dedup by seed and extend on words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.repeats import remove_repeats


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of at least 50 words, removed from all ``documents`` but the one with the smallest id."""
    rows = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), "words", 50, keep_text=False)
    return rows.selectExpr("doc_id", "n_tokens AS n_words", "n_removed", "kept_sha256")


OP3_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i : i + 49], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
r AS (SELECT doc_id, i FROM g JOIN (SELECT g, min(doc_id) AS least FROM g GROUP BY g) USING (g) WHERE doc_id > least),
t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
c AS (SELECT t.*, max(r.i) OVER (PARTITION BY t.doc_id ORDER BY p) AS last FROM t LEFT JOIN r ON t.doc_id = r.doc_id AND t.p = r.i),
k AS (SELECT doc_id, p, word, coalesce(p - last < 50, false) AS gone FROM c)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id) GROUP BY w.doc_id, ws
"""
