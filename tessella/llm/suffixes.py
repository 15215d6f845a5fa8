"""Suffix-level dedup on bytes: repeats found among sampled suffixes and carried to all others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.repeats import remove_repeats


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of at least 50 bytes, removed from all ``documents`` but the one with the smallest id."""
    rows = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), "bytes", 50, keep_text=False)
    return rows.selectExpr("doc_id", "n_tokens AS n_bytes", "n_removed", "n_spans", "kept_sha256")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, CAST(strlen(h) / 2 AS BIGINT) - 49)) AS i FROM d)),
r AS (SELECT doc_id, i FROM g JOIN (SELECT g, min(doc_id) AS least FROM g GROUP BY g) USING (g) WHERE doc_id > least),
s AS (SELECT doc_id, i, sum(CASE WHEN i - before <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r)),
m AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM s GROUP BY ALL),
o AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM m),
k AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS tail, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) AS head FROM o JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(strlen(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
