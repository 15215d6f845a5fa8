"""Queries that run a stream over the event files to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.registry import query
from tessella.shared import new_path
from tessella.streaming import stream as S


@query("ss1_windowed_stream", "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def ss1(spark, sf):
    """Hourly counts by the streaming engine; the result table is complete after the last batch."""
    out = new_path(spark, "out")
    S.run_available(S.windowed_counts(S.events(spark, f"{sf}/events.parquet")), out, new_path(spark, "state"), "complete")
    rows = spark.read.parquet(out)
    return rows.select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("ss3_stateful_chunks", "SELECT user_id, count(*) // 12 AS chunks FROM events GROUP BY 1 HAVING count(*) >= 12")
def ss3(spark, sf):
    out = new_path(spark, "out")
    S.run_available(S.chunk_counts(S.events(spark, f"{sf}/events.parquet")), out, new_path(spark, "state"))
    return spark.read.schema("user_id long, chunks long").parquet(f"{out}/batch=*").groupBy("user_id").agg(F.sum("chunks").alias("chunks"))
