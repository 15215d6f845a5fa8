"""Driver tables as episode, step and metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(episode, base, ts, kind, value): each user's events in time order are an episode's steps, numbered from 0."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("episode"),
        (F.row_number().over(order) - 1).cast("long").alias("base"),
        "event_id",
        "ts",
        F.col("event_type").alias("kind"),
        "value",
        "props",
    )


#: The same in DuckDB, as a common table expression.
STEPS = """s AS (SELECT user_id AS episode, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS base,
 event_id, ts, event_type AS kind, value, props FROM events)"""
