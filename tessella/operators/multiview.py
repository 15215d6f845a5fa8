"""Frames of several views of one sample on a common grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def multiview_frames(views: DataFrame, order: list[str], count: int, factor: int = 1, prefixes: dict[str, str] | None = None, merge: bool = False) -> DataFrame:
    """(sample, problem, fps, frame_ids, captions, view_indices): the frames to take from every view of a sample.

    ``views`` has (sample, view, start, frames, fps, caption): each view's window of frames.  All views of ``order`` must be there
    once, at one frame rate, and their windows begin at the same frame; ``merge`` takes instead the frames that all windows share, from the
    latest start to the earliest end.  ``count`` frames, ``factor`` apart, must fit.  ``problem`` names the first rule that a
    sample breaks, and then it has no frames; else it is null.  Captions come in the order of views, led by the view's prefix.
    One aggregation by sample: a sample has as many rows as views.
    """
    place = F.create_map(*[F.lit(x) for k, v in enumerate(order) for x in (v, k)])
    words = F.create_map(*[F.lit(x) for v in order for x in (v, (prefixes or {}).get(v, ""))])
    own = views.where(F.col("view").isin(order)).select("sample", place[F.col("view")].alias("at"), "start", (F.col("start") + F.col("frames")).alias("end"), "fps", F.trim(F.concat_ws(" ", words[F.col("view")], "caption")).alias("caption"))
    met = own.groupBy("sample").agg(
        F.count("*").alias("n"),
        F.count_distinct("at").alias("kinds"),
        F.min("fps").alias("fps"),
        F.max("fps").alias("fps_most"),
        F.min("start").alias("first"),
        F.max("start").alias("latest"),
        F.min("end").alias("end"),
        F.array_sort(F.collect_list(F.struct("at", "caption"))).alias("said"),
    )
    problem: Column = (
        F.when(F.col("kinds") < len(order), "a view is missing")
        .when(F.col("n") > F.col("kinds"), "a view is there twice")
        .when(F.col("fps") != F.col("fps_most"), "frame rates differ")
        .when(F.lit(not merge) & (F.col("first") != F.col("latest")), "frames differ")
        .when(F.col("latest") + (count - 1) * factor >= F.col("end"), "too few frames")
    )
    fine = F.col("problem").isNull()
    ids = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.col("latest") + k * factor)
    return met.withColumn("problem", problem).select(
        "sample",
        "problem",
        F.when(fine, F.col("fps")).alias("fps"),
        F.when(fine, ids).alias("frame_ids"),
        F.when(fine, F.transform("said", lambda s: s["caption"])).alias("captions"),
        F.when(fine, F.transform("said", lambda s: s["at"])).alias("view_indices"),
    )
