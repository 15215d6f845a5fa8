"""Shard planning and key-aligned sample joins."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.numbering import numbered


def manifest_rows(manifests: DataFrame, cameras: list[str] | None = None) -> DataFrame:
    """One row per shard and data key of manifests (dataset, root, data_list, data_keys, chunk_size).

    The bucket before a root is taken off; with cameras the key ``videos`` becomes one key per camera.  A dataset's
    chunk size is the first listed.
    """
    root = F.regexp_replace("root", r"^[a-z0-9]+://[^/]+/?", "")
    keys = F.col("data_keys")
    if cameras:
        views = F.array(*[F.lit(f"videos/{c}") for c in cameras])
        keys = F.flatten(F.transform(keys, lambda k: F.when(k == "videos", views).otherwise(F.array(k))))
    rows = manifests.select("dataset", root.alias("root"), "chunk_size", F.posexplode("data_list").alias("shard_no", "shard"), keys.alias("_keys"))
    return rows.select("dataset", "root", "chunk_size", "shard_no", "shard", F.explode("_keys").alias("key")).withColumn("path", F.concat_ws("/", "root", "key", "shard"))


def assign_strided(shards: DataFrame, order: str, world: int, workers: int, start: int = 0) -> DataFrame:
    """(rank, worker) of each shard in the order of a column (a path, say): strides over ranks, then workers; ``start`` skips
    shards done before.

    The list is padded to a multiple of all workers by its first shards, so that everyone gets as many.  Places come from range
    partitions and their totals (``numbered``), so no task ranks the whole list.
    """
    rows = numbered(shards, order).where(F.col("position") >= start).withColumn("position", F.col("position") - start)
    size = shards.agg(F.greatest(F.count(order) - start, F.lit(0)).alias("n")).scalar()
    rows = rows.withColumn("_n", size).withColumn("_pad", F.pmod(-F.col("_n"), F.lit(world * workers)))
    copies = F.floor((F.col("_pad") - 1 - F.col("position")) / F.col("_n")) + 1
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), copies)))).withColumn("slot", F.col("position") + F.col("_copy") * F.col("_n"))
    return rows.withColumn("rank", F.pmod("slot", F.lit(world))).withColumn("worker", F.pmod(F.floor(F.col("slot") / world), F.lit(workers))).drop("_n", "_pad", "_copy")


def equalised_workers(groups: DataFrame, workers: int) -> DataFrame:
    """Workers and shards per worker of each aspect group (aspect, n): ceil(share * workers), the largest group taking
    what is missing or over; shards per worker ceil(n / workers)."""
    every = Window.partitionBy()
    rows = groups.withColumn("_ceil", F.ceil(F.col("n") / F.sum("n").over(every) * workers))
    largest = F.row_number().over(Window.orderBy(F.desc("n"), "aspect")) == 1
    rows = rows.withColumn("workers", F.when(largest, F.lit(workers) - (F.sum("_ceil").over(every) - F.col("_ceil"))).otherwise(F.col("_ceil")).cast("long"))
    return rows.withColumn("per_worker", F.ceil(F.col("n") / F.greatest("workers", F.lit(1)))).drop("_ceil")


def assign_by_group(shards: DataFrame, group: str, order: str, workers: int) -> DataFrame:
    """Add ``worker``: the shards of each group (an aspect ratio, say) dealt one by one to its workers, in order.

    Places come from one numbering of the whole table by group and order, less the group's first, so a group that holds most
    shards is spread over ranges like any other.
    """
    rows = numbered(shards, group, order)
    first = rows.groupBy(group).agg(F.min("position").alias("_first")).withColumnRenamed(group, "_group")
    return rows.join(first, rows[group].eqNullSafe(first["_group"])).withColumn("worker", F.pmod(F.col("position") - F.col("_first"), F.lit(workers))).drop("position", "_first", "_group")


def batch_concat(inputs: DataFrame, stream: str, order: str, outputs: int, value: str) -> DataFrame:
    """(stream, batch, values): of each stream's inputs, numbered in order, output batch i merges those numbered i, i + outputs, ...

    Fewer than one output is one.
    """
    own = assign_by_group(inputs, stream, order, max(1, outputs))
    listed = F.array_sort(F.collect_list(F.struct(order, F.col(value).alias("_value"))))
    return own.groupBy(stream, F.col("worker").alias("batch")).agg(F.transform(listed, lambda x: x["_value"]).alias("values"))


def align(streams: dict[str, DataFrame], index: DataFrame | None = None) -> DataFrame:
    """N-way join of sample streams (key, value) on their keys: complete samples only, a repeated key counts once (its
    first value by ``position``), restricted to and ordered by ``index`` (key, position) where given.

    One shuffle of each stream by key; no stream is collected or broadcast.
    """
    first = Window.partitionBy("key").orderBy("position")
    once = [s.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").select("key", F.col("value").alias(name)) for name, s in streams.items()]
    rows = reduce(lambda a, b: a.join(b, "key"), once)
    return rows.join(index.groupBy("key").agg(F.min("position").alias("position")), "key") if index is not None else rows


def zip_shortest(a: DataFrame, b: DataFrame, order_a: str, order_b: str) -> DataFrame:
    """Rows of both tables paired by position, as many as the shorter has.  Positions come from range partitions and their
    totals, so no task sorts a whole table."""
    return numbered(a, order_a).join(numbered(b, order_b), "position")


def caption_chunks(frames: Column, chunk: int, target: int) -> Column:
    """(start, size) of the caption windows of a video: max(frames // chunk, 1) of them and a tail of at least half a
    chunk with more than ``target`` frames; one chunk holds all of a short video.  Too few frames give none."""
    n = F.greatest(F.floor(frames / chunk), F.lit(1))
    rest = frames - n * chunk
    whole = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.struct((i * chunk).alias("start"), F.when(frames < 2 * chunk, F.when((rest * 2 >= chunk) & (rest > target), F.lit(chunk)).otherwise(frames)).otherwise(F.lit(chunk)).cast("long").alias("size")))
    tail = F.when((rest * 2 >= chunk) & (rest > target), F.array(F.struct((n * chunk).alias("start"), rest.cast("long").alias("size")))).otherwise(F.array().cast("array<struct<start:bigint,size:bigint>>"))
    return F.when(frames >= target, F.concat(whole, tail))


def tail_windows(seconds: Column, width: float = 5.0) -> Column:
    """[start, end) seconds of fixed windows; a remainder of up to 1.5 widths stays whole, else it is split once."""
    k = F.greatest(F.lit(0), F.ceil(seconds / width - 1.5)).cast("long")
    head = F.transform(F.when(k > 0, F.sequence(F.lit(0).cast("long"), k - 1)).otherwise(F.array().cast("array<bigint>")), lambda i: F.struct((i * width).alias("start"), ((i + 1) * width).alias("end")))
    return F.when(seconds > 0, F.concat(head, F.array(F.struct((k * width).alias("start"), seconds.cast("double").alias("end")))))


def pad_multiple(n: int, of: int) -> int:
    return math.ceil(n / of) * of
