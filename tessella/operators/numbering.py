"""Numbers and running sums of rows in the order of any keys: range partitions and their totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from tessella.shared import cut

#: Bits of Spark's increasing ids below the partition's number.
_BITS = 33


def _hashable(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return _hashable(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, (MapType, VariantType))


def ordered(rows: DataFrame, *keys: str | Column, width: int | None = None) -> DataFrame:
    """The rows staged in the order of ``keys``, with ``_part``, the range they lie in, and ``_row``, their place in it, from 0.

    Spark samples the keys and balances the ranges, whatever the keys' type and however sparse they are; no task holds more than a
    range.  Rows with equal keys are ordered by a hash of all their columns, so that a key that very many rows share is spread over
    ranges, too; only rows that are equal altogether stay together.  Nulls come first.  There are as many ranges as shuffle
    partitions, or of about ``width`` rows each.  Numbers are fixed once, when the table is written; reading it again or losing
    a task doesn't change them.
    """
    n = -(-rows.count() // width) if width else int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64(*(F.col("`" + f.name.replace("`", "``") + "`") for f in rows.schema if _hashable(f.dataType)))
    placed = rows.repartitionByRange(max(1, n), *keys, tie).sortWithinPartitions(*keys, tie).withColumn("_id", F.monotonically_increasing_id())
    placed = cut(placed, "ordered")
    return placed.withColumn("_part", F.shiftright("_id", _BITS)).withColumn("_row", F.col("_id").bitwiseAND((1 << _BITS) - 1)).drop("_id")


def _before(placed: DataFrame, total: Column) -> DataFrame:
    """(_part, _before): the sum of the totals of all ranges before, one row a range."""
    tops = placed.groupBy("_part").agg(total.alias("_sum"))
    run = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(tops.select("_part", F.coalesce(F.sum("_sum").over(run), F.lit(0)).alias("_before")))  # as many rows as shuffle partitions


def numbered(rows: DataFrame, *keys: str | Column, out: str = "position") -> DataFrame:
    """Add the rank by ``keys``, from 0 and without gaps; equal keys in a fixed order.  One range exchange; jobs run as this is called."""
    placed = ordered(rows, *keys)
    return placed.join(_before(placed, F.count("*")), "_part").withColumn(out, F.col("_before") + F.col("_row")).drop("_part", "_row", "_before")


def prefix_sum(rows: DataFrame, key: str | Column, value: str, out: str, width: int | None = None) -> DataFrame:
    """Add the sum of ``value`` over all rows before in the order of ``key``: within the row's range, and of the ranges before.

    Null values count as nothing.  Jobs run as this is called.
    """
    placed = ordered(rows, key, width=width)
    run = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    inner = placed.withColumn("_inner", F.coalesce(F.sum(value).over(run), F.lit(0)))
    return inner.join(_before(placed, F.sum(value)), "_part").withColumn(out, F.col("_before") + F.col("_inner")).drop("_part", "_row", "_before", "_inner")
