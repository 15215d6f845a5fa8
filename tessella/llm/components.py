"""Connected components by alternating star contraction, on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.staging import stage


def _larger(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex moves to the vertex's smallest one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _smaller(edges: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours move to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def contracted(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(u, v): stars of ids that ``links`` (a, b) connect, v the smaller id; complete unless ``rounds`` ends it early."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    if rounds is not None:
        for _ in range(rounds):
            edges = stage(_smaller(_larger(edges)), "edges")
        return edges
    edges, before = stage(edges, "edges"), None
    mark = (F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"))
    while (now := tuple(edges.agg(*mark).first())) != before and now[0]:
        before = now
        edges = stage(_smaller(_larger(edges)), "edges")
    return edges


def components(links: DataFrame) -> DataFrame:
    """(id, component): for every id in ``links`` (a, b), the smallest id that it reaches.

    Each round is a staged table and a few joins on vertex ids, which are split where a vertex has very many
    links; the number of rounds grows with the logarithm of the longest path.  Links from an id to itself and
    nulls are ignored.
    """
    stars = contracted(links).select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct())
