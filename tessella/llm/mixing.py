"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.staging import stage

WORD = r"[^\x20\x09-\x0D]+"
#: Words of one source that one shard holds about, and the most shards that a source is dealt over.
SHARD_WORDS, MOST_SHARDS = 1 << 17, 4096
#: Rounds of the permutation that picks blocks.
SWAPS = 10


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, share: float, most: float) -> DataFrame:
    """Targets: ``share`` of all sizes dealt by weight, none above ``most`` times its source's size.

    Takes one row per source (size, weight).  The excess of capped sources goes to the others by weight until
    none is above its cap; in order of cap / weight this is the first level at which the rest fits, so one pass
    of running sums replaces the repetition.  Sources without words get 0.
    """
    order = Window.orderBy(F.col("cap") / F.col("weight"), "source").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    rows = (
        sources.withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("left_total", F.sum("source_size").over(every) * F.lit(float(share)) - (F.sum("cap").over(order) - F.col("cap")))
        .withColumn("left_weight", F.sum("weight").over(every) - (F.sum("weight").over(order) - F.col("weight")))
        .withColumn("level", F.col("left_total") / F.col("left_weight"))
        .withColumn("final", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "source", "level"))).over(every)["level"])
    )
    capped = F.col("final").isNull() | (F.col("final") * F.col("weight") > F.col("cap"))
    return rows.withColumn("target", F.when(capped, F.col("cap")).otherwise(F.col("final") * F.col("weight"))).drop("cap", "left_total", "left_weight", "level", "final")


def sainte_lague(parties: DataFrame, group: list[str], key: list[str], votes: str, seats: str, out: str) -> DataFrame:
    """Deal ``seats`` within each group by the highest quotients votes / (2 s + 1); ties to the smaller key.

    The divisor that rounds all votes to the seats lies between total / (seats +- parties / 2), so every party is
    sure of a lower number of seats and can't pass an upper one; only the quotients between the two, about three a
    party, are ranked.  Parties without votes get none.
    """
    of = Window.partitionBy(*group)
    n, total, s = F.count("*").over(of), F.sum(votes).over(of), F.col(seats)
    rows = parties.withColumn("_n", n).withColumn("_total", total)
    rate = lambda sign: F.greatest(F.lit(0.0), (s + sign * F.col("_n") / 2) / F.when(F.col("_total") > 0, F.col("_total")))
    rows = rows.withColumn("_least", F.greatest(F.lit(0), F.ceil(F.col(votes) * rate(-1) - 0.5) - 1)).withColumn("_most", F.when(F.col(votes) > 0, F.floor(F.col(votes) * rate(1) + 0.5) + 1).otherwise(F.lit(0)))
    rows = rows.withColumn("_least", F.coalesce(F.least("_least", "_most"), F.lit(0)).cast("long")).withColumn("_most", F.coalesce("_most", F.lit(0)).cast("long"))
    rows = rows.withColumn("_open", s - F.sum("_least").over(of))
    names = [*group, *key]
    quotients = rows.where("_most > _least").select(*names, "_open", F.col(votes).alias("_votes"), F.explode(F.sequence(F.col("_least"), F.col("_most") - 1)).alias("_s"))
    ranked = quotients.withColumn("_rank", F.row_number().over(of.orderBy((F.col("_votes") / (2 * F.col("_s") + 1)).desc(), *key, "_s")))
    more = ranked.where("_rank <= _open").groupBy(*names).agg(F.count("*").alias("_more"))
    same = None
    for c in names:
        test = F.col(f"p.{c}").eqNullSafe(F.col(f"m.{c}"))
        same = test if same is None else same & test
    return rows.alias("p").join(more.alias("m"), same, "left").select("p.*", (F.col("_least") + F.coalesce("_more", F.lit(0))).alias(out)).drop("_n", "_total", "_least", "_most", "_open")


def permuted(k: Column, n: Column, key: list[Column]) -> Column:
    """The place of ``k`` in a pseudo-random permutation of 0 .. n - 1 that ``key`` seeds.

    In every round k may change places with its mirror image about a seeded point; a hash of the larger of the two tells, so both
    agree and each round is a permutation, whatever n is.
    """

    def swap(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.xxhash64(*key, r) - x, n)
        return F.when(F.xxhash64(F.greatest(x, mirror), *key, -1 - r) % 2 == 0, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(SWAPS - 1)), k.cast("long"), swap)


def mix(sizes: DataFrame, block_words: int = 16, share: float = 1.5, most: float = 2.0, cycle: tuple[int, ...] = (3, 1, 2), seed: int = 17) -> DataFrame:
    """How many words of each document (doc_id, source, size) the mix takes, and which: all of them ``rounds`` times, and
    the ``spans`` [begin, end) in words, those of the blocks taken once more.

    Sources in code point order, null last, weigh ``cycle`` in turn.  Each source's words are dealt over shards in
    seeded order and cut into equal blocks; Sainte-Laguë deals the mix's blocks to sources and each source's to
    its shards, and in a shard a seeded permutation picks the blocks taken once more than the rest.  No block is
    taken more than ``ceil(most)`` times.  Documents without words take none; an empty table gives no rows; rows
    with a repeated doc_id are documents of their own.
    """
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    shards = int(min(MOST_SHARDS, max(1, -(-total // SHARD_WORDS))))
    docs = sizes.select("doc_id", "source", "size", F.pmod(F.xxhash64("doc_id", "source", F.lit(seed)), F.lit(shards)).alias("shard"))
    cut = docs.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
    cut = cut.withColumn("blocks", F.greatest(F.lit(1), F.round(F.col("shard_size") / block_words)).cast("long"))
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.pmod(F.row_number().over(by_code) - 1, F.lit(len(cycle))) + 1).cast("int"))
    sources = cut.groupBy("source").agg(F.sum("shard_size").alias("source_size"), F.sum(F.when(F.col("shard_size") > 0, F.col("blocks")).otherwise(0)).alias("source_blocks"))
    sources = water_fill(sources.withColumn("weight", weight), share, most)
    votes = F.when(F.col("source_size") > 0, F.col("target") * F.col("source_blocks") / F.col("source_size")).otherwise(F.lit(0.0))
    sources = sources.withColumn("votes", votes).withColumn("seats", F.round(F.sum("votes").over(Window.partitionBy())).cast("long")).withColumn("all", F.lit(1))
    sources = sainte_lague(sources, ["all"], ["source"], "votes", "seats", "quota")
    sources = sources.withColumn("quota", F.least("quota", (F.col("source_blocks") * F.lit(float(most))).cast("long"))).select("source", "source_size", "target", "quota")
    plan = cut.alias("c").join(sources.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).select("c.*", "s.source_size", "s.target", "s.quota")
    plan = plan.withColumn("shard_votes", F.when(F.col("shard_size") > 0, F.col("blocks").cast("double")).otherwise(F.lit(0.0)))
    plan = sainte_lague(plan, ["source"], ["shard"], "shard_votes", "quota", "shard_quota")
    plan = plan.withColumn("rounds", F.floor(F.col("shard_quota") / F.col("blocks"))).withColumn("extra", F.col("shard_quota") - F.col("rounds") * F.col("blocks"))
    at = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = docs.withColumn("end", F.sum("size").over(at)).withColumn("begin", F.col("end") - F.col("size"))
    same = F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.shard") == F.col("p.shard"))
    rows = placed.alias("d").join(plan.alias("p"), same).select("d.*", "p.source_size", "p.target", "p.shard_size", "p.blocks", "p.rounds", "p.extra")
    edge = lambda k: F.floor((F.col("shard_size") * k + F.col("blocks") - 1) / F.col("blocks"))
    first = F.floor(F.col("begin") * F.col("blocks") / F.col("shard_size"))
    last = F.floor((F.col("end") - 1) * F.col("blocks") / F.col("shard_size"))
    chosen = lambda k: permuted(k, F.col("blocks"), [F.col("source"), F.col("shard"), F.lit(seed + 2)]) < F.col("extra")
    overlap = lambda k: F.greatest(F.lit(0), F.least(F.col("end"), edge(k + 1)) - F.greatest(F.col("begin"), edge(k)))
    more = F.aggregate(F.sequence(first.cast("long") - 1, last.cast("long") + 1), F.lit(0).cast("long"), lambda acc, k: acc + F.when((k >= 0) & (k < F.col("blocks")) & chosen(k), overlap(k)).otherwise(F.lit(0)))
    taken = F.when(F.col("size") > 0, F.col("rounds") * F.col("size") + F.when(F.col("extra") > 0, more).otherwise(F.lit(0))).otherwise(F.lit(0))
    inside = lambda k: F.struct((F.greatest(F.col("begin"), edge(k)) - F.col("begin")).cast("int").alias("begin"), (F.least(F.col("end"), edge(k + 1)) - F.col("begin")).cast("int").alias("end"))
    blocks = F.filter(F.sequence(first.cast("long") - 1, last.cast("long") + 1), lambda k: (k >= 0) & (k < F.col("blocks")) & chosen(k) & (overlap(k) > 0))
    none = F.expr("CAST(array() AS array<struct<begin: int, end: int>>)")
    spans = F.when((F.col("size") > 0) & (F.col("extra") > 0), F.transform(blocks, inside)).otherwise(none)
    times = F.when(F.col("size") > 0, F.col("rounds")).otherwise(F.lit(0)).cast("int")
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source", "shard", times.alias("rounds"), spans.alias("spans"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words a mix of all ``documents`` takes from each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    return mix(sizes).select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), "taken")
