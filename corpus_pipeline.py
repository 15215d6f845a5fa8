"""Corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input.

Toxic documents go, lines that many documents share go, one document of each near-duplicate group stays, sources are
mixed to their target weights, and what is left is packed into token sequences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import linededup, minhash, mixing, packing, toxicity
from tessella.llm.staging import stage

#: Ids that may be broadcast to drop documents (8 bytes each); more are joined by shuffling.
MOST_BROADCAST = 1_000_000


def _own(docs: DataFrame) -> list[Column]:
    """The columns of ``docs``, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def _fresh(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """Names like these that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    return tuple(next(x for k in range(len(taken) + 1) if (x := f"{n}_{k}").lower() not in taken) for n in names)


def _with_text(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from ``rows``, with the number of characters brought up to date."""
    return (rows.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else rows).select(*_own(docs))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score doesn't reject; the model learns from the labels outside the held-out fifth.

    Null and empty texts stay, repeated rows share one fate, an empty table gives none; all other columns pass unchanged, also those
    named like the score's.
    """
    names = _fresh(docs, "score", "predicted", "passages")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, names).where(F.col(names[1]) == 0).select(*_own(docs))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least 10 of them share.

    Every document stays, if only as an empty text; null texts stay null, repeated rows count each, an empty table gives none; all
    other columns but ``n_chars`` pass unchanged.
    """
    return _with_text(linededup.dedup_lines(docs, counts=_fresh(docs, "n_lines", "n_dropped")), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates on 5-word shingles at 0.8.

    Null and empty texts and rows without id stay; repeated rows have one id and stay together; an empty table gives none; all
    columns pass unchanged.
    """
    rows = minhash.near_duplicates(docs, words=5, percent=80)
    gone = stage(rows.where("NOT kept").select("doc_id").distinct(), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= MOST_BROADCAST else gone, "doc_id", "left_anti").select(*_own(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document: its whole text as often as all blocks are taken, then the blocks taken once more.

    Documents of which the mix takes nothing go, so also null and empty texts, and rows without id; repeated rows of one id take
    the same words each; a null source is a source of its own; an empty table gives none.  All other columns but ``n_chars`` pass unchanged.
    """
    sizes = stage(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")), "sizes")
    id_, rounds, spans = _fresh(docs, "id", "rounds", "spans")
    taken = mixing.mix(sizes).where("taken > 0").select(F.col("doc_id").alias(id_), F.col("rounds").alias(rounds), F.col("spans").alias(spans)).dropDuplicates([id_])
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    cut = lambda w: F.array_join(F.flatten(F.transform(spans, lambda s: F.slice(w, s["begin"] + 1, s["end"] - s["begin"]))), "")
    part = F.when(F.size(spans) > 0, F.transform(F.array(words), cut)).otherwise(F.expr("CAST(array() AS array<string>)"))  # words bound once
    mixed = F.array_join(F.concat(F.array_repeat("text", F.col(rounds)), part), "\n")
    rows = docs.join(taken, F.col("doc_id") == F.col(id_))
    return _with_text(rows.withColumn("text", mixed), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 ids; null and empty texts have their end only, an empty table gives none."""
    rows = packing.pack(docs, packing.word_tokenizer())
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]
#: SQL can express neither the learned classifier nor the seeded choices; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
