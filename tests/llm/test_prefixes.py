"""The prefix filter's joins stay linear on templates that many documents share."""

from pyspark.sql import functions as F

from tessella.llm import minhash as M


def matches(spark, monkeypatch, n, own):
    """Rows that the joins by shingle make before any filter, and the pairs that come out."""
    made = []
    sides = M.prefix_sides

    def counted(first, percent):
        x, y = sides(first, percent)
        made.append(x.join(y, ["h", "size"]).count())
        return x, y

    monkeypatch.setattr(M, "prefix_sides", counted)
    shared = " ".join(f"t{k}" for k in range(300))
    texts = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit(shared), F.lit(" "), F.array_join(F.transform(F.sequence(F.lit(0), own - 1 + F.col("id") % 3), lambda k: F.concat(F.lit("w"), F.col("id"), F.lit("x"), k)), " ")).alias("text"))
    none = spark.createDataFrame([], "id long, component long")
    return made, M.rare_pairs(texts, none, 4, 80).count()


def test_a_template_below_the_threshold_matches_nothing(spark, monkeypatch):
    made, pairs = matches(spark, monkeypatch, 150, 45)
    more, pairs_more = matches(spark, monkeypatch, 300, 45)
    assert pairs == pairs_more == 0 and sum(made) <= 150 * 24 and sum(more) <= 300 * 24


def test_a_template_above_the_threshold_makes_its_links(spark, monkeypatch):
    made, pairs = matches(spark, monkeypatch, 40, 20)
    assert pairs == 40 * 39 // 2  # all are similar and none is connected yet
