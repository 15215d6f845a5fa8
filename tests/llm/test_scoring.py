"""Language-model scores against dictionaries of counts and against SQL."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import DATA, rows
from pyspark.sql import functions as F

from tessella.llm import scoring as S


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0d]+", lower) if w] + [None]


def direct(texts, train, order):
    """(n_tokens, n_known, train_tokens, base, score) of each text, by the definition of Witten-Bell smoothing."""
    follow = defaultdict(Counter)
    single = Counter()
    for text, t in zip(texts, train, strict=True):
        if t:
            seq = ["<s>", *tokens(text)]
            single.update(seq[1:])
            for i in range(1, len(seq)):
                for k in range(1, order):
                    if i - k >= 0:
                        follow[tuple(seq[i - k : i])][seq[i]] += 1
    n, v = sum(single.values()), len(single)

    def p(history, w):
        if not history:
            return (single[w] + 1) / (n + v + 1)
        lower, c = p(history[1:], w), follow.get(history)
        return (c[w] + len(c) * lower) / (sum(c.values()) + len(c)) if c else lower

    for text in texts:
        seq = ["<s>", *tokens(text)]
        own = seq[1:]
        score = math.fsum(math.log10(p(tuple(seq[max(0, i - order + 1) : i]), seq[i])) for i in range(1, len(seq)))
        yield len(own), sum(single[w] > 0 for w in own), n, math.fsum(math.log10(p((), w)) for w in own), score


def sample():
    rng = random.Random(5)
    words = ["The", "the", "é", "ß", "ZZ", *(f"w{k}" for k in range(30))]
    texts = [" ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.choice([1, 2, 3, 40, 127, 128, 129, 300]))) for _ in range(60)]
    return texts + [None, "", " \n", "unheard of words", texts[0], texts[0], "a b " * 2000]


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("small", [False, True])
def test_scores_by_definition(spark, monkeypatch, order, small):
    if small:  # many blocks and buckets
        monkeypatch.setattr(S, "BLOCK_BYTES", 3000)
        monkeypatch.setattr(S, "BUCKET_GRAMS", 160)
    texts = sample()
    train = [k % 4 != 1 for k in range(len(texts))]
    splits, find = {}, S.split_histories
    monkeypatch.setattr(S, "split_histories", lambda *a: splits.update(found := find(*a)) or found)
    docs = spark.createDataFrame([(k, t, b, "x") for k, (t, b) in enumerate(zip(texts, train, strict=True))], "doc_id long, text string, learn boolean, score string").repartition(3)
    got = S.language_model_scores(docs, F.col("learn"), order).orderBy("doc_id").collect()
    assert len(got) == len(texts)
    for r, w in zip(got, direct(texts, train, order), strict=True):
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert r.base_score == pytest.approx(w[3], rel=1e-12) and r.score == pytest.approx(w[4], rel=1e-12)
    if small:
        assert any(len(h) for h, _ in splits.values())
    same = [r.score for r in got if texts[r.doc_id] == texts[0]]
    assert len(same) == 3 and len(set(same)) == 1


def test_probabilities_sum_to_one(spark):
    """After one history, the tokens and the one unknown word have all probability: p(b w) over w, by p(b)."""
    texts = ["a b a", "b b c", "a"]
    docs = [(k, t, True) for k, t in enumerate(texts)] + [(10 + k, f"b {w}", False) for k, w in enumerate(["a", "b", "c", "unknown"])] + [(20, "b", False)]
    got = {r.doc_id: r.score for r in S.language_model_scores(spark.createDataFrame(docs, "doc_id long, text string, t boolean"), F.col("t")).collect()}
    n, v = 10, 4  # tokens with the ends, and kinds
    lower = {"a": 4 / 15, "b": 4 / 15, "c": 2 / 15, "unknown": 1 / 15, None: 4 / 15}
    assert n + v + 1 == 15 and sum(lower.values()) == pytest.approx(1)
    ends = {"a": (2 + 2 * lower[None]) / 5, "b": (0 + 3 * lower[None]) / 6, "c": (1 + lower[None]) / 2, "unknown": lower[None]}  # p(end | w)
    first = (1 + 2 * lower["b"]) / 5  # p(b | start)
    after_b = [10 ** got[10 + k] / first / ends[w] for k, w in enumerate(["a", "b", "c", "unknown"])] + [10 ** got[20] / first]
    assert sum(after_b) == pytest.approx(1)


def test_odd_tables(spark):
    with pytest.raises(ValueError):
        S.language_model_scores(spark.range(0), F.lit(True), 1)
    put = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, t boolean")
    assert S.language_model_scores(put([]), F.col("t")).count() == 0
    none = S.language_model_scores(put([(1, "a b", None), (None, "a", False)]), F.col("t")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.score) for r in none] == [(None, 2, 0, 0, 0.0), (1, 3, 0, 0, 0.0)]


def test_query_against_sql_and_definition(spark, duck):
    got = S.op13_lm_scoring(spark, DATA).toPandas()
    assert rows(got) == rows(duck.sql(S.OP13_SQL).df())
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    held = [zlib.crc32(str(d.doc_id).encode()) % 7 == 2 for d in docs]
    want = {d.doc_id: (h, *w) for d, h, w in zip(docs, held, direct([d.text for d in docs], [not h for h in held], 2), strict=True)}
    for r in got.itertuples():
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], rel=1e-12) and r.score == pytest.approx(w[5], rel=1e-12)
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum() and np.isfinite(got.score).all()
