"""Periodic runs against a direct search."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import runs as R


def direct(words):
    """All runs by definition: every period, every maximal stretch, smallest periods only."""
    found, n = {}, len(words)
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i + p - s >= max(6, 4 * p):
                found.setdefault((s, i + p - s), p)
    return sorted((s, length, p) for (s, length), p in found.items())


def collapsed(words, found):
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", text or "") if w]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=6))
def test_runs_of_random_sequences(texts):
    edge = np.cumsum([0, *map(len, texts)])
    t, *rest = R.maximal_runs(np.array([w for x in texts for w in x], np.int64), edge)
    got = [[tuple(int(v[k]) for v in rest) for k in np.flatnonzero(t == d)] for d in range(len(texts))]
    assert got == [direct(x) for x in texts]


def nested(seed, n):
    rng, out = random.Random(seed), []
    while len(out) < n:
        if out and rng.random() < 0.4:
            k = rng.randint(1, min(len(out), 40))
            out += out[-k:] * rng.randint(2, 7)
        else:
            out += [rng.randint(0, 5) for _ in range(rng.randint(1, 5))]
    return out[:n]


@pytest.mark.parametrize("seed", range(8))
def test_runs_of_nested_repeats(seed):
    texts = [nested(seed * 10 + k, 50 * k + 7) for k in range(6)] + [[1] * 500, [1, 2] * 300, [], [3]]
    edge = np.cumsum([0, *map(len, texts)])
    t, *rest = R.maximal_runs(np.array([w for x in texts for w in x], np.int64), edge)
    for d, x in enumerate(texts):
        assert [tuple(int(v[k]) for v in rest) for k in np.flatnonzero(t == d)] == direct(x)


def test_extensions_on_the_grammar():
    rng = np.random.default_rng(3)
    word = np.concatenate([rng.integers(0, 3, 400), np.tile(rng.integers(0, 3, 7), 40), rng.integers(0, 2, 300)])
    symbol = np.concatenate([[90], word, [91]])
    wall = np.zeros(len(symbol), bool)
    wall[[0, -1]] = True
    levels = R.recompress(symbol, wall)
    assert len(levels[-1].symbol) == 3
    i = rng.integers(1, len(word), 3000)
    j = rng.integers(1, len(word), 3000)
    i, j = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]
    ahead, back = R.common(levels, i, j), R.common(levels, i, j, back=True)
    for a, b, f, k in zip(i, j, ahead, back, strict=True):
        m = 0
        while symbol[a + m] == symbol[b + m]:
            m += 1
        assert f == m
        m = 0
        while symbol[a - 1 - m] == symbol[b - 1 - m]:
            m += 1
        assert k == m


def expected(rows):
    for doc_id, text in rows:
        words = split(text)
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
        found = direct(words)
        best = min(found, key=lambda r: (-__import__("fractions").Fraction(r[1], r[2]), r[0], r[2]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        yield (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(collapsed(words, found)))


def test_query_against_the_direct_search(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = [w for w in expected(docs)]
    got = [tuple(r) for r in R.op11_runs(spark, DATA).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()]
    assert sorted(got) == sorted(want) and sum(w[1] for w in want) > 10


def test_odd_rows(spark, tmp_path):
    texts = [None, "", " \t\n", "one", "a " * 5000, "x y z " * 2000, " ".join(str(k) for k in range(30000)), "é ü " * 9, "x y z " * 2000]
    rows = [(k, t, "en") for k, t in enumerate(texts)] + [(None, "a b " * 5, None), (3, "one", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(2)
    got = {(r.doc_id, r.n_words): r for r in R.periodic_runs(docs).collect()}
    for k, t, _ in rows:
        r, words = got[k, len(split(t))], split(t)
        found = direct(words) if len(words) < 10000 else []
        assert [tuple(x) for x in r.runs] == found and r.collapsed == collapsed(words, found)
    assert R.periodic_runs(docs.limit(0)).count() == 0
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    assert R.op11_runs(spark, str(tmp_path)).count() == len(rows)
