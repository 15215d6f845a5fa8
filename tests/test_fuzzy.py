"""The fuzzy blocklist against difflib."""

import difflib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.functions import fuzzy


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("abcé", max_size=12), st.text("abcé", max_size=12)), min_size=1, max_size=8))
def test_matching_blocks(pairs):
    a, n = fuzzy._letters([x for x, _ in pairs])
    b, m = fuzzy._letters([y for _, y in pairs])
    got = fuzzy.matched_letters(a, n, b, m)
    want = [sum(k.size for k in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()) for x, y in pairs]
    assert got.tolist() == want


def noisy(rng, word):
    w = list(word)
    for _ in range(rng.randint(0, 3)):
        k = rng.randrange(len(w) + 1)
        rng.choice([lambda: w.insert(k, rng.choice("abcdxyz")), lambda: w.pop(k) if k < len(w) else None, lambda: w.reverse() if rng.random() < 0.2 else None])()
    return "".join(w)


@pytest.mark.parametrize("changes", [0, 1, 1.5, 2])
def test_random_words(changes):
    rng = random.Random(int(changes * 2))
    words = ["".join(rng.choices("abcdef", k=rng.randint(2, 11))) for _ in range(25)] + ["two words", "three short ones"]
    runs = [noisy(rng, rng.choice(words)) for _ in range(400)] + ["".join(rng.choices("abcdef", k=rng.randint(0, 12))) for _ in range(300)] + [""]
    want = [next((k for k, w in enumerate(words) if ratio(r, w) >= (len(w) - changes) / len(w)), -1) for r in runs]
    assert fuzzy.resembled(runs, words, changes).tolist() == want and len(set(want)) > 5


def test_the_index_loses_nothing():
    for size in range(1, 14):
        for changes in (0, 1, 2, 3):
            if fuzzy.needs_bigram(size, changes):
                rng = np.random.default_rng(size * 10 + changes)
                for _ in range(200):
                    b = "".join(rng.choice(list("abc"), size))
                    a = "".join(rng.choice(list("abc"), int(rng.integers(1, size + 4))))
                    if ratio(a, b) >= (size - changes) / size:
                        assert {a[k : k + 2] for k in range(len(a) - 1)} & {b[k : k + 2] for k in range(len(b) - 1)}
    assert fuzzy.needs_bigram(6, 1) and not fuzzy.needs_bigram(2, 1)


def test_texts(spark):
    words = ["idiots", "moron", "license", "very bad thing", "disgusting"]
    texts = [None, "", "  ", "a lisence here", "an IDIOTS", "moron", "a vary bad thing", "lisence and vary bad thing", "nothing", "disgustin g", "idiot licence", "x" * 3000] * 3
    def direct(t):
        tokens = (t or "").lower().split()
        for n in (1, 3):
            for k in range(len(tokens) - n + 1):
                for w in words:
                    if len(w) >= 6 and len(w.split()) == n and ratio(" ".join(tokens[k : k + n]), w) >= (len(w) - 1) / len(w):
                        return w
        return None
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(2)
    got = {r.id: r.w for r in df.select("id", fuzzy.fuzzy_blocked(words)("t").alias("w")).collect()}
    assert got == {k: direct(t) for k, t in enumerate(texts)} and len(set(got.values())) >= 4


def peak_mb(f, *args):
    tracemalloc.start()
    try:
        out = f(*args)
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("changes", [1, 8])
def test_a_long_run_makes_no_large_matrix(changes):
    rng = random.Random(changes)
    runs = ["".join(rng.choices("abcdefgh", k=8)) for _ in range(3000)] + ["b" * 3000, "abcdefgx", ""]
    words = ["abcdefgh", "hgfedcba"]
    got, mb = peak_mb(fuzzy.resembled, runs, words, changes)
    assert got.tolist() == [next((k for k, w in enumerate(words) if ratio(r, w) >= (len(w) - changes) / len(w)), -1) for r in runs]
    assert got[-2] == 0 and got[-1] == (0 if changes == 8 else -1) and mb < 100


def test_memory_does_not_grow_with_the_batch(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "PASS_BYTES", 1 << 16)
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=8)) for _ in range(200)) for _ in range(640)]
    run = fuzzy.fuzzy_blocked(["abcdefgh", "two words"]).func
    few, many = (peak_mb(run, pa.array(texts[:n]))[1] for n in (160, 640))
    assert many < 1.5 * few


@pytest.mark.parametrize(("size", "cells", "pairs"), [(1, 1, 1), (40, 64, 7), (1 << 22, 1 << 20, 1 << 15)])
def test_passes_and_groups_change_nothing(spark, monkeypatch, size, cells, pairs):
    for name, v in (("PASS_BYTES", size), ("CELLS", cells), ("PAIRS", pairs)):
        monkeypatch.setattr(fuzzy, name, v)
    words = ["license", "licence", "a bad thing", "disgusting", "größe\u0130n", "\U0001f600smiles"]
    kinds = ["licens", "licenc", "a vad thing", "licenze", "LICENCE", "disgustng", "disgusting,", "a", "bad", "thing", "thin", "größe\u0130n", "GRÖSSEN", "\U0001f600smile", "x" * 300, "the", "\u03a3"]
    rng = random.Random(5)
    texts = [None, "", " \u2003 ", *("".join(rng.choice(kinds) + rng.choice([" ", "  ", "\n", "\u00a0", "\x1f"]) for _ in range(rng.randint(1, 5))) for _ in range(150))]
    low = [w.lower() for w in words]

    def direct(t):
        tokens = (t or "").lower().split()
        runs = [(n, " ".join(tokens[k : k + n])) for n in (1, 3) for k in range(len(tokens) - n + 1)]
        return next((w for n, r in runs for w in low if len(w.split()) == n and ratio(r, w) >= (len(w) - 1) / len(w)), None)

    got = fuzzy.fuzzy_blocked(words).func(pa.array(texts, pa.string())).to_pylist()
    assert got == [direct(t) for t in texts] and len(set(got)) >= 6
    assert fuzzy.fuzzy_blocked(words).func(pa.array([], pa.string())).to_pylist() == []


def test_the_query_compares_once(spark, capsys):
    from tessella.plans.text import tx6

    tx6(spark, "/root/testdata/sf0.001").explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1
