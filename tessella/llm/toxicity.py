"""Toxicity by maximum-scoring segments over token log-odds."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.arrowtext import LOWER, chain, passes, span_hashes, string_buffer
from tessella.llm.staging import stage

#: Labelled documents that the model is fitted on at most.
TRAIN_ROWS = 20_000
#: Training documents that a feature needs: toxic ones to count for toxicity, others to count against it.
LEAST_TOXIC, LEAST_CLEAN = 2, 20
#: Pseudo documents of the Dirichlet prior for each labelled one, what a token without evidence costs a passage, and the numbers of
#: standard errors that log-odds may be brought nearer to 0 by, of which the sample chooses one.
PRIOR, COST, CAUTIONS = 1.0, 0.05, (1.0, 2.0, 3.0)

_byte = np.arange(256)
#: Bytes of tokens: ASCII letters and digits and all of other characters; those that begin a character of three or four bytes.
_INSIDE = (_byte >= 128) | (_byte >= 48) & (_byte < 58) | (_byte >= 65) & (_byte < 91) | (_byte >= 97) & (_byte < 123)
_WIDE = _byte >= 0xE0


class Words:
    """Tokens of a batch, A-Z lower-cased: each run of letters and digits, whatever its length, and each character of the scripts
    that UTF-8 gives three or four bytes, many of which put no space between words.  White space and ASCII punctuation separate."""

    def __init__(self, data: np.ndarray, offs: np.ndarray) -> None:
        n = len(data)
        inside, first = np.zeros(n + 2, bool), np.zeros(n + 1, bool)
        inside[1 : n + 1] = _INSIDE[data]
        first[offs] = True
        wide = np.flatnonzero(_WIDE[data])
        first[wide] = True
        ends = wide + np.where(data[wide] >= 0xF0, 4, 3)
        first[np.minimum(ends, n)] = True
        self.starts = np.flatnonzero(inside[1:] & (first | ~inside[:-1]))
        self.ends = np.flatnonzero(inside[:-1] & (first | ~inside[1:]))
        self.doc = np.searchsorted(offs, self.starts, "right") - 1
        self.hash = span_hashes(LOWER[data], self.starts, self.ends)
        self.count = np.bincount(self.doc, minlength=len(offs) - 1)

    def features(self):
        """(tokens, hash): every token, and every one together with the token before it in the same document."""
        yield np.arange(len(self.doc)), self.hash
        at = np.flatnonzero(self.doc[1:] == self.doc[:-1]) + 1
        yield at, chain(self.hash[at - 1], self.hash[at])


class Lookup:
    """Positions of hashes in a sorted table; a bitmap turns most others away first."""

    BITS = 20

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.maybe = np.zeros(1 << self.BITS, bool)
        self.maybe[(keys & np.uint64((1 << self.BITS) - 1)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are in the table, and where."""
        some = np.flatnonzero(self.maybe[(h & np.uint64((1 << self.BITS) - 1)).astype(np.int64)])
        at = np.searchsorted(self.keys, h[some])
        at[at == len(self.keys)] = 0
        good = self.keys[at] == h[some] if len(self.keys) else np.zeros(len(some), bool)
        return some[good], at[good]


@dataclass
class Model:
    """Weights by feature hash (sorted), the extreme-value parameters and the logistic calibration."""

    keys: np.ndarray
    weights: np.ndarray
    decay: float = 1.0
    log_k: float = 0.0
    logit: tuple[float, float, float] = (-8.0, 0.0, 0.0)

    def evidence(self, n_words: np.ndarray, best: np.ndarray, significant: np.ndarray) -> np.ndarray:
        """Normalised top score and the logarithm of what all significant passages add up to."""
        return np.stack([np.ones(len(best)), np.clip(self.level(best, n_words), -20, 60), np.log1p(significant)])

    def level(self, score, n_words):
        """-ln of the number of passages with this score that so many clean words would hold by chance."""
        return self.decay * score - self.log_k - np.log(np.maximum(n_words, 1))

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.asarray(self.logit) @ evidence, -30, 30)))


def segments(at: list[int], low: list[float], high: list[float]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, last) of a sequence of scores, in linear time.

    ``at`` lists the places of positive scores, ``low`` and ``high`` the sums of all scores before and after each.  Each new
    segment is merged with the last one that begins lower and ends lower.
    """
    out: list[tuple[float, float, int, int]] = []  # sum before, sum after, first, last
    link: list[int] = []
    for p, before, total in zip(at, low, high, strict=True):
        start, first = before, p
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][0] >= start:
                j = link[j]
            if j < 0 or out[j][1] >= total:
                out.append((start, total, first, p))
                link.append(j)
                break
            start, first = out[j][0], out[j][2]
            del out[j:], link[j:]
    return [(total - start, a, b) for start, total, a, b in out]


def _weights(words: Words, model: Model, lookup: Lookup) -> np.ndarray:
    """Each token's score: of its own log-odds and those with the token before, the one further from 0; -COST without evidence."""
    weight = np.zeros(len(words.doc))
    for at, h in words.features():
        some, where = lookup.find(h)
        new, own = model.weights[where], at[some]
        weight[own] = np.where(np.abs(new) > np.abs(weight[own]), new, weight[own])
    return np.where(weight > 0, weight, np.minimum(weight, -COST))


def _passages(batches, model: Model, text: int):
    """(batch, i, j, words, scores, segments of each document) for runs of documents; segments count tokens from the document's first."""
    lookup = Lookup(model.keys)
    for batch in batches:
        data, offs = string_buffer(batch.column(text))
        for i, j in passes(offs):
            words = Words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            weight = _weights(words, model, lookup)
            high = np.cumsum(weight)
            hit = np.flatnonzero(weight > 0)
            low, first = (high[hit] - weight[hit]).tolist(), np.cumsum(words.count) - words.count
            edges, at, high = np.searchsorted(words.doc[hit], np.arange(j - i + 1)).tolist(), (hit - first[words.doc[hit]]).tolist(), high[hit].tolist()
            yield batch, i, j, words, weight, [segments(at[a:b], low[a:b], high[a:b]) if b > a else [] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def training_rows(labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, toxic) of at most ``rows`` labelled documents outside the held-out fifth, the first in hash order."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def _class_counts(sample: DataFrame) -> DataFrame:
    """(h, a1, a0, b1, b0): in how many toxic and other documents of either half of the sample a feature occurs."""

    def run(batches):
        for batch in batches:
            data, offs = string_buffer(batch.column(1))
            kind = batch.column(3).to_numpy() * 2 + (batch.column(2).to_numpy() != 1)
            for i, j in passes(offs):
                words = Words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                pairs = np.concatenate([np.stack([h, words.doc[at].astype(np.uint64)]) for at, h in words.features()], axis=1)
                pairs = pairs[:, np.lexsort(pairs)]
                new = np.ones(pairs.shape[1], bool)
                new[1:] = (pairs[:, 1:] != pairs[:, :-1]).any(0)
                keys, which = np.unique(pairs[0, new], return_inverse=True)
                of = kind[i:j][pairs[1, new].astype(np.int64)]
                counts = [pa.array(np.bincount(which[of == k], minlength=len(keys))) for k in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *counts], names=["h", "a1", "a0", "b1", "b0"])

    found = sample.select("doc_id", "text", "toxic", "part").mapInArrow(run, "h long, a1 long, a0 long, b1 long, b0 long")
    return found.groupBy("h").agg(*(F.sum(c).alias(c) for c in ("a1", "a0", "b1", "b0")))


def corpus_counts(docs: DataFrame, keys: np.ndarray) -> DataFrame:
    """(h, df): how many of all documents have each feature of ``keys``; one partial count per task and feature."""

    def run(batches):
        lookup, df = Lookup(keys), np.zeros(len(keys), np.int64)
        for batch in batches:
            data, offs = string_buffer(batch.column(0))
            for i, j in passes(offs):
                words = Words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                pairs = [np.zeros(0, np.int64)]
                for at, h in words.features():
                    some, where = lookup.find(h)
                    pairs.append(words.doc[at[some]] * len(keys) + where)
                df += np.bincount(np.unique(np.concatenate(pairs)) % max(len(keys), 1), minlength=len(keys))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(df[some])], names=["h", "df"])

    return docs.select("text").mapInArrow(run, "h long, df long").groupBy("h").agg(F.sum("df").alias("df"))


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Newton's method with a small ridge; evidence never counts against toxicity: a row that would is left out of the fit."""
    used = list(range(len(x)))
    while True:
        own, w = x[used], np.zeros(len(used))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(w @ own, -30, 30)))
            grad = own @ (p - y) + 0.1 * np.array([0, *w[1:]])
            hess = (own * np.maximum(p * (1 - p), 1e-6)) @ own.T + 0.1 * np.eye(len(own))
            step = np.linalg.solve(hess, grad)
            w = w - step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if len(used) == 1 or w[1:].min() >= 0:
            break
        del used[1 + int(w[1:].argmin())]
    out = np.zeros(len(x))
    out[used] = w
    return tuple(float(v) for v in out)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit a model on at most ``rows`` labelled documents, with a prior from the counts of all documents.

    A feature's log-odds are (y + prior * share of all documents) in odds of toxic against other documents, brought
    nearer to 0 by some standard errors: as many of CAUTIONS as give the sample the highest cross-fitted likelihood.  Each half of the sample is also scored with log-odds of the other half alone: there
    the clean documents fix the extreme-value parameters of a passage's score (decay from the moment equation over token
    scores, K from the mean of the top scores), and all of them the logistic curve.  Without toxic or without other labels
    every score is low.  Labels without a document, null labels and ids are left out; of labels of one id the highest counts.
    Jobs run as this is called; what comes to the driver is bounded by the sample.
    """
    chosen = training_rows(labels, rows)
    sample = stage(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).cast("long")), "sample")
    empty = Model(np.zeros(0, np.uint64), np.zeros(0))
    halves = {(r["part"], r["toxic"] == 1): r["n"] for r in sample.groupBy("part", (F.col("toxic") == 1).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    size = [np.array([halves.get((p, t), 0) for p in (0, 1)], float) for t in (True, False)]
    n1, n0 = size[0].sum(), size[1].sum()
    if not n1 or not n0:
        return empty
    y1, y0 = F.col("a1") + F.col("b1"), F.col("a0") + F.col("b0")
    ratio = ((y1 + 0.5) / float(n1 + 1)) / ((y0 + 0.5) / float(n0 + 1))
    table = _class_counts(sample).where(((y1 >= LEAST_TOXIC) & (ratio > 2)) | ((y0 >= LEAST_CLEAN) & (ratio < 0.5))).toPandas()
    if not len(table):
        return empty
    table = table.assign(key=table["h"].to_numpy(np.int64).view(np.uint64)).sort_values("key")
    keys = table["key"].to_numpy()
    total = docs.count()
    df = corpus_counts(docs, keys).toPandas().set_index("h")["df"].reindex(table["h"]).fillna(0).to_numpy(float)

    def weigh(caution, y1, y0, n1, n0):
        size = PRIOR * (n1 + n0)
        prior = np.maximum(size * df / max(total, 1), 1e-3)
        odds = lambda y, n: np.log((y + prior) / np.maximum(n + size - y - prior, 0.5))
        ratio = odds(y1, n1) - odds(y0, n0)
        nearer = np.maximum(np.abs(ratio) - caution * np.sqrt(1 / (y1 + prior) + 1 / (y0 + prior)), 0)
        return np.where(y1 + y0 > 0, np.sign(ratio) * nearer, 0)

    column = lambda c: table[c].to_numpy(float)

    def found_by(m: Model):
        def run(batches):
            for batch, i, j, words, weight, found in _passages(batches, m, 1):
                toxic = batch.column(2).slice(i, j - i).cast(pa.int64())
                scores = pa.array([[s for s, _, _ in f] for f in found], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([toxic, pa.array(words.count), scores, pa.nulls(j - i, pa.float64())], names=["toxic", "n", "segments", "level"])
                clean = (toxic.to_numpy() != 1)[words.doc]
                level, n = np.unique(weight[clean].round(2), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.int64()), pa.array(n), pa.nulls(len(n), scores.type), pa.array(level)], names=["toxic", "n", "segments", "level"])

        return run

    shape = "toxic long, n long, segments array<double>, level double"

    def fitted(caution: float) -> tuple[float, Model]:
        """Cross-fitted log likelihood, and the model with this caution."""
        model = Model(keys, weigh(caution, column("a1") + column("b1"), column("a0") + column("b0"), n1, n0))
        crossed = [Model(keys, weigh(caution, column(f"{c}1"), column(f"{c}0"), size[0][p], size[1][p])) for p, c in ((1, "b"), (0, "a"))]
        parts = [sample.where(f"part = {p}").select("doc_id", "text", "toxic").mapInArrow(found_by(crossed[p]), shape) for p in (0, 1)]
        both = stage(parts[0].unionByName(parts[1]), "crossed")
        levels = both.where("level IS NOT NULL").groupBy("level").agg(F.sum("n").alias("n")).toPandas()
        seen = both.where("level IS NULL").select("toxic", "n", "segments").toPandas()
        y, n = seen["toxic"].to_numpy() == 1, seen["n"].to_numpy(float)
        best = np.array([max(s, default=0.0) for s in seen["segments"]])
        value, times = levels["level"].to_numpy(float), levels["n"].to_numpy(float)
        low, high = 1e-3, 20.0
        for _ in range(60):  # decay: the mean of exp(decay * token score) over clean tokens is 1
            mid = (low + high) / 2
            low, high = (mid, high) if times @ np.exp(mid * value) < times.sum() else (low, mid)
        model.decay = low
        clean = ~y & (n > 0)
        model.log_k = float(np.mean(model.decay * best[clean] - np.log(n[clean])) - np.euler_gamma) if clean.any() else 0.0
        strong = np.array([sum(max(0.0, model.level(s, m)) for s in segs) for segs, m in zip(seen["segments"], n, strict=True)])
        evidence = model.evidence(n, best, strong)
        if y.any() and not y.all():
            model.logit = _fit_logistic(evidence, y.astype(float))
        p = np.clip(model.score(evidence), 1e-9, 1 - 1e-9)
        return float(np.log(np.where(y, p, 1 - p)).sum()), model

    return max((fitted(c) for c in CAUTIONS), key=lambda x: x[0])[1]


def score(docs: DataFrame, model: Model, added: tuple[str, str, str] = ("score", "predicted", "passages")) -> DataFrame:
    """``docs`` with a score (0 to 1), whether it is 0.5 or more, and the significant passages, in columns named ``added``.

    Passages list first token, last token, first token, ... of every maximal segment that clean text of the document's length
    would hold less than once by chance.  Whole texts are read.  Null and empty texts have no passage and a low score; equal
    texts get equal scores; an empty table gives no rows.  Columns of those names are replaced.
    """
    docs = docs.drop(*added)
    names = docs.columns
    text = names.index("text")

    def run(batches):
        for batch, i, j, words, _, found in _passages(batches, model, text):
            best, strong, spans = np.zeros(j - i), np.zeros(j - i), [[] for _ in range(j - i)]
            for d, own in enumerate(found):
                for s, p, q in own:
                    best[d] = max(best[d], s)
                    if (level := model.level(s, words.count[d])) > 0:
                        strong[d] += level
                        spans[d] += [p, q]
            value = model.score(model.evidence(words.count, best, strong))
            yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns), pa.array(value), pa.array((value >= 0.5).astype(np.int32)), pa.array(spans, pa.list_(pa.int64()))], names=[*names, *added])

    kinds = (T.DoubleType(), T.IntegerType(), T.ArrayType(T.LongType()))
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in docs.schema), *(T.StructField(c, k) for c, k in zip(added, kinds, strict=True))])
    return docs.toDF(*(f"c{k}" for k in range(len(names)))).mapInArrow(run, schema)  # mapInArrow takes no names with dots


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all ``documents``, learnt from ``labels`` outside the held-out fifth."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = score(docs, model)
    return rows.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", "predicted")
