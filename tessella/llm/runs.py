"""Periodic runs of words: a run-length grammar by recompression, and extensions of candidates by queries on it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.arrowtext import mix, passes, string_buffer, word_hashes, word_spans

#: Periods a run holds at least, words it has at least, and candidates that one numpy pass extends.
EXPONENT, LEAST_WORDS, CANDIDATES = 4, 6, 1 << 20


@dataclass
class Level:
    """Symbols of one round and how they make up those of the next: ``parent`` of every symbol, ``first`` child of every parent.

    ``left`` tells for a pair round which symbols open pairs; it is None for a block round (runs of one symbol).
    """

    symbol: np.ndarray
    parent: np.ndarray | None = None
    first: np.ndarray | None = None
    left: np.ndarray | None = None


def _named(key: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense names of keys, equal for equal keys, and how many there are."""
    kinds, name = np.unique(key, return_inverse=True)
    return name, len(kinds)


def recompress(symbol: np.ndarray, wall: np.ndarray) -> list[Level]:
    """The rounds of a grammar of ``symbol``: block compression and pair compression in turn.

    ``wall`` marks symbols that occur once and never join others; a sequence begins and ends with one and they part the texts.  A
    block round names every run of one symbol by symbol and length.  A pair round parts the alphabet in two halves by a
    hash, tries two hashes both ways round, and names the pairs that go from the first half to the second.  So what a
    symbol becomes depends on its neighbours alone, and equal passages are parsed alike but for their ends.  Rounds
    end when every text is one symbol; each is expected to shrink the sequence by a constant factor.
    """
    name, kinds = _named(symbol)
    levels, salt = [], 0
    while True:
        inner = ~wall[:-1] & ~wall[1:]
        if not inner.any():
            return [*levels, Level(name)]
        new = np.ones(len(name), bool)
        new[1:] = name[1:] != name[:-1]
        if not new.all():
            first = np.flatnonzero(new)
            size = np.diff(first, append=len(name))
            levels.append(Level(name, np.cumsum(new) - 1, first))
            name, kinds = _named(name[first] * (size.max() + 1) + size)
            wall = wall[first]
            inner = ~wall[:-1] & ~wall[1:]
        best = None
        for k in range(2):
            half = (mix(np.arange(kinds, dtype=np.uint64) + np.uint64((2 * salt + k + 1) << 32)) >> np.uint64(63)).astype(bool)
            for left in (half, ~half):
                joined = inner & left[name[:-1]] & ~left[name[1:]]
                if best is None or np.count_nonzero(joined) > best[0]:
                    best = np.count_nonzero(joined), left, joined
        salt += 1
        _, left, joined = best
        new = np.ones(len(name), bool)
        new[1:] = ~joined
        first = np.flatnonzero(new)
        second = np.zeros(len(first), np.int64)
        opens = np.append(joined, False)[first]
        second[opens] = name[first[opens] + 1] + 1
        levels.append(Level(name, np.cumsum(new) - 1, first, left))
        name, kinds = _named(name[first] * (kinds + 1) + second)
        wall = wall[first]


def common(levels: list[Level], i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
    """Lengths of the longest common extensions of the places i < j of one text: of what begins there or, ``back``, of what ends before.

    A query climbs while symbols agree: in a block round it passes the shorter of two remaining runs, in a pair round at most one
    symbol, whose partner may lie outside, and then both places are borders of the next round.  Where symbols differ
    it comes down again, passing at most one child or the shorter run in every round.
    """
    a, b = i.copy(), j.copy()
    off, sign = (1, -1) if back else (0, 1)
    height = np.full(len(i), len(levels) - 1)

    def rest(level: Level, at: np.ndarray) -> np.ndarray:
        """Symbols from here to the border of the run."""
        up = level.parent[at - off]
        return at - level.first[up] if back else np.append(level.first, len(level.symbol))[up + 1] - at

    live = np.arange(len(i))
    for h, level in enumerate(levels[:-1]):
        x, y = a[live], b[live]
        same = level.symbol[x - off] == level.symbol[y - off]
        if level.left is None:
            rx, ry = rest(level, x), rest(level, y)
            step, on = np.where(same, np.minimum(rx, ry), 0), same & (rx == ry)
        else:
            first = level.left[level.symbol[x - off]]
            step, on = (same & (first if back else ~first)).astype(np.int64), same
        x, y = x + sign * step, y + sign * step
        a[live], b[live] = np.where(on, level.parent[x], x), np.where(on, level.parent[y], y)
        height[live[~on]] = h
        live = live[on]
        if not len(live):
            break
    for h in range(len(levels) - 2, -1, -1):
        down = np.flatnonzero(height > h)
        if not len(down):
            continue
        level = levels[h]
        x, y = level.first[a[down]], level.first[b[down]]
        same = level.symbol[x - off] == level.symbol[y - off]
        step = np.where(same, np.minimum(rest(level, x), rest(level, y)) if level.left is None else 1, 0)
        a[down], b[down] = x + sign * step, y + sign * step
    return (a - i) * sign


def _grid(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts of n words, every text and period that a run can have."""
    most = n // EXPONENT
    text = np.repeat(np.arange(len(n)), most)
    return text, np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1


def maximal_runs(word: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs in texts of words numbered ``word``, cut at ``edge``, by text, start and period.

    A run of period p has 4 p words or more, so it holds a point i of the grid 0, 3 p, 6 p, ... together with i + p.  Each such
    pair of equal words is extended both ways on the grammar.  Over all periods that is n log n / 3 candidates.  Of stretches that
    several periods describe (multiples of the smallest) the smallest stays.
    """
    n = np.diff(edge)
    spread = np.arange(len(word)) + np.repeat(np.arange(len(n)) + 1, n)  # places with a wall before every text and at the end
    length = len(word) + len(n) + 1
    wall = np.ones(length, bool)
    wall[spread] = False
    symbol = np.arange(length) + (word.max(initial=0) + 1)
    symbol[spread] = word
    begin = edge[:-1] + np.arange(len(n)) + 1
    text, period = _grid(n)
    points = -(-(n[text] - period) // ((EXPONENT - 1) * period))
    total, levels, out = np.cumsum(points), None, []
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + CANDIDATES, "right")))
        count = points[lo:hi]
        p = np.repeat(period[lo:hi], count)
        t = np.repeat(text[lo:hi], count)
        i = begin[t] + (np.arange(len(p)) - np.repeat(np.cumsum(count) - count, count)) * (EXPONENT - 1) * p
        met = np.flatnonzero(symbol[i] == symbol[i + p])
        i, p, t = i[met], p[met], t[met]
        lo = hi
        if not len(i):
            continue
        levels = levels or recompress(symbol, wall)
        ahead = common(levels, i, i + p)
        behind = common(levels, i, i + p, back=True)
        whole = ahead + behind + p
        good = whole >= np.maximum(LEAST_WORDS, EXPONENT * p)
        if good.any():
            out.append(np.stack([t[good], (i - behind - begin[t])[good], whole[good], p[good]]))
    if not out:
        return tuple(np.zeros((4, 0), np.int64))
    t, start, whole, p = np.concatenate(out, axis=1)
    order = np.lexsort((p, whole, start, t))
    t, start, whole, p = (x[order] for x in (t, start, whole, p))
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (start[1:] != start[:-1]) | (whole[1:] != whole[:-1])
    t, start, whole, p = (x[new] for x in (t, start, whole, p))
    order = np.lexsort((p, start, t))
    return tuple(x[order] for x in (t, start, whole, p))


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of every range, one range after another."""
    return np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)


def _kept_texts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, texts: int) -> pa.Array:
    """Words of every text joined by single spaces."""
    size = ends - starts
    body = np.full(size.sum() + len(size), 0x20, np.uint8)
    body[_ranges(np.cumsum(size + 1) - size - 1, size)] = data[_ranges(starts, size)]
    total = np.bincount(owner, weights=size + 1, minlength=texts).astype(np.int64)
    stay = np.ones(len(body), bool)
    stay[np.cumsum(total)[total > 0] - 1] = False  # no space after a text's last word
    offsets = np.concatenate([[0], np.cumsum(total - (total > 0))])
    return pa.Array.from_buffers(pa.large_string(), texts, [None, pa.py_buffer(offsets), pa.py_buffer(body[stay])])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): all periodic runs of words in every whole text, and the text with repetitions cut.

    ``docs`` has doc_id and text; further columns don't matter.  A word is a run of characters other than ASCII white space.  A run is
    a stretch of words with smallest period q and at least max(6, 4 q) words, longer in neither direction; ``runs``
    has them as (start, length, period) by start, then period.  ``collapsed`` keeps, joined by one space, the words that no
    run contains after its first q.  Null and empty texts have no words, no runs and an empty collapsed text; rows are
    treated one by one, so repeated rows and null ids simply come out again; an empty table gives none.  Words are compared by
    64-bit hashes within a text.  Nothing is shuffled; memory follows a pass of about 1 MB of text or its longest text.
    """
    shape = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"

    def run(batches):
        for batch in batches:
            data, offs = string_buffer(batch.column(1))
            for lo, hi in passes(offs):
                own, cut = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                starts, ends, doc = word_spans(own, cut)
                edge = np.searchsorted(doc, np.arange(hi - lo + 1))
                word, _ = _named(word_hashes(own, starts, ends))
                t, start, length, period = maximal_runs(word, edge)
                mark = np.zeros(len(word) + 1, np.int64)
                np.add.at(mark, edge[t] + start + period, 1)
                np.add.at(mark, edge[t] + start + length, -1)
                keep = np.cumsum(mark[:-1]) == 0
                collapsed = _kept_texts(own, starts[keep], ends[keep], doc[keep], hi - lo)
                each = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(t, np.arange(hi - lo + 1)).astype(np.int32)), each)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(edge)), lists, collapsed.cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(run, shape)


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in every tenth document, by a checksum of its id, the words from some place on repeat with some period."""
    words = F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")
    h = F.crc32(F.col("doc_id").cast("string"))
    tail = F.expr(
        """transform(array(words), w -> transform(array(named_struct('a', g % size(w), 'n', size(w))), s ->
           transform(array(named_struct('a', s.a, 'n', s.n, 'p', 1 + (s.n - s.a) DIV (3 + g % 8))), s ->
           array_join(transform(sequence(0L, s.n - 1L), i -> w[CAST(IF(i >= s.a, s.a + (i - s.a) % s.p, i) AS INT)]), ' '))[0])[0])[0]"""
    )
    chosen = docs.select("doc_id", "text", (h % 10).alias("h"), F.floor(h / 10).cast("long").alias("g")).withColumn("words", F.when(F.col("h") == 0, words))
    return chosen.select("doc_id", F.when((F.col("h") == 0) & (F.size("words") > 0), tail).otherwise(F.col("text")).alias("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all ``documents``, a tenth of which are given periodic tails: counts, the run of most periods, digests."""
    found = periodic_runs(with_periodic_tails(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    best = F.expr(
        """aggregate(runs, CAST(NULL AS struct<start: bigint, length: bigint, period: bigint>), (b, r) -> CASE WHEN b IS NULL
           OR r.length * b.period > b.length * r.period THEN r ELSE b END)"""
    )  # runs come by start and period, so the first of equals stays
    lines = F.expr("sha2(array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), ''), 256)")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", *(f"best.{c}" for c in ("start", "length", "period")), F.expr("1000 * best.length DIV best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
