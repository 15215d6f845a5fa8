"""Line dedup over levelled sorted runs of line hashes, which every batch merge-anti-joins."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.arrowtext import IS_SPACE, LOWER, passes, span_hashes, string_buffer
from tessella.llm.staging import new_path, stage


def line_keys(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every line: its document, start and end, and both halves of its key's 128-bit hash (0, 0 where the key is empty).

    A key is the line without ASCII white space at both ends, A-Z lower-cased.
    """
    n, docs = len(data), len(offs) - 1
    breaks = np.flatnonzero(data == 10)
    doc = np.concatenate([np.searchsorted(offs, breaks, "right") - 1, np.arange(docs)])
    ends = np.concatenate([breaks, offs[1:]])
    order = np.lexsort((ends, doc))
    doc, ends = doc[order], ends[order]
    starts = np.empty_like(ends)
    starts[1:] = ends[:-1] + 1
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] != doc[:-1]
    starts[new] = offs[:-1]
    at = np.arange(n + 1)
    dark = np.zeros(n + 1, bool)
    dark[:n] = ~IS_SPACE[data]
    after = np.minimum.accumulate(np.where(dark, at, n)[::-1])[::-1]  # the first other byte from here on
    before = np.maximum.accumulate(np.where(dark, at, -1))  # the last one up to here
    a = np.minimum(after[starts], ends)
    b = np.where(ends > 0, before[np.maximum(ends - 1, 0)], -1) + 1
    b = np.maximum(np.where(ends > starts, b, a), a)
    low = LOWER[data]
    k1, k2 = (np.where(b > a, span_hashes(low, a, b, seed), np.uint64(0)) for seed in (1, 2))
    return doc, starts, ends, k1, np.where(b > a, k2 | np.uint64(1), k2)


def document_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2): both halves of the distinct hashes of the lines with a key in each whole text."""

    def run(batches):
        for batch in batches:
            data, offs = string_buffer(batch.column(1))
            for i, j in passes(offs):
                doc, _, _, k1, k2 = line_keys(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                doc, k1, k2 = (x[k2 != 0] for x in (doc, k1, k2))
                order = np.lexsort((k2, k1, doc))
                doc, k1, k2 = doc[order], k1[order], k2[order]
                first = np.ones(len(doc), bool)
                first[1:] = (doc[1:] != doc[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
                edges = pa.array(np.searchsorted(doc[first], np.arange(j - i + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(edges, pa.array(k[first].view(np.int64))) for k in (k1, k2)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *lists], names=["doc_id", "k1", "k2"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, k1 array<long>, k2 array<long>")


def each_line(lines: DataFrame) -> DataFrame:
    """(doc_id, k1, k2): a row for each line key of each document."""
    return lines.select("doc_id", F.explode(F.arrays_zip("k1", "k2")).alias("k")).select("doc_id", "k.k1", "k.k2")


class LineRuns:
    """Levels of runs (k1, k2, docs): a key stands in one run only, that of the batch that brought it first.

    A run is a table bucketed and sorted by key, written once.  A batch is dealt and sorted by key once, merge-anti-joins the runs
    of all levels without moving them, and what is left, the keys that no run holds, becomes a run of level 0.  ``fanout`` runs of
    a level are merged into one of the next, a plain union, as their keys differ: a key is rewritten a logarithmic number of
    times and a batch meets few runs.  What later batches bring of keys that a run holds is kept aside as increments (k1, k2, docs).
    """

    KEY = ("k1", "k2")

    def __init__(self, spark: SparkSession, fanout: int = 4) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.more: list[DataFrame] = []

    def _write(self, keys: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = keys.select(*self.KEY, "docs").repartition(self.buckets, *self.KEY)
        to = dealt.write.bucketBy(self.buckets, *self.KEY).sortBy(*self.KEY).option("compression", "zstd")
        to.option("path", new_path(self.spark, f"run-{level}")).format("parquet").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def unseen(self, keys: DataFrame) -> DataFrame:
        """Merge-anti-join: the rows of a batch whose key no run holds."""
        for level in self.levels:
            for name in level:
                keys = keys.join(self.spark.table(name).select(*self.KEY), [*self.KEY], "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        """Add a batch: one row per document and key (k1, k2)."""
        batch = stage(keys.groupBy(*self.KEY).agg(F.count("*").alias("docs")), "batch")
        new = stage(self.unseen(batch), "unseen") if any(self.levels) else batch
        if any(self.levels):
            self.more.append(stage(batch.join(new.select(*self.KEY), [*self.KEY], "left_anti"), "increments"))
        self._write(new, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self.levels[level], []
            self._write(self.first(merged), level + 1)
            for name in merged:
                self.spark.sql(f"DROP TABLE {name}")
            level += 1

    def first(self, names: list[str] | None = None) -> DataFrame:
        """(k1, k2, docs) of the runs: each key with the documents of the batch that brought it."""
        runs = [self.spark.table(n).select(*self.KEY, "docs") for n in (names if names is not None else [n for level in self.levels for n in level])]
        out = runs[0] if runs else self.spark.createDataFrame([], "k1 long, k2 long, docs long")
        for run in runs[1:]:
            out = out.unionByName(run)
        return out

    def common(self, least: int) -> DataFrame:
        """(k1, k2) of the keys that at least ``least`` documents of all batches hold."""
        rows, more = self.first(), None
        for m in self.more:
            more = m if more is None else more.unionByName(m)
        if more is not None:
            more = more.groupBy(*self.KEY).agg(F.sum("docs").alias("later"))
            rows = rows.join(more, [*self.KEY], "left").withColumn("docs", F.col("docs") + F.coalesce("later", F.lit(0)))
        return rows.where(F.col("docs") >= least).select(*self.KEY)


def drop_lines(docs: DataFrame, keys: DataFrame, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` without the lines whose key is listed in ``keys`` (doc_id, drop array<long> of second halves; one row per doc_id).

    All columns stay; ``text`` holds the lines kept, joined by line feeds, and the columns ``counts``, number of lines and of those
    dropped, are added, in place of any of these names.  Null texts stay null and count as one empty line.
    """
    names = [c for c in docs.columns if c not in counts]
    own = [F.col(f"d.`{c}`").alias(f"c{k}") for k, c in enumerate(names)]  # no name of the caller's can clash
    rows = docs.alias("d").join(keys.alias("k"), F.expr("d.doc_id <=> k.doc_id"), "left").select(*own, F.col("k.drop").alias("drop"))
    at, width = names.index("text"), len(names)

    def run(batches):
        for batch in batches:
            data, offs = string_buffer(batch.column(at))
            drop = batch.column(width)
            lists, values = drop.offsets.to_numpy() if len(drop) else np.zeros(1, np.int32), drop.values.to_numpy(zero_copy_only=False).view(np.uint64)
            valid = ~np.asarray(drop.is_null())
            for i, j in passes(offs):
                part = data[offs[i] : offs[j]]
                doc, starts, ends, _, key = line_keys(part, offs[i : j + 1] - offs[i])
                gone = np.zeros(len(doc), bool)
                for d in np.flatnonzero(valid[i:j]):
                    a, b = np.searchsorted(doc, [d, d + 1])
                    gone[a:b] = np.isin(key[a:b], values[lists[i + d] : lists[i + d + 1]]) & (key[a:b] != 0)
                n_lines = np.bincount(doc, minlength=j - i)
                n_gone = np.bincount(doc[gone], minlength=j - i)
                texts = batch.column(at).slice(i, j - i)
                if gone.any():
                    out, raw = texts.to_pylist(), part.tobytes()
                    for d in np.flatnonzero(n_gone):
                        a, b = np.searchsorted(doc, [d, d + 1])
                        stay = np.flatnonzero(~gone[a:b]) + a
                        out[d] = b"\n".join([raw[starts[x] : ends[x]] for x in stay]).decode("utf-8", "replace")
                    texts = pa.array(out, texts.type)
                cols = [texts if c == at else batch.column(c).slice(i, j - i) for c in range(width)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines), pa.array(n_gone)], names=[*names, *counts])

    schema = T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in names), *(T.StructField(c, T.LongType()) for c in counts)])
    return rows.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, least_docs: int = 10, batches: int = 3, fanout: int = 3, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """Drop, in every document, the lines whose key occurs in at least ``least_docs`` documents.

    Documents go to the runs in ``batches`` batches; each anti-joins what the runs hold and adds what is new.  Keys are
    128-bit hashes of the whole line.  A key's count is a partial aggregate and the join of documents' keys with the common ones
    (staged) can be split, so one line in a third of all documents strains no task.  Every row is a document: rows with
    equal ids or null ids count each and lose their own lines.  Lines without a key (white space only) stay.  Null and empty texts have
    one empty line; an empty table gives no rows.  ``counts`` names the columns that are added.  Batches run as this is called.
    """
    lines = stage(document_lines(docs), "lines")
    runs = LineRuns(docs.sparkSession, fanout)
    for b in range(batches):
        runs.add(each_line(lines.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == b)).select("k1", "k2"))
    common = stage(runs.common(least_docs), "common")
    hits = each_line(lines).join(common, ["k1", "k2"]).groupBy("doc_id").agg(F.collect_set("k2").alias("drop"))
    return drop_lines(docs, hits, counts)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that at least 10 ``documents`` share, dropped from every whole text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = dedup_lines(docs)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, i, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, c.key IS NOT NULL AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
