"""Exact top-k search by columnar branch and bound."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.staging import stage

#: Candidates in a vertical block, queries of one round (they are broadcast), and dimensions added between two prunings.
CANDIDATES, QUERIES, DIMS = 4096, 16384, 16


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null where the vector is null or has a null or non-finite component."""
    whole = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(whole, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double")))


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    """Vectors as columns (vertical layout); shorter ones count as ending in zeros."""
    lens = col.value_lengths().to_numpy()
    flat = col.flatten().to_numpy()
    out = np.zeros((dims, len(lens)))
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    out[at, np.repeat(np.arange(len(lens)), lens)] = flat
    return out


def bound_search(c: np.ndarray, c_ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query's place, candidate, score) of each query column of q over the candidate columns of c, but for those
    that score less than the query's ``floors``.

    Dimensions go in order of energy, a block at a time.  Before and after each block a candidate's score lies within
    |rest of query| * |rest of candidate| of what it has; those whose upper bound is under the floor or under the k-th best lower
    bound leave, and the columns that stay are compacted.  Scores are sums of integers, exact in doubles.
    """
    order = np.argsort(-np.square(c).sum(1), kind="stable")
    c, q = np.ascontiguousarray(c[order]), np.ascontiguousarray(q[order])
    edges = [*range(0, c.shape[0], DIMS), c.shape[0]]
    rest = lambda m: np.sqrt(np.stack([np.square(m[e:]).sum(0) for e in edges]))
    c_rest, q_rest = rest(c), rest(q)
    out_q, out_c, out_s = [], [], []
    for i in np.flatnonzero(q_rest[0] * c_rest[0].max(initial=0.0) * (1 + 1e-9) + 1e-6 >= floors):
        live = np.flatnonzero((c_ids != q_ids[i]) & (q_rest[0, i] * c_rest[0] * (1 + 1e-9) + 1e-6 >= floors[i]))
        score = np.zeros(len(live))
        for b in range(1, len(edges)):
            part = slice(edges[b - 1], edges[b])
            score = score + q[part, i] @ (c[part] if len(live) == c.shape[1] else c[part][:, live])
            slack = q_rest[b, i] * c_rest[b, live] * (1 + 1e-9) + 1e-6
            floor = floors[i]
            if len(live) > k:
                floor = max(floor, np.partition(score - slack, len(live) - k)[len(live) - k])
            if not (stay := score + slack >= floor).all():
                live, score = live[stay], score[stay]
        best = np.lexsort((c_ids[live], -score))[:k]
        out_q.append(np.full(len(best), i))
        out_c.append(c_ids[live[best]])
        out_s.append(score[best])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_q]), np.concatenate([none, *out_c]), np.concatenate([np.zeros(0), *out_s])


def vertical_blocks(candidates: DataFrame, dims: int) -> DataFrame:
    """(ids, columns): the candidates of each partition in blocks, one byte string per dimension; nothing is shuffled."""

    def run(batches):
        for batch in batches:
            m, ids = _matrix(batch.column(1), dims), batch.column(0).to_numpy().astype("<i8")
            for i in range(0, len(ids), CANDIDATES):
                columns = [np.ascontiguousarray(x[i : i + CANDIDATES], "<f8").tobytes() for x in m]
                yield pa.RecordBatch.from_arrays([pa.array([ids[i : i + CANDIDATES].tobytes()]), pa.array([columns], pa.list_(pa.binary()))], names=["ids", "columns"])

    return candidates.select("vec_id", "v").mapInArrow(run, "ids binary, columns array<binary>")


def top_k(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products, ties to the smaller vec_id.

    Both tables hold (vec_id, v array<double>) of integers.  Candidates are staged once in vertical blocks and never move.  Queries
    go in rounds of about QUERIES, dealt by hash; a round is broadcast, every task runs its blocks one after another, each query
    taking its k-th best score so far along as the next block's floor, and k rows per task and query go on to the ranking.
    So what is shuffled grows with queries and tasks, not with candidates.  A query's own vec_id is no candidate.  Null
    vectors and ids take no part; vectors of different lengths are compared as if the shorter ended in zeros; ids are
    taken to be unique.  Sums must stay within 2^53.  Jobs run as this is called.
    """
    queries, candidates = (x.where("v IS NOT NULL AND vec_id IS NOT NULL").select("vec_id", "v") for x in (queries, candidates))
    spark = queries.sparkSession
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    dims = max(1, size["d"] or 0, candidates.agg(F.max(F.size("v")).alias("d")).first()["d"] or 0)
    blocks = stage(vertical_blocks(candidates, dims), "blocks", "none")
    rounds, shape, out = -(-size["n"] // QUERIES), "query_id long, vec_id long, score long", []
    for r in range(rounds):
        part = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == r).toArrow().combine_chunks()
        if not part.num_rows:
            continue
        ids, q = part.column("vec_id").to_numpy(), _matrix(pa.concat_arrays(part.column("v").chunks), dims)
        held = spark.sparkContext.broadcast((ids, q))

        def search(batches, held=held):
            ids, q = held.value
            best_s, best_c = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
            for batch in batches:
                for own, columns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    at, c, s = bound_search(np.stack([np.frombuffer(x, "<f8") for x in columns]), np.frombuffer(own, "<i8"), q, ids, k, best_s[:, -1])
                    edges = np.flatnonzero(np.diff(at, prepend=-1, append=-1))
                    for a, b in zip(edges[:-1], edges[1:], strict=True):
                        i = at[a]
                        all_s, all_c = np.concatenate([best_s[i], s[a:b]]), np.concatenate([best_c[i], c[a:b]])
                        order = np.lexsort((all_c, -all_s))[:k]
                        best_s[i], best_c[i] = all_s[order], all_c[order]
            row, col = np.nonzero(np.isfinite(best_s))
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(best_c[row, col]), pa.array(best_s[row, col].astype(np.int64))], names=["query_id", "vec_id", "score"])

        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        found = blocks.mapInArrow(search, shape).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        out.append(found if rounds == 1 else stage(found, "top"))
    if not out:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows of ``embeddings`` for every row whose vec_id is divisible by 50."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", quantised(F.col("embedding")).alias("v"))
    return top_k(rows.where("vec_id % 50 = 0"), rows, 5)


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
