"""MinHash near-dedup over an LSH forest, every link confirmed on the full shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.arrowtext import chain, mix, passes, string_buffer, word_hashes, word_spans
from tessella.llm.components import components, contracted
from tessella.llm.packing import prefix_sums
from tessella.llm.staging import stage

#: Minima in a tree's signature, and how many of them neighbours share at least.
DEPTH, LEAST_DEPTH = 6, 2
#: Documents of a region that are all paired with each other; a larger one is crowded and goes deeper.
SMALL_REGION = 16
#: Shingles of a prefix that travel with each of its rows, to tell whether a pair has met before.
LEAD = 16
#: Rows of a tree's order that one task holds about.
ORDER_ROWS = 250_000
#: Ids that may be broadcast to filter texts (8 bytes each); more are joined by shuffling.
MOST_BROADCAST = 1_000_000


def shingle_sets(data: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each document, sorted, one document after another, and their offsets.

    Words are lower-cased (A-Z).  A document with fewer words than a shingle has its whole sequence as one, one
    without words has none.
    """
    starts, ends, doc = word_spans(data, offs)
    word = word_hashes(data, starts, ends, lower=True)
    count = np.bincount(doc, minlength=len(offs) - 1)
    first = np.cumsum(count) - count
    hashes, owners = [], []
    for n in range(1, words + 1):
        begin = first[count == n] if n < words else np.flatnonzero(np.arange(len(doc)) + words <= (first + count)[doc])
        h = np.full(len(begin), n, np.uint64)
        for k in range(n):
            h = chain(h, word[begin + k])
        hashes.append(h)
        owners.append(doc[begin])
    s, d = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    s, d = s[new], d[new]
    return s, np.searchsorted(d, np.arange(len(offs)))


def _factors(n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(7)).integers(1 << 40, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


def signatures(docs: DataFrame, words: int, trees: int) -> DataFrame:
    """(doc_id, n_shingles, fp1, fp2, sigs): set size, set fingerprint and, for every tree, its DEPTH minima, four bytes each,
    big-endian.  Documents with empty sets have no signatures."""
    factors = _factors(trees * DEPTH)

    def run(batches):
        for batch in batches:
            data, offs = string_buffer(batch.column(1))
            for i, j in passes(offs):
                s, edges = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], words)
                n = np.diff(edges)
                some = np.flatnonzero(n)
                fp = np.zeros((2, j - i), np.uint64)
                sigs = np.zeros((len(some), trees * DEPTH), ">u4")
                if len(some):
                    at = edges[:-1][some]
                    for f in range(2):
                        fp[f, some] = np.add.reduceat(mix(s + np.uint64(0x9E3779B97F4A7C15 * (f + 1) & (2**64 - 1))), at)
                    for k, factor in enumerate(factors):
                        sigs[:, k] = mix(np.minimum.reduceat(s * factor, at)) >> np.uint64(32)
                lists = np.concatenate([[0], np.cumsum((n > 0) * trees)]).astype(np.int32)
                width = pa.array(np.arange(len(some) * trees + 1, dtype=np.int32) * (4 * DEPTH))
                flat = pa.Array.from_buffers(pa.binary(), len(some) * trees, [None, width.buffers()[1], pa.py_buffer(sigs.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), *(pa.array(f.view(np.int64)) for f in fp), pa.ListArray.from_arrays(pa.array(lists), flat)], names=["doc_id", "n_shingles", "fp1", "fp2", "sigs"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, fp1 long, fp2 long, sigs array<binary>")


def neighbours(tree: np.ndarray, sig: np.ndarray, small: int = SMALL_REGION) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows in the order of (tree, signature): the places i < j of pairs of neighbours, and which rows lie in a crowded region.

    A region is a run of rows whose adjacent rows have a common prefix of some depth.  From LEAST_DEPTH on, a region of up
    to ``small`` rows is paired completely, a larger one is crowded and divided again one minimum deeper, so the depth follows
    each region.  In crowded regions every row also meets its longest-common-prefix neighbour on either side.
    """
    n = len(tree)
    same = np.cumprod(np.concatenate([(tree[1:] == tree[:-1])[:, None], sig[1:] == sig[:-1]], axis=1), axis=1)
    common = same.sum(1) - 1  # depth that row i shares with row i + 1; -1 across trees
    lo, hi = [], []
    live = crowded = np.ones(n, bool)
    for depth in range(LEAST_DEPTH, DEPTH + 1):
        region = np.concatenate([[0], np.cumsum(common < depth)])
        size = np.bincount(region)[region]
        whole = live & (size > 1) & (size <= small)
        for step in range(1, small):
            i = np.flatnonzero(whole[: max(0, n - step)])
            i = i[region[i] == region[i + step]]
            if not len(i):
                break
            lo.append(i)
            hi.append(i + step)
        live = live & (size > small)
        if depth == LEAST_DEPTH:
            crowded = live
            i = np.flatnonzero(live[:-1] & (region[:-1] == region[1:]))
            lo.append(i)
            hi.append(i + 1)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *lo]), np.concatenate([none, *hi]), crowded


def candidates(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lo, hi, votes): pairs of documents that are neighbours in some tree's order; (doc_id): those of crowded regions.

    The rows of all trees are sorted by signature in ranges that Spark balances, so a region of any size is spread over tasks.  Each
    task pairs neighbours batch by batch, with the last rows of the batch before; the first and last rows of the ranges are kept
    and meet those of the next range, so that a region across an edge is seen as one.  Pairs grow with documents, never with
    the square of a region.  Pairs of a crowded region that this leaves out are found by ``rare_pairs``.
    """
    rows = reps.select("doc_id", F.posexplode("sigs").alias("tree", "sig"))
    n = rows.count()
    order = ["tree", "sig", F.xxhash64("doc_id"), "doc_id"]
    least = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(max(least, -(-n // ORDER_ROWS)), *order).sortWithinPartitions(*order)
    shape = "kind string, lo long, hi long, shard long, at long, tree int, sig binary"
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    names = [c.split()[0] for c in shape.split(", ")]

    def found(ids, tree, sig) -> pa.RecordBatch:
        i, j, crowded = neighbours(tree, sig)
        lo, hi, alone = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), np.unique(ids[crowded])
        kind = np.repeat(np.array(["pair", "crowded"], object), [len(lo), len(alone)])
        cols = [pa.array(kind, types[0]), pa.array(np.concatenate([lo, alone])), pa.array(np.concatenate([hi, alone])), *(pa.nulls(len(kind), t) for t in types[3:])]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def matrix(col: pa.Array) -> np.ndarray:
        return string_buffer(col)[0].view(">u4").reshape(-1, DEPTH).astype(np.uint32)

    def run(batches):
        from pyspark import TaskContext

        shard, total, head, tail = TaskContext.get().partitionId(), 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2))]
            yield found(*own)
            if tail is not None:
                yield found(*(np.concatenate([a, b[:SMALL_REGION]]) for a, b in zip(tail, own, strict=True)))
            if head is None or len(head[0]) < SMALL_REGION:
                head = [x[:SMALL_REGION] for x in own] if head is None else [np.concatenate([a, b])[:SMALL_REGION] for a, b in zip(head, own, strict=True)]
            tail = [x[-SMALL_REGION:] for x in (own if tail is None else [np.concatenate([a, b]) for a, b in zip(tail, own, strict=True)])]
            total += batch.num_rows
        if total:  # negative places count from the range's end; a range of few rows is an edge as a whole
            few = max(0, total - len(head[0]))
            edge = [np.concatenate([a, b[max(0, len(b) - few) :]]) for a, b in zip(head, tail, strict=True)]
            at = np.concatenate([np.arange(len(head[0])), np.arange(-min(few, len(tail[0])), 0)])
            k = len(at)
            cols = [["edge"] * k, edge[0], [total] * k, [shard] * k, at, edge[1], [x.astype(">u4").tobytes() for x in edge[2]]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    met = stage(sorted_.mapInArrow(run, shape), "neighbours", by=["kind"])
    edges = met.where("kind = 'edge'").withColumn("whole", F.col("hi") >= 2 * SMALL_REGION)
    before = stage(prefix_sums(edges.groupBy("shard").agg(F.max(F.col("whole").cast("long")).alias("n"))), "edges")
    edges = edges.join(before, "shard").withColumn("gap", F.col("base") + F.when(F.col("whole") & (F.col("at") < 0), 1).otherwise(0))

    def across(table: pa.Table) -> pa.Table:
        table = table.sort_by([("shard", "ascending"), ("later", "ascending"), ("at", "ascending")]).combine_chunks()
        sig = table.column("sig").combine_chunks()
        return pa.Table.from_batches([found(table.column("lo").to_numpy(), table.column("tree").to_numpy(), matrix(sig.chunk(0) if isinstance(sig, pa.ChunkedArray) else sig)).select(["kind", "lo", "hi"])])

    joined = edges.select("gap", "shard", (F.col("at") < 0).cast("int").alias("later"), "at", "lo", "tree", "sig").groupBy("gap").applyInArrow(across, "kind string, lo long, hi long")
    every = met.where("kind <> 'edge'").select("kind", "lo", "hi").unionByName(stage(joined, "across"))
    pairs = every.where("kind = 'pair' AND lo < hi").groupBy("lo", "hi").agg(F.count("*").alias("votes"))
    return pairs, every.where("kind = 'crowded'").select(F.col("lo").alias("doc_id")).distinct()


def prefix_sides(first: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The two sides of the join of prefixes (doc_id, n, g, h, at, before, indexed), by shingle and class of set size.

    Of a similar pair the smaller set comes from the indexed side.  What is left of it from the shared shingle on bounds the other's
    size, so a group is sent to the classes (of 5 %) between its smallest set and the largest that can still match; the other side
    has a row for each class that its sets lie in.  Sets whose shared shingles come too late to be indexed, such as
    those of a template that differ in more than they share, have no row on the first side and match nothing.
    """
    size = lambda n: F.floor(F.log(n) * 20)
    alone = F.when(F.col("docs") == 1, F.col("before")).otherwise(F.expr("CAST(array() AS array<bigint>)"))
    common = [F.min("n").alias("least"), F.max(F.col("n") - F.col("at")).alias("left"), F.count("*").alias("docs"), F.first("before").alias("before")]
    reach = F.expr(f"least(100 * n DIV {percent}, ({100 + percent} * (n - at) - {percent} * n) DIV {percent})")
    x = first.where("indexed").groupBy("h", "g").agg(*common, F.max(reach).alias("reach")).withColumn("before", alone).where("reach >= least")
    x = x.withColumn("size", F.explode(F.sequence(size(F.col("least")), size(F.col("reach")))))
    y = first.groupBy("h", "g", size(F.col("n")).alias("size")).agg(*common, F.max("n").alias("most")).withColumn("before", alone)
    put = lambda df, k: stage(df.select("h", "size", *(F.col(c).alias(f"{k}_{c}") for c in df.columns if c not in ("h", "size", "docs"))), f"prefixes-{k}")
    return put(x, "x"), put(y, "y")


def rare_pairs(texts: DataFrame, group: DataFrame, words: int, percent: int) -> DataFrame:
    """(lo, hi): every pair of ``texts`` (doc_id, text) in different groups (id, component) that can be similar enough.

    An exact prefix filter.  In one order of all shingles, rarest first, the sets x, y of a similar pair, |x| <= |y|, share one
    of the first |x| - a + 1 of x and |y| - b + 1 of y, where a = 2t / (1 + t) |x| and b = t |y| bound the overlap.  Shingles
    of one document only count for these numbers and are dropped.  Groups meet by shingle and size (``prefix_sides``) before their
    documents do, so a large group whose members are connected makes no pairs among them.  A pair counts at the first shingle
    that both share (of the LEAD ones before it that are kept), where its places also bound the overlap by what is left of either
    set; groups of one document are held to that when they meet.
    """

    def run(batches):
        for batch in batches:
            data, offs = string_buffer(batch.column(1))
            for i, j in passes(offs):
                s, edges = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], words)
                lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(s.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(edges)), lists], names=["doc_id", "n", "shingles"])

    sets = stage(texts.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, shingles array<long>"), "crowded-sets")
    each = sets.select("doc_id", "n", F.explode("shingles").alias("h"))
    shared = stage(each.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "shared-shingles")
    first = each.join(shared, "h").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("order"))
    first = first.withColumn("alone", F.col("n") - F.size("order")).withColumn("probe", F.expr(f"n - ({percent} * n + 99) DIV 100 + 1"))
    first = first.withColumn("index", F.expr(f"n - ({2 * percent} * n + {99 + percent}) DIV {100 + percent} + 1")).where("probe > alone")
    first = first.join(group.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("g", F.coalesce("component", "doc_id"))
    first = first.withColumn("lead", F.expr(f"transform(slice(order, 1, {LEAD}), s -> s.h)"))
    first = first.select("doc_id", "n", "g", "alone", "index", "lead", F.posexplode(F.expr("slice(order, 1, CAST(probe - alone AS INT))")).alias("at", "s"))
    first = stage(first.select("doc_id", "n", "g", F.col("s.h").alias("h"), (F.col("alone") + F.col("at")).alias("at"), F.expr(f"slice(lead, 1, least(at, {LEAD}))").alias("before"), F.expr("alone + at < index").alias("indexed")), "prefixes")
    side = lambda df, x: df.select("h", *(F.col(c).alias(f"{x}_{c}") for c in df.columns if c != "h"))
    x, y = prefix_sides(first, percent)
    met = x.join(y, ["h", "size"]).where(f"x_g <> y_g AND y_most >= x_least AND {100 + percent} * least(x_left, y_left) >= {percent} * (x_least + y_least) AND NOT arrays_overlap(x_before, y_before)")
    met = stage(met.select("h", F.least("x_g", "y_g").alias("a"), F.greatest("x_g", "y_g").alias("b")).distinct(), "met")
    docs = stage(first.groupBy("h", "g").agg(F.count("*").alias("docs")), "prefix-groups")
    of = lambda k: docs.select("h", F.col("g").alias(k), F.col("docs").alias(f"{k}_docs"))
    swap = F.col("b_docs") < F.col("a_docs")
    met = met.join(of("a"), ["h", "a"]).join(of("b"), ["h", "b"]).select("h", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("x_g"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("y_g"))
    half = stage(met.join(side(first, "x"), ["h", "x_g"]), "half-pairs")  # x is the smaller of the groups
    smaller = F.expr("struct(x_n, x_doc_id) < struct(y_n, y_doc_id)")
    near = F.when(smaller, F.col("x_indexed")).otherwise(F.col("y_indexed")) & F.expr(f"100 * least(x_n, y_n) >= {percent} * greatest(x_n, y_n) AND {100 + percent} * least(x_n - x_at, y_n - y_at) >= {percent} * (x_n + y_n)")
    pairs = half.join(side(first, "y"), ["h", "y_g"]).where(near & ~F.expr("arrays_overlap(x_before, y_before)"))
    return pairs.select(F.least("x_doc_id", "y_doc_id").alias("lo"), F.greatest("x_doc_id", "y_doc_id").alias("hi")).distinct()


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The (lo, hi) of ``pairs`` whose full shingle sets have 100 * intersection >= percent * union."""
    a = pairs.alias("p").join(texts.alias("t"), F.col("p.hi") == F.col("t.doc_id")).select("lo", "hi", F.col("text").alias("hi_text"))
    b = a.alias("p").join(texts.alias("t"), F.col("p.lo") == F.col("t.doc_id")).select("lo", "hi", "hi_text", F.col("text").alias("lo_text"))

    def run(batches):
        for batch in batches:
            (x, xo), (y, yo) = string_buffer(batch.column(2)), string_buffer(batch.column(3))
            for i, j in passes(xo + yo):
                s, row, size = [], [], []
                for data, offs in ((x, xo), (y, yo)):
                    h, edges = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], words)
                    s.append(h)
                    size.append(np.diff(edges))
                    row.append(np.repeat(np.arange(j - i), size[-1]))
                h, r = np.concatenate(s), np.concatenate(row)
                order = np.lexsort((h, r))
                h, r = h[order], r[order]
                both = np.bincount(r[1:][(h[1:] == h[:-1]) & (r[1:] == r[:-1])], minlength=j - i)
                union = size[0] + size[1] - both
                good = pa.array(np.flatnonzero((100 * both >= percent * union) & (union > 0)) + i)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(good), batch.column(1).take(good)], names=["lo", "hi"])

    return b.mapInArrow(run, "lo long, hi long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, trees: int = 16) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): groups of documents that links of similar sets connect.

    Documents with equal sets (128-bit fingerprints) are one member of the forest, however many they are.  Every
    candidate pair is confirmed on whole texts unless earlier links already connect it: first each document with
    the partner that most regions name, then all pairs that these links haven't been seen to connect, then all pairs of
    documents of crowded regions that an exact prefix filter finds in different groups.  So a pair is compared wherever it shares
    a region of any tree, and only one that shares none is missed: at similarity 0.8 with probability 0.36^16 = 8e-8.  Null
    and empty texts are linked with nothing, and so are rows without doc_id, which otherwise identifies documents; an empty
    table gives no rows.  Jobs run as this is called.
    """
    sigs = stage(signatures(docs, words, trees), "signatures")
    sets = stage(sigs.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep")), "sets")
    member = stage(sigs.select("doc_id", "n_shingles", "fp1", "fp2").join(sets, ["fp1", "fp2"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("rep")), "members")
    reps = sigs.join(member.where("n_shingles > 0 AND doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi").drop("n_shingles", "fp1", "fp2")
    pairs, crowded = candidates(reps)
    pairs, crowded = stage(pairs, "pairs"), stage(crowded, "crowded")
    ids = stage(pairs.select(F.explode(F.array("lo", "hi")).alias("doc_id")).distinct(), "ids")
    wanted = F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids
    texts = stage(docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi"), "texts")
    best = pairs.groupBy("hi").agg(F.expr("max_by(lo, struct(votes, -lo))").alias("lo")).select("lo", "hi")
    first = stage(confirm(best, texts, words, percent), "links")
    edges = contracted(first.select(F.col("lo").alias("a"), F.col("hi").alias("b")), rounds=2)
    group = stage(edges.groupBy("u").agg(F.min("v").alias("v")), "groups")  # ids that share a star are connected; those still apart are compared
    a, b = (group.select(F.col("u").alias(x), F.col("v").alias(f"{x}_group")) for x in ("lo", "hi"))
    apart = pairs.join(best, ["lo", "hi"], "left_anti").join(a, "lo", "left").join(b, "hi", "left").where("coalesce(lo_group, lo) <> coalesce(hi_group, hi)").select("lo", "hi")
    second = stage(confirm(stage(apart, "apart"), texts, words, percent), "links")
    stars = edges.select(F.col("v").alias("a"), F.col("u").alias("b")).unionByName(second.select(F.col("lo").alias("a"), F.col("hi").alias("b")))
    stars = stage(components(stars), "stars")
    rare = stage(rare_pairs(texts.join(crowded, "doc_id", "left_semi"), stars, words, percent), "rare-pairs")
    third = stage(confirm(rare, texts, words, percent), "links")
    links = third.select(F.col("lo").alias("a"), F.col("hi").alias("b")).unionByName(stars.select(F.col("id").alias("a"), F.col("component").alias("b")))
    whole = stars if third.isEmpty() else components(links)
    rows = member.join(whole.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near duplicates among whole ``documents``, on 4-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4)


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * k >= 80 * (x.n + y.n - k)),
c(id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, c.root FROM c JOIN l ON c.id = l.a),
m AS (SELECT id, min(root) AS root FROM c GROUP BY 1)
SELECT n.doc_id, n.n AS n_shingles, root AS component_id, root = n.doc_id AS kept FROM n JOIN m ON n.doc_id = m.id
"""
