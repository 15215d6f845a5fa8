"""Language-model scores of texts by a weighted backoff automaton whose n-grams are counted over the whole corpus.

Texts are cut into blocks.  Every block lists its n-grams once, each with how often its training texts hold it, and sends them to
buckets by the hash of the n-gram's history.  A bucket adds up what all blocks sent and answers each block in the order that it
asked in.  With the answers a block builds the part of the automaton that its texts walk through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.arrowtext import chain, mix, passes, string_buffer, word_hashes, word_spans
from tessella.llm.staging import stage

#: Text of a block in bytes, n-grams that meet in a bucket about, and tokens of a segment that the automaton reads in one go.
BLOCK_BYTES, BUCKET_GRAMS, SEGMENT = 8 << 20, 1 << 21, 128
#: Hashes of the tokens before and after every text.
START, END = np.uint64(0x5EED0000A11CE001), np.uint64(0x5EED0000A11CE002)
_BLOCK = "block long, doc_id array<bigint>, train array<boolean>, n array<bigint>, stream binary, vocab binary"
_ASK = "block long, bucket long, k int, history binary, sizes binary, word binary, count binary"
_ANSWER = "block long, bucket long, k int, count binary, total binary, types binary, known long, split array<bigint>"
_SCORE = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _names(shape: str) -> list[str]:
    return [c.split()[0] for c in shape.split(", ")]


def blocks(docs: DataFrame) -> DataFrame:
    """Blocks of (doc_id, train, text): ids, flags and token counts of their texts, the tokens numbered, and the numbers' hashes.

    Tokens are lower-cased (A-Z) words and one end; each text is led by one start, which isn't counted.
    """

    def run(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offs = string_buffer(batch.column(2))
            for i, j in passes(offs, BLOCK_BYTES):
                own, cut = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                starts, ends, doc = word_spans(own, cut)
                n = np.bincount(doc, minlength=j - i) + 1
                full = np.full(len(doc) + 2 * (j - i), END)
                first = np.cumsum(n + 1) - n - 1
                full[first] = START
                full[np.arange(len(doc)) + 2 * doc + 1] = word_hashes(own, starts, ends, lower=True)
                vocab, stream = np.unique(full, return_inverse=True)
                packed = pa.compress(stream.astype("<u4").tobytes(), "zstd", asbytes=True)
                whole = np.array([len(full)], "<i8").tobytes() + packed
                values = [pa.array([at]), *(_listed(c) for c in (batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n))), pa.array([whole]), pa.array([vocab.astype("<u8").tobytes()])]
                yield pa.RecordBatch.from_arrays(values, names=_names(_BLOCK))
                at += 1

    return docs.select("doc_id", "train", "text").mapInArrow(run, _BLOCK)


def _listed(col: pa.Array) -> pa.Array:
    """A column as one list."""
    return pa.ListArray.from_arrays(pa.array([0, len(col)], pa.int32()), col)


@dataclass
class Grams:
    """The distinct n-grams of a block with k tokens, by history.

    ``history`` has the sorted hashes of histories, ``owner`` and ``word`` of every n-gram its history's place and its last token;
    ``count`` says how often training texts of the block hold it.  ``place`` are the n-grams' places by ``key`` (rank of the
    history among the block's (k-1)-grams, last token), sorted, and ``context`` those ranks' places in ``history``, -1 if none.
    """

    history: np.ndarray
    owner: np.ndarray
    word: np.ndarray
    count: np.ndarray
    key: np.ndarray
    place: np.ndarray
    context: np.ndarray


class Block:
    """The tokens of one staged row."""

    def __init__(self, row: pa.RecordBatch | pa.Table, i: int = 0):
        get = lambda c: row.column(c)[i]
        self.doc_id, self.train, self.n = get("doc_id").values, get("train").values, get("n").values.to_numpy()
        raw = get("stream").as_buffer()
        size = int(np.frombuffer(raw, "<i8", 1)[0])
        self.stream = np.frombuffer(pa.decompress(raw[8:], 4 * size, "zstd"), "<u4").astype(np.int64)
        self.vocab = np.frombuffer(get("vocab").as_buffer(), "<u8")
        self.first = np.cumsum(self.n + 1) - self.n - 1  # the start of each text
        self.at = np.arange(len(self.stream)) - np.repeat(self.first, self.n + 1)
        self.learnt = np.repeat(np.asarray(self.train.fill_null(False).to_numpy(zero_copy_only=False), bool), self.n + 1)

    def grams(self, order: int) -> list[Grams]:
        """The n-grams of 2 to ``order`` tokens that end at each token but the starts."""
        v = len(self.vocab)
        rank, hashes, out = self.stream, self.vocab, []
        for k in range(2, order + 1):
            end = np.flatnonzero(self.at >= k - 1)
            key, back = np.unique(rank[end - 1] * v + self.stream[end], return_inverse=True)
            count = np.bincount(back, weights=self.learnt[end], minlength=len(key)).astype(np.int64)
            owner, word = key // v, key % v
            by = np.argsort(hashes[owner], kind="stable") if k > 2 else np.arange(len(key))
            new = np.ones(len(key), bool)
            new[1:] = np.diff(owner[by]) != 0
            place = np.empty(len(key), np.int64)
            place[by] = np.arange(len(key))
            context = np.full(len(hashes), -1)
            context[owner[by][new]] = np.arange(np.count_nonzero(new))
            out.append(Grams(hashes[owner[by][new]], np.cumsum(new) - 1, word[by], count[by], key, place, context))
            if k < order:
                hashes = chain(hashes[owner], self.vocab[word])
                rank = np.zeros(len(self.stream), np.int64)
                rank[end] = back
        return out


def _cut(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """One byte string for every stretch between edges."""
    width = values.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64) * width), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _bucket(history: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets in the order of the hashes, so that a block's sorted n-grams are cut, not sorted again."""
    return ((history >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


#: Histories of each order that are split, sorted, and the parts of each.
Splits = dict[int, tuple[np.ndarray, np.ndarray]]


def _part(history: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Hashes that stand for the parts of split histories."""
    return mix(history ^ mix(part.astype(np.uint64) + END))


def split_histories(staged: DataFrame, order: int, most: int) -> Splits:
    """Histories that have more than ``most`` different n-grams in all blocks together, each block's counted, and into how many parts they go.

    Blocks report histories with 16 n-grams or more; what they leave out adds at most 15 records a block to one.  Fewer histories come
    back than the blocks' n-grams by ``most``, about as many as there are buckets.
    """

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                for k, g in enumerate(Block(batch, i).grams(order), 2):
                    sizes = np.bincount(g.owner, minlength=len(g.history))
                    big = np.flatnonzero(sizes >= 16)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(big), k, np.int32)), pa.array(g.history[big].view(np.int64)), pa.array(sizes[big])], names=["k", "h", "n"])

    found = staged.mapInArrow(run, "k int, h long, n long").groupBy("k", "h").agg(F.sum("n").alias("n")).where(F.col("n") > most).collect()
    out: Splits = {}
    for k in range(2, order + 1):
        own = sorted((r.h % (1 << 64), -(-r.n // most)) for r in found if r.k == k)
        out[k] = np.array([h for h, _ in own], np.uint64), np.array([p for _, p in own], np.int64)
    return out


@dataclass
class Request:
    """The n-grams of a block in the order in which they are asked for: split histories by their parts.

    A split history goes to the buckets of its parts, each n-gram to one by its last token; all parts are asked, as the history's own
    counts are the sums of theirs.
    """

    history: np.ndarray
    sizes: np.ndarray
    grams: np.ndarray
    place: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, g: Grams, vocab: np.ndarray, split: tuple[np.ndarray, np.ndarray]) -> Request:
        big, parts = split
        count = np.ones(len(g.history), np.int64)
        at = np.minimum(np.searchsorted(big, g.history), max(0, len(big) - 1))
        hot = big[at] == g.history if len(big) else np.zeros(len(g.history), bool)
        count[hot] = parts[at[hot]] if len(big) else 1
        first = np.cumsum(count) - count
        history = np.repeat(g.history, count)
        inner = np.arange(len(history)) - np.repeat(first, count)
        spread = np.repeat(hot, count)
        history[spread] = _part(history[spread], inner[spread])
        own = first[g.owner] + (vocab[g.word] % count[g.owner].astype(np.uint64)).astype(np.int64)
        order = np.argsort(history, kind="stable")
        place = np.empty(len(history), np.int64)
        place[order] = np.arange(len(history))
        own = place[own]
        return cls(history[order], np.bincount(own, minlength=len(history)), np.argsort(own, kind="stable"), place, first)

    def told(self, count: np.ndarray, often: np.ndarray, types: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Answers in this order as counts of the block's n-grams and of its histories."""
        back = np.empty(len(count), np.int64)
        back[self.grams] = count
        whole = lambda x: np.add.reduceat(x[self.place], self.first) if len(self.first) else x
        return back, whole(often), whole(types)


def asked(staged: DataFrame, order: int, buckets: int, splits: Splits) -> DataFrame:
    """What blocks send to buckets: histories with the number of their n-grams, and of each n-gram 48 bits of its last token and its count."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                b = Block(batch, i)
                for k, g in enumerate(b.grams(order), 2):
                    if not len(g.history):
                        continue
                    r = Request.of(g, b.vocab, splits[k])
                    to = _bucket(r.history, buckets)
                    some = np.unique(to)
                    cells = np.append(np.searchsorted(to, some), len(to))
                    inner = np.append(0, np.cumsum(r.sizes))[cells]
                    words = b.vocab[g.word[r.grams]].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                    columns = [_cut(r.history.astype("<u8"), cells), _cut(r.sizes.astype("<u4"), cells), _cut(words, inner), _cut(g.count[r.grams].astype("<u4"), inner)]
                    same = lambda x, t: pa.array(np.full(len(some), x), t)
                    yield pa.RecordBatch.from_arrays([same(batch.column("block")[i].as_py(), pa.int64()), pa.array(some), same(k, pa.int32()), *columns], names=_names(_ASK))

    return staged.mapInArrow(run, _ASK)


def answered(asked: DataFrame, splits: Splits) -> DataFrame:
    """Counts of all blocks together, for each cell in its own order: of n-grams, and of histories how often and with how many next tokens.

    In a bucket's first row ``known`` is the number of its tokens that training texts hold, and ``split`` has the parts of split ones.
    """
    parts_of = np.sort(np.concatenate([np.zeros(0, np.uint64), *(_part(np.repeat(h, p), np.concatenate([np.arange(x) for x in p])) for h, p in [splits[2]] if len(h))]))

    def group(table: pa.Table) -> pa.Table:
        parts, known, split = [], 0, []
        for k in sorted(set(table.column("k").to_pylist())):
            own = table.filter(pa.compute.equal(table.column("k"), k)).combine_chunks()
            (h, h_at), (size, _), (w, w_at), (c, _) = (string_buffer(own.column(x)) for x in ("history", "sizes", "word", "count"))
            h, size, c = h.view("<u8"), size.view("<u4"), c.view("<u4").astype(np.int64)
            wide = np.zeros((len(c), 8), np.uint8)
            wide[:, :6] = w.reshape(-1, 6)
            w, owner = wide.view("<u8").ravel(), np.repeat(h, size)
            order = np.lexsort((w, owner))
            owner, w = owner[order], w[order]
            first = np.ones(len(w), bool)
            first[1:] = owner[1:] != owner[:-1]
            new = first.copy()
            new[1:] |= w[1:] != w[:-1]
            total = np.add.reduceat(c[order], np.flatnonzero(new)) if len(c) else c
            count = np.empty(len(c), np.int64)
            count[order] = total[np.cumsum(new) - 1]
            begin = np.flatnonzero(first[new])
            kinds = np.append(owner[first], np.uint64(2**64 - 1))
            often, types = (np.append(np.add.reduceat(x, begin) if len(begin) else x, 0) for x in (total, (total > 0).astype(np.int64)))
            if k == 2:
                there = kinds[:-1][(often[:-1] > 0) & (kinds[:-1] != START)]
                split = there[np.isin(there, parts_of)].view(np.int64).tolist()
                known = len(there) - len(split)
            at = np.searchsorted(kinds[:-1], h)
            at[kinds[at] != h] = len(kinds) - 1  # a part that no block has n-grams of
            answer = [_cut(count, w_at // 6), _cut(often[at], h_at // 8), _cut(types[at], h_at // 8)]
            parts.append(pa.table([own.column("block"), own.column("bucket"), own.column("k"), *answer, pa.array(np.zeros(own.num_rows, np.int64))], names=_names(_ANSWER)[:-1]))
        out = pa.concat_tables(parts)
        first_only = np.zeros(out.num_rows, np.int64)
        first_only[0] = known
        return out.set_column(6, "known", pa.array(first_only)).append_column("split", pa.array([split] + [[]] * (out.num_rows - 1), pa.list_(pa.int64())))

    return asked.groupBy("bucket").applyInArrow(group, _ANSWER)


class Automaton:
    """States for histories, arcs for n-grams that training texts hold, and one failure arc a state to its next shorter history.

    State 0 has no history; there every token has an arc.  Probabilities are Witten-Bell's: with c n-grams of t kinds after a history,
    p = (count + t * p of the shorter history) / (c + t), so an arc weighs log10 p and a failure arc log10 (t / (c + t)).
    """

    def __init__(self, levels: list[Grams], answers: list[tuple[np.ndarray, np.ndarray, np.ndarray]], p_token: np.ndarray):
        v = self.words = len(p_token)
        self.root_weight, states = np.log10(p_token), 1
        self.root_next = np.zeros(v, np.int64)
        fail, fail_weight = [np.zeros(1, np.int64)], [np.zeros(1)]
        keys, weights, nexts = [], [], []
        p_lower, next_lower, key_lower = p_token, self.root_next, np.arange(v)  # of the (k-1)-grams, by rank
        shorter_state = np.zeros(v, np.int64)  # state of the history without its first token, by rank
        numbered = []
        for g, (_, often, _) in zip(levels, answers, strict=True):
            state = np.where(often > 0, np.cumsum(often > 0) - 1 + states, 0)
            states += np.count_nonzero(often)
            numbered.append(np.where(g.context >= 0, state[g.context], 0) if len(state) else np.zeros(len(g.context), np.int64))
        self.root_next[:] = numbered[0] if numbered else 0
        for k, (g, (count, often, types)) in enumerate(zip(levels, answers, strict=True)):
            by_rank = numbered[k]
            known = np.flatnonzero(often > 0)
            rank_of = np.empty(len(g.history), np.int64)
            rank_of[g.context[g.context >= 0]] = np.flatnonzero(g.context >= 0)
            fail.append(shorter_state[rank_of[known]])
            fail_weight.append(np.log10(types[known] / (often[known] + types[known])))
            history, word = g.key // v, g.key % v  # n-grams by rank from here on
            at = g.place
            owner = g.owner[at]
            suffix = word if k == 0 else np.searchsorted(key_lower, suffix[history] * v + word)
            c, n, t = count[at], often[owner], types[owner]
            p = np.where(n > 0, (c + t * p_lower[suffix]) / np.maximum(n + t, 1), p_lower[suffix])
            after = next_lower[suffix]
            longer = np.where(numbered[k + 1] > 0, numbered[k + 1], after) if k + 1 < len(levels) else after
            arc = c > 0
            keys.append(by_rank[history[arc]] * v + word[arc])
            weights.append(np.log10(p[arc]))
            nexts.append(longer[arc])
            shorter_state = self.root_next[word] if k == 0 else numbered[k][suffix]
            p_lower, next_lower, key_lower = p, longer, g.key
        self.fail, self.fail_weight = np.concatenate(fail), np.concatenate(fail_weight)
        key = np.concatenate([np.zeros(0, np.int64), *keys])
        order = np.argsort(key)
        self.key = np.append(key[order], np.iinfo(np.int64).max)
        self.weight = np.append(np.concatenate([np.zeros(0), *weights])[order], 0.0)
        self.next = np.append(np.concatenate([np.zeros(0, np.int64), *nexts])[order], 0)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after a token each, and the log-probabilities on the way: failure arcs until an arc takes the token."""
        weight, after = np.zeros(len(state)), np.empty(len(state), np.int64)
        live = np.arange(len(state))
        while len(live):
            s, w = state[live], word[live]
            target = s * self.words + w
            at = np.searchsorted(self.key, target)
            hit, root = (self.key[at] == target) & (s > 0), s == 0
            weight[live[hit]] += self.weight[at[hit]]
            after[live[hit]] = self.next[at[hit]]
            weight[live[root]] += self.root_weight[w[root]]
            after[live[root]] = self.root_next[w[root]]
            on = ~hit & ~root
            weight[live[on]] += self.fail_weight[s[on]]
            state = state.copy()
            state[live[on]] = self.fail[s[on]]
            live = live[on]
        return after, weight

    def read(self, stream: np.ndarray, first: np.ndarray, n: np.ndarray, order: int) -> np.ndarray:
        """Sum of log-probabilities of each text: token by token from left to right, all segments of all texts side by side.

        A segment starts in the state that the order - 1 tokens before it lead to, which is the state of a reader from the text's start.
        """
        count = -(-n // SEGMENT)
        text = np.repeat(np.arange(len(n)), count)
        start = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * SEGMENT
        size = np.minimum(n[text] - start, SEGMENT)
        by = np.argsort(-size, kind="stable")
        begin, size = (first[text] + 1 + start)[by], size[by]
        state, total = np.zeros(len(by), np.int64), np.zeros(len(by))
        for back in range(order - 1, 0, -1):
            warm = np.flatnonzero(begin - back >= first[text[by]])
            state[warm], _ = self.step(state[warm], stream[begin[warm] - back])
        for k in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size, -k, "left"))
            state[:live], weight = self.step(state[:live], stream[begin[:live] + k])
            total[:live] += weight
        out = np.empty(len(by))
        out[by] = total
        return np.bincount(text, weights=out, minlength=len(n))


def language_model_scores(docs: DataFrame, train: Column, order: int = 2) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every whole text, learning from rows where ``train`` is true.

    ``score`` is the log10 probability of a text's tokens (words and one end) under n-grams of up to ``order`` tokens, ``base_score`` that
    of single tokens counted once more each.  Nothing is pruned, capped or sampled: the model grows with the corpus and no task
    holds more of it than its block or bucket needs.  An n-gram goes once a block to its bucket, so frequent ones make as many
    records as there are blocks; histories with very many next tokens are split over buckets by these.  Equal texts get equal scores.  Null and empty texts are one end; rows whose ``train`` is null aren't
    learnt from; repeated rows count and come out once each; an empty table gives no rows; without training texts all
    tokens are unknown.  Histories are known by 64 bits, next tokens of one history by 48.  Jobs run as this is called.
    """
    if order < 2:
        raise ValueError("the order is 2 at least")
    spark = docs.sparkSession
    staged = stage(blocks(docs.select("doc_id", train.alias("train"), "text")), "blocks", "none")
    size = staged.agg(F.sum(F.expr("aggregate(n, 0L, (a, x) -> a + x)")).alias("all"), F.sum(F.expr("aggregate(zip_with(n, train, (x, t) -> IF(t, x, 0L)), 0L, (a, x) -> a + x)")).alias("learnt")).first()
    if size["all"] is None:
        return spark.createDataFrame([], _SCORE).withColumn("train_tokens", F.lit(0).cast("long"))
    learnt = size["learnt"]
    splits = split_histories(staged, order, BUCKET_GRAMS // 4)
    answers = stage(answered(asked(staged, order, 1 + size["all"] * (order - 1) // BUCKET_GRAMS, splits), splits), "answers")
    there = {r.h % (1 << 64) for r in answers.select(F.explode("split").alias("h")).collect()}  # fewer than the parts of split histories
    whole = sum(not there.isdisjoint(_part(np.full(p, h), np.arange(p)).tolist()) for h, p in zip(*splits[2], strict=True) if h != START)
    known = answers.agg(F.sum("known")).first()[0] + whole + (learnt > 0)  # the end is a token, too

    def score(key, mine: pa.Table, told: pa.Table) -> pa.Table:
        b = Block(mine)
        levels, got = b.grams(order), []
        told = told.sort_by([("k", "ascending"), ("bucket", "ascending")])
        for k in range(2, order + 1):
            own = told.filter(pa.compute.equal(told.column("k"), k)).combine_chunks()
            answer = (string_buffer(own.column(c))[0].view("<i8") for c in ("count", "total", "types"))
            got.append(Request.of(levels[k - 2], b.vocab, splits[k]).told(*answer))
        often = np.zeros(len(b.vocab), np.int64)
        held = levels[0].context >= 0
        often[held] = got[0][1][levels[0].context[held]]
        at_end, at_start = np.searchsorted(b.vocab, [END, START])
        often[at_end], often[at_start] = often[at_start], 0  # as many ends as starts; no start is counted as a token
        p = (often + 1) / (learnt + known + 1)
        total = Automaton(levels, got, p).read(b.stream, b.first, b.n, order)
        token = np.flatnonzero(b.at > 0)
        text = np.repeat(np.arange(len(b.n)), b.n)
        base = np.bincount(text, weights=np.log10(p)[b.stream[token]], minlength=len(b.n))
        seen = np.bincount(text, weights=(often > 0)[b.stream[token]], minlength=len(b.n)).astype(np.int64)
        return pa.table([b.doc_id, pa.array(b.n), pa.array(seen), pa.array(base), pa.array(total)], names=_names(_SCORE))

    return staged.groupBy("block").cogroup(answers.drop("known", "split").groupBy("block")).applyInArrow(score, _SCORE).withColumn("train_tokens", F.lit(learnt).cast("long"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents`` under bigrams learnt from those whose checksum of the id modulo 7 isn't 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = lambda: F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return language_model_scores(docs, ~held(), 2).withColumn("held_out", held()).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


OP13_SQL = r"""
WITH d AS (SELECT doc_id, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ord(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))),
    lambda c, x: list_reduce(list_concat([xor(c, x)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)), 4294967295) % 7 = 2 AS held_out,
  list_concat([' start'], regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), [' end']) AS ws FROM documents),
t AS (SELECT doc_id, held_out, ws[i] AS h, ws[i + 1] AS w FROM (SELECT *, unnest(range(1, len(ws))) AS i FROM d)),
c2 AS (SELECT h, w, count(*) AS c FROM t WHERE NOT held_out GROUP BY ALL),
ch AS (SELECT h, sum(c) AS c, count(*) AS t FROM c2 GROUP BY ALL),
c1 AS (SELECT w, sum(c) AS c FROM c2 GROUP BY ALL),
g AS (SELECT sum(c) AS n, count(*) AS v FROM c1),
p AS (SELECT t.*, coalesce(c1.c, 0) > 0 AS known, (coalesce(c1.c, 0) + 1) / CAST(n + v + 1 AS DOUBLE) AS p1, n AS train_tokens FROM t CROSS JOIN g LEFT JOIN c1 USING (w))
SELECT doc_id, held_out, count(*) AS n_tokens, CAST(count(*) FILTER (known) AS BIGINT) AS n_known, CAST(any_value(train_tokens) AS BIGINT) AS train_tokens, sum(log10(p1)) AS base_score,
  sum(log10(CASE WHEN ch.c IS NULL THEN p1 ELSE (coalesce(c2.c, 0) + ch.t * p1) / CAST(ch.c + ch.t AS DOUBLE) END)) AS score
FROM p LEFT JOIN ch USING (h) LEFT JOIN c2 USING (h, w) GROUP BY doc_id, held_out
"""
