"""Packing by concatenate and cut: prefix sums give every document its place in one token stream."""

from __future__ import annotations

import os
import re
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.arrowtext import IS_SPACE, LOWER, gathered, passes, string_buffer
from tessella.llm.staging import stage

SEQUENCE, END_ID = 4096, 2
#: Partitions whose offsets (16 bytes each) may be broadcast; beyond it they are joined by shuffling.
MOST_BROADCAST = 100_000

_CLASS = np.full(256, 3, np.uint8)  # digits, apostrophe, controls and all that isn't ASCII
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum() and b != 39]] = 2
_CLASS[IS_SPACE] = 0


def literals(data: np.ndarray, offs: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the added tokens in the documents, leftmost first and the longest of those at one place."""
    raw, found = data.tobytes(), []
    if words and any(w in raw for w in words):
        for m in re.finditer(b"|".join(map(re.escape, sorted(words, key=len, reverse=True))), raw):
            if np.searchsorted(offs, m.start(), "right") == np.searchsorted(offs, m.end() - 1, "right"):
                found.append(m.span())
    s, e = np.array(found, np.int64).reshape(-1, 2).T
    return s, e


def pieces(data: np.ndarray, offs: np.ndarray, words: tuple[bytes, ...] | list[bytes] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the text pieces that a word tokenizer treats on their own.

    Cuts stand at white space and between an ASCII letter and ASCII punctuation other than the apostrophe, where
    neither Unicode composition nor a pre-tokenizer's pattern can reach across.  Each of the added tokens ``words`` is one piece.
    """
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    kind = _CLASS[data]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    cut[1:n] |= (kind[1:] + kind[:-1] == 3) & (kind[1:] != 0) & (kind[:-1] != 0)
    inside = np.zeros(n + 2, bool)
    inside[1 : n + 1] = kind != 0
    for s, e in zip(*literals(data, offs, words), strict=True):
        cut[s + 1 : e] = False
        cut[[s, e]] = inside[s + 1 : e + 1] = True
    starts = np.flatnonzero(inside[1:] & (cut | ~inside[:-1]))
    ends = np.flatnonzero(inside[:-1] & (cut | ~inside[1:]))
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


class PieceIds:
    """The token ids of the pieces met so far, by their bytes, in flat arrays; a pass looks each distinct piece up once."""

    def __init__(self, path: str, most: int = 1 << 20) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.most = most
        self.clear()

    def clear(self) -> None:
        """Forget all pieces; slot 0 is the end of a document."""
        self.slot: dict[bytes, int] = {}
        self.ids, self.used = np.full(1 << 20, END_ID, self.kind), 1
        self.at, self.count, self.held = np.zeros(1 << 16, np.int64), np.ones(1 << 16, np.int64), 1

    def _room(self, name: str, n: int) -> np.ndarray:
        """The array of that name with room for ``n`` items at least."""
        own = getattr(self, name)
        if n > len(own):
            own = np.concatenate([own, np.zeros(max(len(own), n - len(own)), own.dtype)])
            setattr(self, name, own)
        return own

    def add(self, pieces_: list[bytes]) -> None:
        """Encode new pieces.  One of ASCII letters alone is lower case already and one pre-token, so the model takes it as it is."""
        model = self.tokenizer.model
        found = [[t.id for t in model.tokenize(p.decode())] if p.isalpha() else None for p in pieces_]
        rest = [k for k, f in enumerate(found) if f is None]
        for k, x in zip(rest, self.tokenizer.encode_batch([pieces_[k].decode("utf-8", "replace") for k in rest], add_special_tokens=False), strict=True):
            found[k] = x.ids
        count = np.fromiter(map(len, found), np.int64, len(found))
        end, first, held = self.used + int(count.sum()), self.held, self.held + len(found)
        self._room("ids", end)[self.used : end] = np.fromiter(chain.from_iterable(found), self.kind, end - self.used)
        self._room("at", held)[first:held] = self.used + np.cumsum(count) - count
        self._room("count", held)[first:held] = count
        self.slot.update(zip(pieces_, range(first, held), strict=True))
        self.used, self.held = end, held

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the documents one after another, END_ID behind each, and how many each has."""
        starts, ends, doc = pieces(data, offs, self.added)
        coded = gathered(LOWER[data], starts, ends).dictionary_encode()
        _, edges, raw = coded.dictionary.buffers()
        edges, raw = np.frombuffer(edges, np.int64, len(coded.dictionary) + 1).tolist(), raw.to_pybytes() if raw else b""
        words = [raw[a:b] for a, b in pairwise(edges)]
        known = np.fromiter(map(self.slot.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(known < 0)
        if self.held + len(new) > self.most and self.held > 1:
            self.clear()
            new = np.arange(len(words))
        known[new] = np.arange(self.held, self.held + len(new))
        self.add([words[k] for k in new.tolist()])
        n_docs = len(offs) - 1
        slot = np.zeros(len(starts) + n_docs, np.int64)  # a document's pieces, then its end
        slot[np.arange(len(starts)) + doc] = known[coded.indices.to_numpy()]
        count = self.count[slot]
        edges = np.concatenate([[0], np.cumsum(count)])
        source = np.repeat(self.at[slot] - edges[:-1], count) + np.arange(edges[-1])
        last = np.searchsorted(doc, np.arange(n_docs), "right") + np.arange(1, n_docs + 1)
        return self.ids[source], np.diff(edges[last], prepend=0)


_loaded: dict[str, PieceIds] = {}


def tokenize(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, shard, begin, n, ids): ids little-endian, 16 bits each where the vocabulary fits, else 32.

    ``shard`` is the input partition, ``begin`` the number of ids before the document in it: the first pass of
    the prefix sums, taken as the rows stream by.  Null texts are empty and have the end id only.
    """

    def run(batches):
        from pyspark import TaskContext

        shard, begin = TaskContext.get().partitionId(), 0
        if tokenizer not in _loaded:
            _loaded[tokenizer] = PieceIds(tokenizer)
        model = _loaded[tokenizer]
        for batch in batches:
            data, offs = string_buffer(batch.column(1))
            for i, j in passes(offs, 1 << 22):
                ids, sizes = model.encode(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                ends = np.cumsum(sizes)
                edges = np.concatenate([[0], ends * ids.itemsize]).astype(np.int32)
                blob = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(edges), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.full(j - i, shard)), pa.array(begin + ends - sizes), pa.array(sizes), blob], names=["doc_id", "shard", "begin", "n", "ids"])
                begin += int(ends[-1])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shard long, begin long, n long, ids binary")


def prefix_sums(totals: DataFrame, width: int = 1024) -> DataFrame:
    """(shard, base): what all smaller shards hold; in two levels, so that no task ranks more than a block."""
    blocks = totals.withColumn("block", F.floor(F.col("shard") / width))
    inner = Window.partitionBy("block").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    tops = blocks.groupBy("block").agg(F.sum("n").alias("n")).select("block", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("before"))
    return blocks.withColumn("inner", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(tops, "block").select("shard", (F.col("before") + F.col("inner")).alias("base"))


def pack(docs: DataFrame, tokenizer: str, length: int = SEQUENCE) -> DataFrame:
    """Pieces of all documents in sequences of ``length`` ids: one stream, cut at every multiple of ``length``.

    One row per piece with its ids; ``cut_before`` and ``cut_after`` mark the pieces at a window's boundary.  Every
    sequence is full but the last, which is padded to a power of two (``padded``).  Tokens are staged once; the
    second pass adds each partition's offset and cuts.  An empty table gives no rows.
    """
    rows = stage(tokenize(docs, tokenizer), "tokens")
    totals = stage(rows.groupBy("shard").agg(F.sum("n").alias("n")), "totals")
    size = totals.agg(F.count("*").alias("shards"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    base = prefix_sums(totals)
    total = size["n"]
    last, rest = divmod(total, length)
    padded_last = min(length, 1 << (rest - 1).bit_length()) if rest else length
    placed = rows.join(F.broadcast(base) if size["shards"] <= MOST_BROADCAST else base, "shard").select("doc_id", (F.col("base") + F.col("begin")).alias("at"), "n", "ids")

    def cut(batches):
        for batch in batches:
            at, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            if not len(at):
                continue
            first = at // length
            count = (at + n - 1) // length - first + 1
            row = np.repeat(np.arange(len(at)), count)
            seq = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(row))
            begin = np.maximum(at[row], seq * length)
            end = np.minimum(at[row] + n[row], (seq + 1) * length)
            start = begin - at[row]
            raw = batch.column(3)
            blobs, r0, ids = [], -1, None
            for r, s, e in zip(row.tolist(), start.tolist(), (end - at[row]).tolist(), strict=True):
                if r != r0:
                    b = raw[r].as_buffer()
                    ids, r0 = np.frombuffer(b, np.uint16 if len(b) == 2 * n[r] else np.uint32).astype("<u4"), r
                blobs.append(ids[s:e].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(start), pa.array(end - begin), pa.array(n[row]), pa.array(seq), pa.array(begin - seq * length), pa.array(start > 0), pa.array(end < at[row] + n[row]), pa.array(np.where(seq == last, padded_last, length)), pa.array(blobs, pa.binary())],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "cut_before", "cut_after", "padded", "ids"],
            )

    return placed.mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, cut_before boolean, cut_after boolean, padded long, ids binary")


def word_tokenizer() -> str:
    """The path of the public word tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of 4096 ids, one row per piece."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = pack(docs, word_tokenizer())
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded")
