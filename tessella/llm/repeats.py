"""Exact repeated windows of tokens: which windows of L tokens also start in a document with a smaller id.

Every window names an anchor, the k-gram in it that comes first in a fixed random order, so equal windows name equal
anchors at equal places.  The windows of one anchor occurrence form one span (the anchor extended both ways).
Round one exchanges one record per anchor occurrence: spans that a smaller document holds are settled, and so are
spans whose anchor no other document extends alike.  Only where different spans share an anchor with a half of
what a window needs (the ends of a repeat) round two exchanges the single windows.

Texts travel packed, a chunk of about 1 MB in a row.  A chunk sends each key once, with its smallest document, to the
key's bucket, and gets one or two bits a key back: a passage in a third of all documents costs a record per chunk.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.arrowtext import chain, mix, passes, span_hashes, string_buffer, word_hashes, word_spans
from tessella.llm.staging import stage

#: Text of one bucket's keys, and the least and most buckets.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 1 << 22, 128, 1 << 16
#: Tokens of an anchor.
ANCHOR = {"words": 6, "bytes": 16}
U = np.uint64


#: Bytes sent of a record's columns: of a span its anchor (after the bucket's bits), its hash, both sides, its document
#: (from the chunk's smallest); of a window its hash, its anchor's and its document.  Two spans are held to be equal by 95 bits or
#: more, two windows by 87 or more, 63 or more of them their own even where the anchors are the same.
SPAN, WINDOW = (3, 8, 1, 1, 8), (7, 3, 8)


def _squeeze(arrays: list[np.ndarray], widths: tuple[int, ...]) -> bytes:
    """The low bytes of 64-bit columns of one length, as compressed byte planes."""
    import zstandard

    planes = [np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(len(a), 8)[:, :w].T).tobytes() for a, w in zip(arrays, widths, strict=True)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _spread(blob: bytes, widths: tuple[int, ...]) -> list[np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = len(raw) // sum(widths)
    out, at = [], 0
    for w in widths:
        full = np.zeros((n, 8), np.uint8)
        full[:, :w] = raw[at : at + n * w].reshape(w, n).T
        out.append(full.view("<u8").reshape(n))
        at += n * w
    return out


def _pack(ids: np.ndarray, lens: np.ndarray, text: bytes) -> list[bytes]:
    import zstandard

    return [ids.astype("<i8").tobytes(), lens.astype("<i8").tobytes(), zstandard.ZstdCompressor(level=5).compress(text)]


def _unpack(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, byte offsets and bytes of a chunk."""
    import zstandard

    offs = np.concatenate([[0], np.cumsum(np.frombuffer(parts[1], "<i8"))])
    return np.frombuffer(parts[0], "<i8"), offs, np.frombuffer(zstandard.ZstdDecompressor().decompress(parts[2]), np.uint8)


def pack_chunks(docs: DataFrame) -> DataFrame:
    """(chunk, text_bytes, parts): documents in packed rows of about 1 MB of text; null texts are empty."""

    def run(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offs = string_buffer(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j in passes(offs):
                parts = _pack(ids[i:j], np.diff(offs[i : j + 1]), data[offs[i] : offs[j]].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([int(offs[j] - offs[i])]), pa.array([parts], pa.list_(pa.binary()))], names=["chunk", "text_bytes", "parts"])
                chunk += 1

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(run, "chunk long, text_bytes long, parts array<binary>")


class Tokens:
    """A chunk's tokens: their codes, each document's offsets among them, and each token's bytes."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, kind: str) -> None:
        if kind == "bytes":
            self.codes, self.offs, self.raw, self.unit = data, offs, data, 1
            self.first = np.zeros(len(data), bool)
            self.first[:-2] = (data[:-2] > data[1:-1]) & (data[1:-1] < data[2:])
        else:
            starts, ends, doc = word_spans(data, offs)
            self.codes = word_hashes(data, starts, ends)
            self.offs = np.searchsorted(doc, np.arange(len(offs)))
            self.first, self.raw, self.unit = None, self.codes.view(np.uint8), 8

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the tokens in [start, end)."""
        return span_hashes(self.raw, start * self.unit, end * self.unit)

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all runs of k tokens."""
        n = len(self.codes) - k + 1
        if self.unit == 1 and k % 8 == 0:
            eight = np.ndarray(len(self.raw) - 7, "<u8", self.raw, strides=(1,))
            parts = [eight[j : j + n] for j in range(0, k, 8)]
        else:
            parts = [self.codes[j : j + n] for j in range(k)]
        h = np.full(n, k, U)
        for x in parts:
            h = chain(h, x.astype(U))
        return h

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offs, at, "right") - 1


def anchors(t: Tokens, k: int, width: int) -> dict[str, np.ndarray]:
    """The anchor occurrences of all windows of ``width`` tokens.

    Per occurrence: document, first and last window start, and hashes of the anchor, of the span of its windows
    with the anchor's place in it, and of the half windows to its left and right (0: no window reaches so far).
    In bytes, anchors that start before a local minimum (the sampled suffixes of induced sorting) come first.
    """
    none = np.zeros(0, np.int64)
    out = {"doc": none, "s": none, "e": none, "a": none.astype(U), "c": none.astype(U), "l": none.astype(U), "r": none.astype(U)}
    n = len(t.codes)
    if n < width:
        return out
    gram = t.grams(k)
    rank = mix(gram ^ U(0x2545F4914F6CDD1D)) >> U(33)
    if t.first is not None:
        rank |= (~t.first[: len(rank)]).astype(U) << U(31)
    m, cover, span = (rank << U(32)) | np.arange(len(rank), dtype=U), 1, width - k + 1
    while cover * 2 <= span:
        m = np.minimum(m[:-cover], m[cover:])
        cover *= 2
    if cover < span:
        m = np.minimum(m[: len(m) - (span - cover)], m[span - cover :])
    room = np.zeros(n + 1, np.int32)  # window starts i with i + width within i's document
    lens = np.diff(t.offs)
    long = lens >= width
    np.add.at(room, t.offs[:-1][long], 1)
    np.add.at(room, t.offs[:-1][long] + lens[long] - width + 1, -1)
    i = np.flatnonzero(np.cumsum(room)[: len(m)] > 0)
    if not len(i):
        return out
    q = (m[i] & U(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(i), bool)
    new[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1] + 1)
    first = np.flatnonzero(new)
    s, e, q = i[first], i[np.append(first[1:], len(i)) - 1], q[first]
    half = -(-(width - k) // 2)
    side = lambda ok, a, b: np.where(ok, np.maximum(t.spans(np.where(ok, a, 0), np.where(ok, b, 0)) >> U(56), U(1)), U(0))
    c = mix(t.spans(s, e + width) + (q - s).astype(U) * U(0xA24BAED4963EE407))
    return {"doc": t.doc(s), "s": s, "e": e, "a": gram[q], "c": c, "l": side(q - half >= s, q - half, q), "r": side(q + k + half <= e + width, q + k, q + k + half)}


def _distinct(keys: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys then document; of each distinct key the first place in that order, and each row's key."""
    order = np.lexsort((doc, *keys[::-1]))
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return order[new], group


def _bits(blobs: list[tuple[int, bytes]], n: int, planes: int) -> np.ndarray:
    """Replies by bucket, in the order of the keys sent: planes x n booleans."""
    out = np.zeros((planes, n), bool)
    at = 0
    for _, size, raw in sorted(blobs):
        out[:, at : at + size] = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(planes, -1), axis=1, count=size)
        at += size
    return out


KEYS = "chunk long, bucket int, base long, keys binary"
REPLY = "chunk long, bucket int, size int, bits binary"


def _send(chunk: int, keys: np.ndarray, bits: int, base: int, columns: list[np.ndarray], widths: tuple[int, ...]) -> pa.RecordBatch:
    """One row per bucket with keys sorted by their first hash."""
    bucket = (keys >> U(64 - bits)).astype(np.int64)
    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(edges[1:], len(keys))
    blobs = [_squeeze([c[a:b] for c in columns], widths) for a, b in zip(edges, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(edges), chunk)), pa.array(bucket[edges].astype(np.int32)), pa.array(np.full(len(edges), base)), pa.array(blobs, pa.binary())], names=["chunk", "bucket", "base", "keys"])


def _answer(table: pa.Table, widths: tuple[int, ...], settle) -> pa.Table:
    """Run ``settle(columns, docs)`` over a bucket's keys and send each chunk its bits."""
    chunks, bases, blobs = (table.column(c).to_pylist() for c in ("chunk", "base", "keys"))
    order = sorted(range(len(chunks)), key=chunks.__getitem__)
    parts = [_spread(blobs[i], widths) for i in order]
    sizes = [len(p[0]) for p in parts]
    cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
    docs = cols[-1].astype(np.int64) + np.repeat([bases[i] for i in order], sizes)
    planes = settle(cols[:-1], docs)
    ends = np.cumsum(sizes)
    out = [np.packbits(planes[:, e - n : e], axis=1).tobytes() for n, e in zip(sizes, ends.tolist(), strict=True)]
    return pa.table({"chunk": pa.array([chunks[i] for i in order], pa.int64()), "bucket": pa.array([table.column("bucket")[0].as_py()] * len(order), pa.int32()), "size": pa.array(sizes, pa.int32()), "bits": pa.array(out, pa.binary())})


def _settle_spans(cols: list[np.ndarray], docs: np.ndarray) -> np.ndarray:
    """Per key: a smaller document has the span; the span is this document's and its windows must be compared."""
    a, c, left, right = cols
    owner, group = _distinct([a, c], docs)
    elsewhere = docs > docs[owner][group]
    open_ = np.zeros(len(owner), bool)
    for side in (left[owner], right[owner]):
        _, near = _distinct([a[owner], side], docs[owner])
        lo, hi = np.full(near.max() + 1, np.iinfo(np.int64).max), np.full(near.max() + 1, np.iinfo(np.int64).min)
        np.minimum.at(lo, near, docs[owner])
        np.maximum.at(hi, near, docs[owner])
        open_ |= (side != 0) & (lo != hi)[near]
    return np.stack([elsewhere, open_[group] & ~elsewhere])


def _settle_windows(cols: list[np.ndarray], docs: np.ndarray) -> np.ndarray:
    owner, group = _distinct(cols, docs)
    return (docs > docs[owner][group])[None]


def _ranges(s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """All integers of the closed ranges, one range after another."""
    n = e - s + 1
    return np.repeat(s - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _windows(t: Tokens, at: np.ndarray, a: np.ndarray, width: int, ids: np.ndarray):
    """Distinct keys of the windows at ``at`` with the smallest document, and each window's key."""
    w = t.spans(at, at + width)
    doc = ids[t.doc(at)]
    owner, group = _distinct([w, a], doc)
    return w[owner], a[owner], doc[owner], group, doc


def _covered(n: int, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, s, 1)
    np.add.at(d, e, -1)
    return np.cumsum(d[:-1]) > 0


RESULT = "doc_id long, n_tokens long, n_removed long, n_spans long, spans array<long>, kept binary, kept_sha256 string"
NAMES = [c.split()[0] for c in RESULT.split(", ")]
STEP = f"kind string, chunk long, parts array<binary>, {RESULT}"


def _results(t: Tokens, ids, offs, data, gone: np.ndarray, docs: np.ndarray, kind: str, keep_text: bool) -> dict[str, list]:
    """Result columns for the documents numbered ``docs``."""
    total = np.concatenate([[0], np.cumsum(gone)])
    rows = {c: [] for c in NAMES}
    raw = data.tobytes()
    for d in docs.tolist():
        a, b = int(t.offs[d]), int(t.offs[d + 1])
        n_gone, body = int(total[b] - total[a]), raw[offs[d] : offs[d + 1]]
        spans: list[int] = []
        if n_gone:
            flag = np.zeros(b - a + 2, np.int8)
            flag[1:-1] = gone[a:b]
            spans = np.flatnonzero(np.diff(flag)).tolist()
        if kind == "bytes":
            kept = np.frombuffer(body, np.uint8)[~gone[a:b]].tobytes() if n_gone else body
        else:
            kept = b" ".join(compress(body.split(), ~gone[a:b]) if n_gone else body.split())
        for c, v in zip(NAMES, (int(ids[d]), b - a, n_gone, len(spans) // 2, spans, kept if keep_text else None, hashlib.sha256(kept).hexdigest()), strict=True):
            rows[c].append(v)
    return rows


RESULT_TYPES = dict(zip(NAMES, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.string()), strict=True))
STEP_TYPES = {"kind": pa.string(), "chunk": pa.int64(), "parts": pa.list_(pa.binary())} | RESULT_TYPES


def _step(n: int, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[c], t) if c in cols else pa.nulls(n, t) for c, t in STEP_TYPES.items()], names=list(STEP_TYPES))


def remove_repeats(docs: DataFrame, kind: str, width: int = 50, keep_text: bool = True) -> DataFrame:
    """Remove every token that a window of ``width`` tokens covers which also starts in a document with a smaller id.

    ``kind`` is ``words`` (runs of other than ASCII white space, unchanged) or ``bytes`` (UTF-8).  Windows lie in one
    document and are judged on the input.  Per document: number of tokens and of removed ones, the maximal removed
    spans as token offsets start, end, start, end, ..., the kept text (words joined by one space; only if
    ``keep_text``) and its SHA-256.  Null texts are empty; texts shorter than a window lose nothing; a document
    loses nothing for repeating itself; rows with a null id are left out; an empty table gives no rows.
    """
    k = min(ANCHOR[kind], width)
    chunks = stage(pack_chunks(docs), "chunks", "none")
    size = chunks.agg(F.coalesce(F.sum("text_bytes"), F.lit(0)).alias("n")).first()["n"]
    bits = (min(MOST_BUCKETS, max(LEAST_BUCKETS, size // BUCKET_BYTES)) - 1).bit_length()

    def spans(parts):
        ids, offs, data = _unpack(parts)
        t = Tokens(data, offs, kind)
        x = anchors(t, k, width)
        doc = ids[x["doc"]]
        owner, group = _distinct([x["a"], x["c"]], doc)
        return ids, offs, data, t, x, doc, owner, group

    def send_spans(batches):
        for batch in batches:
            for chunk, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, _, _, _, x, doc, owner, _ = spans(parts)
                if len(owner):
                    base = int(ids.min())
                    a = x["a"][owner]
                    yield _send(chunk, a, bits, base, [a >> U(40 - bits), x["c"][owner], x["l"][owner], x["r"][owner], doc[owner] - base], SPAN)

    asked = chunks.select("chunk", "parts").mapInArrow(send_spans, KEYS)
    replies = asked.groupBy("bucket").applyInArrow(lambda t: _answer(t, SPAN, _settle_spans), REPLY)
    gathered = lambda r: r.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "size", "bits")).alias("replies"))  # noqa: E731  at most one per bucket
    told = chunks.select("chunk", "parts").join(gathered(replies), "chunk", "left")

    def settle(batches):
        for batch in batches:
            for chunk, parts, back in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                ids, offs, data, t, x, doc, owner, group = spans(parts)
                n = len(t.codes)
                known = _bits([(r["bucket"], r["size"], r["bits"]) for r in back or ()], len(owner), 2)
                first = doc == doc[owner][group]
                lost = known[0][group] | ~first
                gone = _covered(n, x["s"][lost], x["e"][lost] + width)
                open_ = known[1][group] & first
                later = np.zeros(len(ids), bool)
                later[x["doc"][open_]] = True
                done = np.flatnonzero(~later)
                yield _step(len(done), kind=["done"] * len(done), **_results(t, ids, offs, data, gone, done, kind, keep_text))
                if not later.any():
                    continue
                s, e = x["s"][open_], x["e"][open_]
                keep = np.flatnonzero(later)
                moved = np.cumsum(np.where(later, 0, np.diff(t.offs)))  # tokens of dropped documents before a kept one
                shift = lambda v, d: v - moved[d]
                text = b"".join([data[offs[d] : offs[d + 1]].tobytes() for d in keep])
                flags = np.diff(np.concatenate([[0], gone[np.repeat(later, np.diff(t.offs))].astype(np.int8), [0]]))
                cover = np.stack([np.flatnonzero(flags == 1), np.flatnonzero(flags == -1)])
                todo = np.stack([shift(s, x["doc"][open_]), shift(e, x["doc"][open_])])
                packed = [*_pack(ids[keep], np.diff(offs)[keep], text), cover.astype("<i8").tobytes(), todo.astype("<i8").tobytes(), x["a"][open_].tobytes()]
                yield _step(1, kind=["pending"], chunk=[chunk], parts=[packed])

    second = stage(told.mapInArrow(settle, STEP), "settled", "zstd", by=["kind"])
    pending = second.where("kind = 'pending'").select("chunk", "parts")

    def windows(parts):
        ids, offs, data = _unpack(parts)
        t = Tokens(data, offs, kind)
        s, e = np.frombuffer(parts[4], "<i8").reshape(2, -1)
        at, a = _ranges(s, e), np.repeat(np.frombuffer(parts[5], U), e - s + 1)
        return ids, offs, data, t, at, _windows(t, at, a, width, ids)

    def send_windows(batches):
        for batch in batches:
            for chunk, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, _, _, _, _, (w, a, smallest, _, _) = windows(parts)
                base = int(ids.min())
                yield _send(chunk, w, bits, base, [w, a, smallest - base], WINDOW)

    replies = pending.mapInArrow(send_windows, KEYS).groupBy("bucket").applyInArrow(lambda t: _answer(t, WINDOW, _settle_windows), REPLY)
    told = pending.join(gathered(replies), "chunk", "left")

    def finish(batches):
        for batch in batches:
            for parts, back in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids, offs, data, t, at, (w, _, smallest, group, doc) = windows(parts)
                cover = np.frombuffer(parts[3], "<i8").reshape(2, -1)
                lost = _bits([(r["bucket"], r["size"], r["bits"]) for r in back or ()], len(w), 1)[0][group] | (doc != smallest[group])
                gone = _covered(len(t.codes), np.concatenate([cover[0], at[lost]]), np.concatenate([cover[1], at[lost] + width]))
                rows = _results(t, ids, offs, data, gone, np.arange(len(ids)), kind, keep_text)
                yield pa.RecordBatch.from_arrays([pa.array(rows[c], ty) for c, ty in RESULT_TYPES.items()], names=NAMES)

    return second.where("kind = 'done'").select(*NAMES).unionByName(told.mapInArrow(finish, RESULT))
