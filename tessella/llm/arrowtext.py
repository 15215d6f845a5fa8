"""Whole-batch text kernels on Arrow string buffers (numpy, no per-row Python)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass works on; a longer document is a pass of its own.
PASS_BYTES = 1 << 20

#: The ASCII white space that separates words: space, \t, \n, \v, \f, \r.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_CHAIN, _SEED = np.uint64(0x9FB21C651E98DF25), np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Spans of more bytes are hashed one by one.
LONG_SPAN = 1 << 12


def chain(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Hashes of sequences one item longer: no linear map, so that no two texts collide whatever the constants are."""
    return mix(h * _CHAIN + x)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of every span [start, end); spans may overlap.

    All spans advance together, eight bytes at a time; those that have ended leave.
    """
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    left = end - start
    h = mix(left.astype(np.uint64) + np.uint64((seed + 1) * int(_SEED) % (1 << 64)))
    who = np.flatnonzero((left > 0) & (left <= LONG_SPAN))
    at, left, own = start[who], left[who], h[who]
    while len(who):
        own = chain(own, eight[at] & _MASKS[np.minimum(left, 8)])
        stay = left > 8
        if not stay.all():
            h[who[~stay]] = own[~stay]
            who, at, left, own = who[stay], at[stay], left[stay], own[stay]
        at, left = at + 8, left - 8
    if len(far := np.flatnonzero(end - start > LONG_SPAN)):
        import xxhash

        h[far] = [xxhash.xxh3_64_intdigest(data[a:b].tobytes(), seed) for a, b in zip(start[far].tolist(), end[far].tolist(), strict=True)]
    return h


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Disjoint spans in order, none of them empty, as one binary column."""
    n = ends - starts
    edges = np.concatenate([[0], np.cumsum(n)])
    mark = np.zeros(len(data) + 1, np.int8)
    mark[starts] = 1
    mark[ends] -= 1
    body = data[np.cumsum(mark[:-1], dtype=np.int8).view(bool)]
    return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(edges), pa.py_buffer(body)])


def string_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its len + 1 offsets; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type) and not pa.types.is_large_binary(col.type):
        kind = np.int32
    else:
        kind = np.int64
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, kind, len(col) + 1, col.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def passes(offs: np.ndarray, most: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of documents of about ``most`` bytes together."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of other than ASCII white space) and each one's document."""
    inside = ~IS_SPACE[data]
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.zeros(n + 1, bool)
    first[offs[:-1]] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    starts = np.flatnonzero(inside & (first[:n] | ~before[:n]))
    after = np.zeros(n + 1, bool)
    after[:n] = inside
    ends = np.flatnonzero(before & (first | ~after))
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    return span_hashes(LOWER[data] if lower else data, starts, ends)
