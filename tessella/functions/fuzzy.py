"""Fuzzy blocklists: a bigram index turns windows away, matching blocks of the rest are found side by side in NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

#: Pairs whose blocks are matched in one go.
PAIRS = 1 << 15
#: Letters of texts that are compared together.
CELLS = 1 << 20
#: Bytes of text that one pass works on.
PASS_BYTES = 1 << 22


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points as rows of a matrix, filled with zeros, and lengths."""
    size = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    out = np.zeros((len(texts), max(1, int(size.max(initial=0)))), np.int64)
    out[np.repeat(np.arange(len(texts)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out, size


def matched_letters(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """For pairs of texts (rows of code points) the letters in matching blocks: the longest common block, then those left and right of it.

    Of longest blocks the one that begins first in ``a`` counts, and then the first in ``b``.  All open stretches of all pairs advance
    together, row by row of the table of common endings, and split until none has a common letter.
    """
    total = np.zeros(len(a), np.int64)
    part = np.flatnonzero((a_size > 0) & (b_size > 0))
    span = [np.zeros(len(part), np.int64), a_size[part], np.zeros(len(part), np.int64), b_size[part]]
    columns = np.arange(b.shape[1])
    while len(part):
        a_lo, a_hi, b_lo, b_hi = span
        best, at_a, at_b = (np.zeros(len(part), np.int64) for _ in range(3))
        inside = (columns >= b_lo[:, None]) & (columns < b_hi[:, None])
        row = np.zeros((len(part), b.shape[1]), np.int64)
        for i in range(int(a_lo.min()), int(a_hi.max())):
            same = (b[part] == a[part, i][:, None]) & inside & ((i >= a_lo) & (i < a_hi))[:, None]
            row[:, 1:] = np.where(same[:, 1:], row[:, :-1] + 1, 0)
            row[:, 0] = same[:, 0]
            top = row.argmax(1)
            size = row[np.arange(len(part)), top]
            more = size > best
            best[more], at_a[more], at_b[more] = size[more], i - size[more] + 1, top[more] - size[more] + 1
        np.add.at(total, part, best)
        found = best > 0
        left = found & (at_a > a_lo) & (at_b > b_lo)
        right = found & (at_a + best < a_hi) & (at_b + best < b_hi)
        span = [np.concatenate(x) for x in ((a_lo[left], (at_a + best)[right]), (at_a[left], a_hi[right]), (b_lo[left], (at_b + best)[right]), (at_b[left], b_hi[right]))]
        part = np.concatenate([part[left], part[right]])
    return total


def needs_bigram(size: int, changes: float) -> bool:
    """Whether texts that resemble a word of this many letters must share two letters in a row with it.

    With m letters matched, at most u = both sizes - 2 m are not, and they part at most u + 1 blocks; so the longest has more than one
    letter if m > u + 1, whatever the other text's size.
    """
    need = (size - changes) / size
    if need <= 0:
        return False
    sizes = [n for n in range(1, int(2 * size / need) + 2) if 2 * min(n, size) >= need * (n + size)]
    least = [max(0, int(np.ceil(need * (n + size) / 2 - 1e-9))) for n in sizes]
    return all(m > n + size - 2 * m + 1 for n, m in zip(sizes, least, strict=True))


def _allowed(sizes: np.ndarray, n: int, changes: float) -> np.ndarray:
    """Texts of which sizes may resemble a word of n letters."""
    need = (n - changes) / n if n else 1.0
    both = sizes + n
    return (2.0 * np.minimum(sizes, n) / np.maximum(both, 1) >= need) & (both > 0)


def _letter_counts(a: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """How often each text has each letter of the alphabet."""
    if not len(alphabet):
        return np.zeros((len(a), 0), np.int32)
    code = np.minimum(np.searchsorted(alphabet, a), len(alphabet) - 1)
    row, at = np.nonzero(alphabet[code] == a)
    return np.bincount(row * len(alphabet) + code[row, at], minlength=len(a) * len(alphabet)).astype(np.int32).reshape(len(a), -1)


def resembled(runs: list[str], words: list[str], changes: float = 1) -> np.ndarray:
    """For every text the place of the first of ``words`` that it resembles, or -1.

    Resembling is a ratio of 2 * matched letters / both sizes of at least (size of the word - changes) / size of the word.  Texts of a size
    that no word allows are left out; the others are compared in groups of about ``CELLS`` letters, longest first, so that neither their
    number nor a long one among them makes a large matrix.
    """
    out = np.full(len(runs), -1)
    b, b_size = _letters(words)
    alphabet = np.unique(b[b > 0])
    listed = b, b_size, alphabet, _letter_counts(b, alphabet)
    size = np.array([len(t) for t in runs], np.int64)
    kinds, kind = np.unique(size, return_inverse=True)
    left = np.flatnonzero(np.any([_allowed(kinds, int(n), changes) for n in np.unique(b_size)], axis=0)[kind]) if words else []
    left = left[np.argsort(-size[left], kind="stable")] if len(left) else left
    while len(left):
        part, left = np.split(left, [max(1, CELLS // max(1, int(size[left[0]]), len(alphabet)))])
        out[part] = _first_resembled([runs[t] for t in part.tolist()], *listed, changes)
    return out


def _first_resembled(runs: list[str], b: np.ndarray, b_size: np.ndarray, alphabet: np.ndarray, count_b: np.ndarray, changes: float) -> np.ndarray:
    """As ``resembled``, for one group of texts and the letters of the words.

    A word's candidates come from an index of bigrams, then must pass the bounds by size and by common letters; only what is left is matched.
    """
    out = np.full(len(runs), len(b))
    a, a_size = _letters(runs)
    count_a = _letter_counts(a, alphabet)
    pair = a[:, :-1] << 21 | a[:, 1:]
    real = np.flatnonzero((a[:, 1:] > 0).ravel())
    key, owner = pair.ravel()[real], real // max(1, pair.shape[1])
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    todo: list[tuple[np.ndarray, np.ndarray]] = []
    for w in range(len(b)):
        n = b_size[w]
        need = (n - changes) / n if n else 1.0
        if needs_bigram(int(n), changes):
            own = np.unique(b[w, : n - 1] << 21 | b[w, 1:n])
            lo, hi = np.searchsorted(key, own, "left"), np.searchsorted(key, own, "right")
            near = np.unique(owner[np.arange((hi - lo).sum()) + np.repeat(lo - np.cumsum(hi - lo) + hi - lo, hi - lo)])
        else:
            near = np.arange(len(a))
        near = near[_allowed(a_size[near], int(n), changes) & (out[near] > w)]
        common = np.minimum(count_a[near], count_b[w]).sum(1)
        near = near[2.0 * common / (a_size[near] + n) >= need]
        todo.append((near, np.full(len(near), w)))
        if w == len(b) - 1 or sum(len(x) for x, _ in todo) >= PAIRS:
            i, v = (np.concatenate(x) for x in zip(*todo, strict=True))
            todo, most = [], min(PAIRS, max(1, CELLS // b.shape[1]))
            for k in range(0, len(i), most):
                x, y = i[k : k + most], v[k : k + most]
                ratio = 2.0 * matched_letters(a[x], a_size[x], b[y], b_size[y]) / (a_size[x] + b_size[y])
                good = ratio >= (b_size[y] - changes) / b_size[y]
                np.minimum.at(out, x[good], y[good])
    return np.where(out < len(b), out, -1)


def _windows(tokens: np.ndarray, owner: np.ndarray, n: int, letters: np.ndarray, sizes: list[int], changes: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of n tokens within a text whose size one of ``sizes`` allows: the distinct ones as rows of token numbers, each window's among them, and its text.

    ``letters``: by token number, how many it has; one blank lies between tokens.
    """
    at = np.arange(max(0, len(tokens) - n + 1))
    at = at[owner[at] == owner[at + n - 1]] if len(at) else at
    size = sum(letters[tokens[at + k]] for k in range(n)) + n - 1
    at = at[np.any([_allowed(size, s, changes) for s in sizes], axis=0)]
    which = np.zeros(len(at), np.int64)
    for k in range(n):  # numbers of the windows' first k + 1 tokens
        first, which = np.unique(which * len(letters) + tokens[at + k], return_index=True, return_inverse=True)[1:]
    return np.stack([tokens[at[first] + k] for k in range(n)], axis=1), which, owner[at]


def _passes(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts of about ``PASS_BYTES`` together; a longer text is one of its own."""
    edge = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(edge, edge[i] + PASS_BYTES, "right")) - 1)
        yield i, j
        i = j


def _first_listed(texts: pa.Array, listed: dict[int, list[str]], changes: float) -> np.ndarray:
    """The first listed word that a run of each text resembles, or None; ``listed`` has the words by their number of tokens."""
    out = np.full(len(texts), None, object)
    split = pc.utf8_split_whitespace(pa.array([(t or "").lower() for t in texts.to_pylist()], pa.string()))
    owner = pc.list_parent_indices(split).to_numpy()
    flat = pc.list_flatten(split).dictionary_encode()
    kinds, tokens = flat.dictionary, flat.indices.to_numpy().astype(np.int64)
    letters = pc.utf8_length(kinds).to_numpy().astype(np.int64)
    full = letters[tokens] > 0
    owner, tokens = owner[full], tokens[full]
    for n in sorted(listed):
        rows, which, text = _windows(tokens, owner, n, letters, sorted({len(w) for w in listed[n]}), changes)
        columns = [kinds.take(pa.array(c)).to_pylist() for c in rows.T]
        found = resembled([" ".join(r) for r in zip(*columns, strict=True)], listed[n], changes)
        hit = np.flatnonzero(found[which] >= 0)
        first, place = np.unique(text[hit], return_index=True)
        new = np.array([out[t] is None for t in first], bool)
        out[first[new]] = np.array(listed[n], object)[found[which[hit[place[new]]]]]
    return out


def fuzzy_blocked(words: list[str], changes: float = 1, least: int = 6):
    """A vectorized function: the first listed word of at least ``least`` letters that a run of as many words of the text resembles, else null.

    Runs of fewer words go first, then earlier ones, then words in the order of the list.  Each distinct run of a pass is compared once; a
    batch is worked off in passes of ``PASS_BYTES`` of text, so that memory doesn't grow with the rows of a batch.
    """
    listed: dict[int, list[str]] = {}
    for w in words:
        if len(w) >= least:
            listed.setdefault(len(w.split()), []).append(w.lower())

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        out = [_first_listed(texts.slice(i, j - i), listed, changes) for i, j in _passes(texts)]
        return pa.array(np.concatenate([np.zeros(0, object), *out]), pa.string())

    return run
