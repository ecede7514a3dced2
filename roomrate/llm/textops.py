"""Vectorised helpers for text inside Arrow batches (used within Spark tasks only).

A batch of texts is one flat UTF-8 byte buffer plus offsets. Words, word hashes and word n-grams are
found with a few numpy passes over that buffer; no Python loop touches a word. A batch is worked off in
pieces of about PIECE_BYTES so that the temporary arrays stay bounded whatever the batch holds (one
text longer than that makes a piece of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
#: rows whose texts are copied out of a batch at once
PIECE_ROWS = 512

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX_1, _MIX_2 = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: bytes of a word [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False

#: bytes of a word [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became a-z: digits, letters, all non-ASCII
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (public fmix64 constants)."""
    x = x ^ (x >> _U(33))
    x = x * _MIX_1
    x ^= x >> _U(33)
    x *= _MIX_2
    x ^= x >> _U(33)
    return x


def multiplier(j: int) -> np.uint64:
    """j-th odd multiplier of a fixed sequence."""
    return _U((0xD6E8FEB86659FD93 * (2 * j + 1) + 0x2545F4914F6CDD1D * j * 2) % (1 << 64) | 1)


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("b", ())) < n:
        n = max(n, PIECE_BYTES + 1)
        for key, base in (("b", _BASE), ("i", _BASE_INV)):
            t = np.full(n, base, dtype=np.uint64)
            t[0] = 1
            _powers[key] = np.cumprod(t, dtype=np.uint64)
    return _powers["b"], _powers["i"]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])  # null becomes empty, offsets begin at 0
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive runs of rows of about `limit` bytes."""
    for start in range(0, len(texts), PIECE_ROWS):
        data, offsets = flat(texts.slice(start, PIECE_ROWS))
        lo = 0
        while lo < len(offsets) - 1:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
            yield start + lo, start + hi, data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo]
            lo = hi


class Words:
    """Words of a piece: starts, ends (byte positions), row (index within the piece), hash, first (word
    index at which each row begins; len rows + 1)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
        data = LOWER[data]
        inside = is_word[data]
        n = len(data)
        edges = offsets[(offsets > 0) & (offsets < n)]
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            before[edges] = False
            after[edges - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(offsets) - 1), self.count)
        power, inverse = _power_table(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + _U(1)) * power[:n], out=sums[1:])
        h = (sums[self.ends] - sums[self.starts]) * inverse[self.starts]
        self.hash = mix64(h + (self.ends - self.starts).astype(np.uint64) * _MIX_2)


def grams(hashes: np.ndarray, first: np.ndarray, count: np.ndarray, row: np.ndarray, k: int,
          short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, position in row) of every run of k words in a row, in text order. With `short`, a row of
    fewer words, but not none, gives its whole sequence as one gram."""
    n = len(hashes)
    ok = np.zeros(n, bool)
    if n:
        position = np.arange(n) - first[:-1][row]
        ok = position + k <= count[row]
    at = np.flatnonzero(ok)
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        h += hashes[at + j] * multiplier(j)
    h, rows, pos = mix64(h), row[at], (position[at] if n else at)
    if short:
        few = np.flatnonzero((count > 0) & (count < k))
        if len(few):
            s = np.zeros(len(few), np.uint64)
            for j in range(k - 1):
                has = count[few] > j
                s[has] += hashes[first[few[has]] + j] * multiplier(j)
            s = mix64(s + count[few].astype(np.uint64) * _MIX_1)
            rows = np.concatenate([rows, few])
            order = np.argsort(rows, kind="stable")
            h = np.concatenate([h, s])[order]
            pos = np.concatenate([pos, np.zeros(len(few), pos.dtype)])[order]
            rows = rows[order]
    return h, rows, pos


def sorted_sets(h: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each row in ascending order: (hashes, row of each, first index of each row)."""
    first = np.searchsorted(rows, np.arange(n_rows + 1))
    h = h.copy()
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        if hi - lo > 1:
            h[lo:hi].sort()
    keep = np.ones(len(h), bool)
    if len(h) > 1:
        keep[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    h, rows = h[keep], rows[keep]
    return h, rows, np.searchsorted(rows, np.arange(n_rows + 1))


def segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum (modulo 2^64) of values[first[i]:first[i+1]]; 0 for an empty segment."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]
