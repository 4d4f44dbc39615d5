"""Vectorised helpers over concatenated UTF-8 bytes, shared by the operators of this subpackage.

Everything here works on one block of documents at a time: ``data`` holds their
bytes back to back, ``offs`` the n+1 document borders. Words and shingles are named by
64-bit hashes; the byte table and the base are fixed random values, so a hash means
the same on every executor and in every run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20240611))
RAW = _rng.integers(1, 2**64, 256, dtype=np.uint64)
LOWER = RAW.copy()
LOWER[65:91] = RAW[97:123]
BASE = int(_rng.integers(2**62, 2**64, dtype=np.uint64)) | 1
INVERSE = pow(BASE, -1, 2**64)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but digits, letters and bytes of non-ASCII characters.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False

#: Powers that are kept; a worker that once met a long text would hold as many for good otherwise.
KEPT = 1 << 18
_powers = {}


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    if base not in _powers:
        made = np.full(KEPT, base, np.uint64)
        made[0] = 1
        with np.errstate(over="ignore"):
            _powers[base] = np.multiply.accumulate(made)
    if n <= KEPT:
        return _powers[base][:n]
    step, far = pow(base, KEPT, 2**64), np.ones(-(-n // KEPT), np.uint64)
    far[1:] = step
    return np.multiply.outer(np.multiply.accumulate(far), _powers[base]).reshape(-1)[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = RAW) -> np.ndarray:
    """64-bit hash of each span data[start:end].

    A span's hash doesn't depend on what stands before it, so long data is read in runs of spans of KEPT bytes or so, where starts and ends ascend.
    """
    if len(data) <= KEPT or (np.diff(starts) < 0).any() or (np.diff(ends) < 0).any():
        return _spans_hash(data, starts, ends, table)
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + KEPT - 1, side="right")))
        out[i:j] = _spans_hash(data[a : int(ends[j - 1])], starts[i:j] - a, ends[i:j] - a, table)
        i = j
    return out


def _spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(table[data] * powers(n, BASE), out=total[1:])
    h = (total[ends] - total[starts]) * powers(n + 1, INVERSE)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * MIX2)


def word_spans(data: np.ndarray, offs: np.ndarray, separator: np.ndarray):
    """Starts and ends of the words, and for each document its first word's number (n+1 values)."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    np.logical_not(separator[data], out=inside[1:-1])
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    return starts, ends, np.searchsorted(starts, offs)


def shingles(words: np.ndarray, first: np.ndarray, k: int, whole: bool = True):
    """Hashes of k consecutive words within a document, and each document's first shingle's number.

    A document of fewer words, but not none, gives its whole sequence as one if whole.
    """
    counts = np.diff(first)
    n = np.maximum(counts - k + 1, 0)
    short = (counts > 0) & (counts < k) if whole else np.zeros(len(counts), bool)
    n[short] = 1
    at = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(np.arange(len(n)), n)
    pos = first[owner] + np.arange(at[-1]) - at[owner]
    h = np.zeros(len(pos), np.uint64)
    c = powers(k, BASE)
    for j in range(k):
        ok = pos + j < first[owner + 1]
        h += np.where(ok, words[np.minimum(pos + j, max(len(words) - 1, 0))], np.uint64(0)) * c[j] if len(words) else np.uint64(0)
    return mix(h + np.minimum(counts, k)[owner].astype(np.uint64)), at, pos


def buffers(column: pa.Array):
    """Bytes and borders of a string or binary Arrow column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, border, data = column.buffers()
    offs = np.frombuffer(border, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def blocks(offs: np.ndarray, most: int = 1 << 18):
    """Ranges (i, j) of whole documents of about ``most`` bytes; a longer document stands alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1)
        yield i, j
        i = j


def sums(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Sum of values between neighbouring borders; empty ranges give 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[borders[1:]] - total[borders[:-1]]
