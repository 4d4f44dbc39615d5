"""Quality rules from a suffix array over each document's words.

Suffixes are sorted by prefix doubling (3, 6, 12, .. words), for all documents of a block
at once. Only suffixes that begin with a three-word window found twice in their document
take part: any other shares less than three words with every suffix, so nothing is
lost. The longest common prefix with the neighbours in suffix order bounds the maximal
repeated substrings (the LCP intervals); their union is the covered part of the text,
their longest the longest repeat.

Edge cases: null and empty texts have no words and fail the base rule; a repeat may
overlap itself; a text that is one word a thousand times is one long repeat.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ._frames import map_text, table
from ._text import MIX1, SPACE, blocks, mix, shingles, spans_hash, sums, word_spans

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long"


def _ties(key: np.ndarray):
    """Order by key, and for each place whether it has the same key as the place before."""
    order = np.argsort(key)
    return order, np.concatenate([[False], key[order][1:] == key[order][:-1]]) if len(key) else np.zeros(0, bool)


def repeats(words: np.ndarray, first: np.ndarray, windows: np.ndarray):
    """For each suffix among ``windows`` (word numbers of repeated three-word windows): its longest match elsewhere in its document, in words.

    Returns word numbers and lengths.
    """
    n = len(words)
    own = np.zeros(n + 4, np.int64)
    own[:n] = np.repeat(np.arange(len(first) - 1), np.diff(first))
    own[n:] = -1
    padded = np.concatenate([words, np.zeros(4, np.uint64)])
    at = np.union1d(windows, windows + 3)
    host = np.zeros(len(at), np.int64)  # windows + 3 may be the end of its document
    host[np.searchsorted(at, windows + 3)] = own[windows]
    host[np.searchsorted(at, windows)] = own[windows]
    end = first[host + 1]
    # a document's end may be the next one's first suffix: such a place is ranked as that suffix, and read only within its own document
    real = at < end
    at, host, end = at[real], host[real], end[real]
    word = lambda k: np.where(at + k < end, padded[np.minimum(at + k, n)], np.uint64(0))
    keys = [host, word(0), word(1), word(2), np.minimum(end - at, 3)]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(at), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(at), np.int64)
    rank[order] = np.cumsum(new)
    levels, step = [], 3
    while True:
        full = np.full(n + 4, -1, np.int64)
        full[at] = rank
        levels.append((step, full))
        size = np.bincount(rank)
        tied = size[rank] > 1
        if not tied.any():
            break
        nxt = np.where(at + step < end, full[np.minimum(at + step, n)], -1)
        sub = np.flatnonzero(tied)
        o = sub[np.lexsort((nxt[sub], rank[sub]))]
        r, m = rank[o], nxt[o]
        change = np.concatenate([[True], (r[1:] != r[:-1]) | (m[1:] != m[:-1])])
        # ranks become places in suffix order, so that a split class stays between its neighbours
        base = np.concatenate([[0], np.cumsum(size)])[:-1]
        place = base[rank]
        group = np.maximum.accumulate(np.where(np.concatenate([[True], r[1:] != r[:-1]]), np.arange(len(o)), 0))
        lead = np.maximum.accumulate(np.where(change, np.arange(len(o)), 0))
        place[o] = base[r] + lead - group
        rank = np.unique(place, return_inverse=True)[1]
        step *= 2
        if (m < 0).all() and step > n:
            break
    order = np.lexsort((at, rank))
    a, b = order[:-1], order[1:]
    same = host[a] == host[b]
    a, b = a[same], b[same]
    lcp = np.zeros(len(a), np.int64)
    pa_, pb = at[a], at[b]
    ea, eb = end[a], end[b]
    for width, full in reversed(levels):
        x, y = pa_ + lcp, pb + lcp
        ok = (x < ea) & (y < eb)
        fx, fy = full[np.minimum(x, n)], full[np.minimum(y, n)]
        lcp += np.where(ok & (fx >= 0) & (fx == fy), width, 0)
    go = np.ones(len(a), bool)
    for _ in range(3):
        x, y = pa_ + lcp, pb + lcp
        go &= (x < ea) & (y < eb) & (padded[np.minimum(x, n)] == padded[np.minimum(y, n)])
        lcp += go
    best = np.zeros(len(at), np.int64)
    np.maximum.at(best, a, lcp)
    np.maximum.at(best, b, lcp)
    return at, best


def measure(data: np.ndarray, offs: np.ndarray, least_words: int, max_covered: float, free_words: int, max_longest: float):
    n = len(offs) - 1
    starts, ends, first = word_spans(data, offs, SPACE)
    n_words = np.diff(first)
    heads = ((data & 0xC0) != 0x80) & ~SPACE[data]
    # lines
    breaks = np.flatnonzero(data == 10)
    own = np.concatenate([np.arange(n), np.searchsorted(offs, breaks, side="right") - 1])
    begin = np.concatenate([offs[:-1], breaks + 1])
    order = np.lexsort((begin, own))
    own, begin = own[order], begin[order]
    finish = offs[own + 1]
    again = own[1:] == own[:-1]
    finish[:-1][again] = begin[1:][again] - 1
    full = np.searchsorted(starts, finish) > np.searchsorted(starts, begin)
    own, begin, finish = own[full], begin[full], finish[full]
    order, tie = _ties(mix(spans_hash(data, begin, finish) + own.astype(np.uint64) * MIX1))
    dup_lines = np.bincount(own[order][tie], minlength=n)
    # three-word windows
    words = spans_hash(data, starts, ends)
    grams, at, pos = shingles(words, first, 3, whole=False)
    host = np.repeat(np.arange(n), np.diff(at))
    order, tie = _ties(mix(grams + host.astype(np.uint64) * MIX1))
    twice = tie.copy()
    twice[:-1] |= tie[1:]
    windows = np.sort(pos[order][twice])
    cover = lambda p, length: np.cumsum(np.bincount(p, minlength=len(words) + 1)[: len(words) + 1] - np.bincount(p + length, minlength=len(words) + 1)[: len(words) + 1])[:-1] > 0
    repeat_words = sums(cover(windows, 3), first)
    covered, longest = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(windows):
        p, length = repeats(words, first, windows)
        long = length >= least_words
        p, length = p[long], length[long]
        covered = sums(cover(p, length), first)
        np.maximum.at(longest, np.searchsorted(first, p, side="right") - 1, length)
    failed = (n_words < 50) | (100 * repeat_words > 50 * n_words)
    kept = ~failed & (covered <= max_covered * n_words) & (longest <= np.maximum(free_words, max_longest * n_words))
    return [n_words, sums(heads, offs), sums(SYMBOL[data], offs), dup_lines, repeat_words, failed, kept, covered, longest]


def assess(docs: DataFrame, text: str = "text", keep=("doc_id",), least_words: int = 8, max_covered: float = 0.3, free_words: int = 60, max_longest: float = 0.2) -> DataFrame:
    """The columns of keep, and out: the counts, and kept where repeats of least_words or more cover at most max_covered of the words and none is longer than free_words and max_longest of the words."""

    def run(data, offs):
        parts = [measure(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], least_words, max_covered, free_words, max_longest) for i, j in blocks(offs, 1 << 19)]
        return [np.concatenate(x) for x in zip(*parts, strict=True)]

    return map_text(docs, run, OUT, text, keep)


def op5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents")).select("doc_id", "out.*")
