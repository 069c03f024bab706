"""Substring dedup: words in windows that an earlier document holds go, by a compressed FM-index of each shard.

A shard's segments, as numbers of their words (numbered by the words themselves), become a Burrows-Wheeler transform
in a wavelet tree of packed bits with counts for each 64, and a sampled suffix array: the suffix order is not kept, a
suffix is located by stepping back to the next sampled one.  The documents' segments are streamed against it.  Backward
search takes a word at a time and narrows the interval of matching suffixes, for many positions at once; the number of
words matched before the interval is empty, or holds nothing but the streamed place itself, is the position's matching
statistic, up to the window.  Positions whose statistic reaches the window report their interval; its suffixes are
located, and the least document among them is the first holder.

Results for odd input.  A null text has no words; texts shorter than a window lose none.  Rows with equal doc_id are
one document for comparison, and none of them removes from another; each is returned.  A null doc_id counts as the
smallest and stays null.  Other columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from metaloom.llm.anchors import Buffer, Kind, repeats, spread
from metaloom.llm.base import MIX_A, mixed, real_id
from metaloom.llm.lpf import sorted_ranks

WINDOW, GRAM = 13, 4
#: Positions that are searched at once, and one suffix in so many positions that is kept.
BATCH, SAMPLE = 1 << 16, 8


def word_grams(words: np.ndarray) -> np.ndarray:
    n = len(words) - GRAM + 1
    h = words[:n].copy()
    for k in range(1, GRAM):
        h = h * MIX_A + words[k : k + n]
    return mixed(h)


class Bits:
    """Packed bits with the count of ones before each 64."""

    def __init__(self, bit: np.ndarray):
        raw = np.packbits(bit.astype(np.uint8), bitorder="little")
        self.words = np.zeros(len(bit) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(raw)] = raw
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words[:-1]), dtype=np.int64)]).astype(np.int32)

    def rank(self, p: np.ndarray) -> np.ndarray:
        """The ones before p."""
        block = p >> 6
        mask = (np.uint64(1) << (p & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & mask)

    def at(self, p: np.ndarray) -> np.ndarray:
        return ((self.words[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class WaveletTree:
    """A sequence of numbers, a level of bits at a time, the sequence stably parted by bit at each level."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.levels = []
        for k in range(bits - 1, -1, -1):
            bit = (sequence >> np.uint32(k)) & np.uint32(1)
            self.levels.append((np.uint32(k), Bits(bit), int(len(bit) - bit.sum())))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])

    def ranks(self, symbols: np.ndarray, *at: np.ndarray) -> list[np.ndarray]:
        """For each array of ends, how often the symbol stands before the end, plus where the symbol's leaf begins."""
        at = list(at)
        for k, bits, zeros in self.levels:
            one = ((symbols >> k) & np.uint32(1)).astype(bool)
            for j, p in enumerate(at):
                ones = bits.rank(p)
                at[j] = np.where(one, zeros + ones, p - ones)
        return at

    def read(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at p, and how often each stands before p, plus where its leaf begins."""
        symbols = np.zeros(len(p), np.uint32)
        for k, bits, zeros in self.levels:
            one, ones = bits.at(p), bits.rank(p)
            symbols |= one.astype(np.uint32) << k
            p = np.where(one, zeros + ones, p - ones)
        return symbols, p


class FMIndex:
    """Of a sequence of numbers in which zeros end the segments, each of at most so many numbers; zeros are ordered by
    position, so no suffix is compared beyond its segment."""

    def __init__(self, sequence: np.ndarray, longest: int):
        n, known = len(sequence), 1
        end = sequence == 0
        rank = np.where(end, np.cumsum(end) - 1, sequence + end.sum()).astype(np.uint64)
        bits = (n + 1).bit_length() + 1
        order, rank = sorted_ranks((rank, bits))
        while known <= longest:
            ahead = np.concatenate([rank[known:] + np.uint64(1), np.zeros(min(known, n), np.uint64)])[:n]
            order, rank = sorted_ranks((rank, bits), (ahead, bits))
            known *= 2
        self.n = n
        before = sequence[order - 1]  # the last symbol stands before the first suffix
        symbols = np.arange(int(sequence.max()) + 1, dtype=np.uint32)
        self.tree = WaveletTree(before.astype(np.uint32), max(1, int(symbols[-1]).bit_length()))
        # The leaves of the tree are in the order of reversed bits; where a leaf begins is taken from its ranks.
        leaf = self.tree.ranks(symbols, np.zeros(len(symbols), np.int64))[0]
        self.shift = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=len(symbols)))])[:-1] - leaf
        # The begins of segments are kept as well, so no step back crosses from one segment to another.
        sampled = (order % SAMPLE == 0) | (before == 0)
        self.marked, self.samples = Bits(sampled), order[sampled].astype(np.int32)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places of suffixes, by steps back until a sampled one."""
        out, live, rows = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows.copy()
        steps = 0
        while len(live):
            known = self.marked.at(rows)
            done = rows[known]
            out[live[known]] = self.samples[self.marked.rank(done)] + steps
            live, rows = live[~known], rows[~known]
            symbol, p = self.tree.read(rows)
            rows = p + self.shift[symbol]
            steps += 1
        return out

    def matching(self, sequence: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each start: its matching statistic, the words of its window (from the last) that also stand elsewhere,
        and the interval of suffixes that begin with the window, empty unless the statistic reaches it.

        The streamed words are in the index themselves, so an interval of one suffix is no match elsewhere.
        """
        statistic, low, high = (np.zeros(len(starts), np.int64) for _ in range(3))
        live = np.arange(len(starts))
        lo, hi = low.copy(), np.full(len(starts), self.n, np.int64)
        for k in range(window - 1, -1, -1):
            c = sequence[starts[live] + k]
            lo, hi = self.tree.ranks(c.astype(np.uint32), lo, hi)
            more = hi - lo > 1
            shift = self.shift[c[more]]
            live, lo, hi = live[more], lo[more] + shift, hi[more] + shift
            statistic[live] += 1
        low[live], high[live] = lo, hi
        return statistic, low, high


def earliest(pieces: list[bytes], counts: np.ndarray, docs: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each window of the segments, the smallest document that holds it."""
    known: dict[bytes, int] = {}
    lengths = counts + window - 1
    # A zero after each segment parts it from the next.
    words = np.fromiter((known.setdefault(w, len(known) + 1) for w in b" ".join(pieces).split()), np.int64)
    sequence = np.insert(words, np.cumsum(lengths), 0)
    begins = np.cumsum(lengths + 1) - (lengths + 1)
    index = FMIndex(sequence, int(lengths.max()))
    starts = spread(begins, counts)
    out = np.repeat(docs, counts)
    for k in range(0, len(starts), BATCH):
        statistic, lo, hi = index.matching(sequence, starts[k : k + BATCH], window)
        some = np.flatnonzero(statistic >= window)
        if len(some):
            # Intervals of windows of one length are equal or disjoint.
            low, at = np.unique(lo[some], return_inverse=True)
            size = np.zeros(len(low), np.int64)
            size[at] = hi[some] - lo[some]
            holder = docs[np.searchsorted(begins, index.locate(spread(low, size)), side="right") - 1]
            out[k + some] = np.minimum.reduceat(holder, np.cumsum(size) - size)[at]
    return out


def read(texts: list[bytes]) -> Buffer:
    split = [t.split() for t in texts]
    words = [w for ws in split for w in ws]
    raw = b" ".join(words)
    begins = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)]).tolist()

    def result(k: int, doc, gone: np.ndarray) -> tuple:
        kept = b" ".join(w for w, g in zip(split[k], gone.tolist(), strict=True) if not g) if gone.any() else b" ".join(split[k])
        return doc, len(split[k]), int(gone.sum()), hashlib.sha256(kept).hexdigest()

    symbols = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return Buffer(symbols, np.fromiter(map(len, split), np.int64, len(split)), lambda a, b: raw[begins[a] : begins[b] - 1], result)


KIND = Kind(WINDOW, GRAM, read, word_grams, earliest, "n_words long, n_removed long, kept_sha256 string")


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each text without the words of repeated windows."""
    out = repeats(docs, KIND)
    return out.select(real_id("doc").alias("doc_id"), "n_words", "n_removed", "kept_sha256")
