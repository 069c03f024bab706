"""Suffix-array dedup: bytes in windows that start in an earlier document go, by longest-previous-factor arrays.

The segments of a shard stand in the order of their documents.  The suffixes at which windows start are sorted to the
depth of a window; the common prefixes of neighbours in this order are counted from their bytes.  Of each suffix, the
previous and the next one in suffix order that stand earlier in the text (previous and next smaller positions) are its
best earlier matches; the longer of the two is its longest previous factor.  A window whose longest previous factor
covers it is a copy.  Following the earlier matches leads to the first suffix with the window, which is in the smallest
document that holds it; so later copies go and the first one stays.

Results for odd input.  A null text has no bytes; texts shorter than a window lose none.  Rows with equal doc_id are
one document for comparison, and none of them removes from another; each is returned.  A null doc_id counts as the
smallest and stays null.  Other columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from metaloom.llm.anchors import Buffer, Kind, repeats, spread
from metaloom.llm.base import MIX_A, mixed, real_id

WINDOW, GRAM = 50, 16
#: Bytes of the first two ranks that suffixes get.
STEP = 5


def packed(data: np.ndarray, size: int = 8) -> np.ndarray:
    """The size bytes from each position as one number, with zeros after the end."""
    x = np.concatenate([data, np.zeros(7, np.uint8)]).astype(np.uint64)
    for k in (1, 2, 4):
        x = (x[:-k] << np.uint64(8 * k)) | x[k:]
    return x >> np.uint64(64 - 8 * size)


def byte_grams(data: np.ndarray) -> np.ndarray:
    p = packed(data)
    n = len(data) - GRAM + 1
    return mixed(p[:n] * MIX_A ^ (p[8 : 8 + n] >> np.uint64(3)) ^ (p[8 : 8 + n] << np.uint64(61)))


def sorted_ranks(*keys: tuple[np.ndarray, int]) -> tuple[np.ndarray, np.ndarray]:
    """The order by keys of so many bits each, equals by place, and the dense rank of each place.

    Keys and place share 64 bits, so that plain numbers are sorted.
    """
    n = len(keys[0][0])
    bits = max(1, n.bit_length())
    if sum(b for _, b in keys) + bits > 64:
        raise ValueError("a shard of too many symbols")
    x = np.zeros(n, np.uint64)
    for key, b in keys:
        x = (x << np.uint64(b)) | key
    x = np.sort((x << np.uint64(bits)) | np.arange(n, dtype=np.uint64))
    order = (x & np.uint64((1 << bits) - 1)).astype(np.int64)
    x >>= np.uint64(bits)
    ranks = np.empty(n, np.uint64)
    ranks[order] = np.cumsum(np.r_[False, x[1:] != x[:-1]][:n], dtype=np.uint64)
    return order, ranks


def suffix_order(data: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes at starts in the order of their first depth bytes (10 at least), equals by position."""
    bits = max(1, len(data).bit_length())
    ahead = lambda r, k: np.concatenate([r[k:], np.zeros(min(k, len(r)), np.uint64)])
    _, rank = sorted_ranks((packed(data, STEP), 8 * STEP))
    rank += np.uint64(1)
    _, rank = sorted_ranks((rank, bits), (ahead(rank, STEP), bits))
    rank = np.concatenate([rank + np.uint64(1), np.zeros(depth, np.uint64)])
    order, group = sorted_ranks((rank[starts], bits + 1))
    for k in [*range(2 * STEP, depth - 2 * STEP, 2 * STEP), depth - 2 * STEP][: None if depth > 2 * STEP else 0]:
        order, group = sorted_ranks((group, max(1, len(starts).bit_length())), (rank[starts + k], bits + 1))
    return order


def common_prefixes(data: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """How many bytes each suffix has in common with the one before it in the order, up to depth; the first has none."""
    p = packed(np.concatenate([data, np.zeros(depth + 8, np.uint8)]))
    a, b = places[:-1], places[1:]
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for k in range(0, depth, 8):
        x = p[a[live] + k] ^ p[b[live] + k]
        out[live] += sum((x < np.uint64(1 << 8 * t)).astype(np.int64) for t in range(8))
        live = live[x == 0]
    return np.r_[0, np.minimum(np.minimum(out, depth), len(data) - np.maximum(a, b))][: len(places)]


def previous_smaller(places: np.ndarray, common: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix the last before it in the order with a smaller position, and their common bytes.

    Only such with at least so many common bytes are looked for; else the place is -1 with 0.  A candidate that is not
    smaller hands on to its own candidate: all between the two are larger than it.
    """
    to, shared = np.arange(-1, len(places) - 1), common.copy()
    live = np.flatnonzero((to >= 0) & (shared >= least))
    live = live[places[to[live]] > places[live]]
    while len(live):
        over = to[live]
        shared[live], to[live] = np.minimum(shared[live], shared[over]), to[over]
        live = live[(to[live] >= 0) & (shared[live] >= least)]
        live = live[places[to[live]] > places[live]]
    none = (to < 0) | (shared < least)
    return np.where(none, -1, to), np.where(none, 0, shared)


def longest_previous_factors(data: np.ndarray, starts: np.ndarray, depth: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """For each start the length (at most depth) of its longest previous factor among the starts, 0 if it is shorter
    than least, and the number of the start where that factor is (its own number if there is none)."""
    order = suffix_order(data, starts, depth)
    places = starts[order]
    common = common_prefixes(data, places, depth)
    before, with_before = previous_smaller(places, common, least)
    # The same from the other end; each suffix's common bytes are then those with the next one.
    after, with_after = previous_smaller(places[::-1], np.r_[0, common[:0:-1]], least)
    after, with_after = np.where(after < 0, -1, len(order) - 1 - after)[::-1], with_after[::-1]
    best = np.where(with_before >= with_after, before, after)
    factor, source = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    factor[order] = np.maximum(with_before, with_after)
    source[order] = np.where(best < 0, order, order[best])
    return factor, source


def earliest(pieces: list[bytes], counts: np.ndarray, docs: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each window of the segments, which are in the order of docs, the smallest document that holds it."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    lengths = counts + window - 1
    starts = spread(np.cumsum(lengths) - lengths, counts)
    factor, source = longest_previous_factors(data, starts, window, window)
    first = np.where(factor >= window, source, np.arange(len(starts)))
    while (then := first[first]).tobytes() != first.tobytes():
        first = then
    return np.repeat(docs, counts)[first]


def read(texts: list[bytes]) -> Buffer:
    raw = b"".join(texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))

    def result(k: int, doc, gone: np.ndarray) -> tuple:
        data = np.frombuffer(texts[k], np.uint8)
        spans = int((np.diff(np.r_[False, gone].astype(np.int8)) == 1).sum())
        return doc, len(data), int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()

    return Buffer(np.frombuffer(raw, np.uint8), lengths, lambda a, b: raw[a:b], result)


KIND = Kind(WINDOW, GRAM, read, byte_grams, earliest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each text without the bytes of repeated windows."""
    out = repeats(docs, KIND)
    return out.select(real_id("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
