"""Finds repeated windows of symbols across documents, by anchors that send equal windows to the same shard.

A window is ``window`` consecutive symbols of one document.  Its anchor is the least hash among its grams of ``gram``
symbols (the first of equals), so equal windows have equal anchors.  Neighbouring windows mostly share an anchor; their
run is a segment.  Rows are kept in chunks of a bounded size, and chunks and buckets of anchors exchange arrays:

1. each chunk sends the anchors it holds, once each, with their smallest document, to their buckets;
2. each bucket answers which anchors several documents hold; only their segments go further;
3. each chunk sends the different segments below those anchors, with the smallest document of each, to the buckets;
4. each bucket makes equal segments one (their bytes are compared, not hashes), indexes them a shard at a time, and
   answers from the index, for each window of each segment, the smallest document that holds it;
5. each chunk reads its texts again: a window whose smallest document is smaller than its own is a repeat.

A chunk sends a segment once, however often its rows hold it, so a passage or a whole text that a third of all rows
share costs a row a chunk.  An anchor with very many segments (a stock phrase in many surroundings) is dealt out
further: each of its windows is a segment of its own, below the hash of the whole window, so equal windows still meet
and no bucket outgrows the others.  Every removal is an answer of the index; nothing is decided by a hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.llm.base import MIX_A, known_id, mixed, partitions, saved, small_batches

#: Symbols that are scanned at a time, and of one shard's index.
SLICE, SHARD_SYMBOLS = 1 << 19, 1 << 19
#: Segments below an anchor, beyond which its windows are dealt out one by one.
HOT_SEGMENTS = 4096
#: Bytes of text in a chunk (at least and at most, or one long text), and in what a bucket stands for; anchors that a
#: task keeps before it sends them.
LEAST_CHUNK_BYTES, CHUNK_BYTES, BUCKET_BYTES, KEPT_ANCHORS = 1 << 18, 1 << 22, 1 << 23, 1 << 20
_LOW, _HALF = np.uint64((1 << 21) - 1), np.uint64(32)
_NONE = np.zeros(0, np.int64)


@dataclass
class Buffer:
    """The texts of a chunk: hashes or bytes as symbols, symbols of each text, and the bytes of symbols a to b."""

    symbols: np.ndarray
    lengths: np.ndarray
    cut: Callable[[int, int], bytes]
    #: The result of text k, given its document and which of its symbols are gone.
    result: Callable[[int, object, np.ndarray], tuple]


@dataclass(frozen=True)
class Kind:
    """What symbols are, and how windows of them are found."""

    window: int
    gram: int
    read: Callable[[list[bytes]], Buffer]
    grams: Callable[[np.ndarray], np.ndarray]
    #: Of (bytes of segments in the order of documents, windows of each, document of each): the smallest for each window.
    index: Callable[[list[bytes], np.ndarray, np.ndarray], np.ndarray]
    columns: str


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1 ... for each start, as many as counted."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def member(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which of x are in a sorted array."""
    return of[np.minimum(np.searchsorted(of, x), len(of) - 1)] == x if len(of) else np.zeros(len(x), bool)


def segments(kind: Kind, symbols: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(key of the anchor, first window, windows, text) of the segments of texts put together, and the slice's grams
    with its offset."""
    owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    last = np.cumsum(lengths) - kind.window
    n = len(symbols) - kind.window + 1
    width = kind.window - kind.gram + 1
    for at in range(0, max(n, 0), SLICE):
        part = symbols[at : at + SLICE + kind.window - 1]
        g = kind.grams(part)
        low = (g & ~_LOW) | np.arange(len(g), dtype=np.uint64)
        size = 1
        while 2 * size <= width:  # minima over 1, 2, 4 ... grams
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < width:
            low = np.minimum(low[: len(low) - width + size], low[width - size :])
        where = (low & _LOW).astype(np.int64)
        inside = np.arange(at, at + len(where)) <= last[owner[at : at + len(where)]]
        first = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]) | (inside[1:] != inside[:-1])])
        count = np.diff(np.r_[first, len(where)])
        some = inside[first]
        first, count = first[some], count[some]
        # Least hashes are small numbers; mixed again they spread over all buckets.
        yield mixed(g[where[first]] ^ MIX_A), first + at, count, owner[first + at], g, at


def held(kind: Kind, buffer: Buffer, cold: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, first window, windows, text) of the segments below shared anchors, hot ones a window at a time."""
    offsets = [*range(0, kind.window - kind.gram, kind.gram), kind.window - kind.gram]
    out = []
    for key, first, count, owner, g, at in segments(kind, buffer.symbols, buffer.lengths):
        c, h = member(key, cold), member(key, hot)
        out.append((key[c], first[c], count[c], owner[c]))
        if h.any():
            window = spread(first[h], count[h])
            whole = np.zeros(len(window), np.uint64)
            for k in offsets:
                whole = mixed(whole * MIX_A + g[window - at + k])
            out.append((whole, window, np.ones(len(window), np.int64), np.repeat(owner[h], count[h])))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64), _NONE, _NONE, _NONE)


def numbered(pieces) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
    """Numbers for equal pieces of bytes: the different ones in order, the number of each, and where each is first."""
    ids: dict[bytes, int] = {}
    of = np.fromiter((ids.setdefault(p, len(ids)) for p in pieces), np.int64)
    first = np.flatnonzero(np.r_[True, of[1:] > np.maximum.accumulate(of)[:-1]]) if len(of) else _NONE
    return ids, of, first


def least_of(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(out, of, values)
    return out


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of sorted keys, with where each begins and ends."""
    bucket = ((keys >> _HALF) * np.uint64(buckets) >> _HALF).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else _NONE
    return bucket[first], first, np.r_[first[1:], len(bucket)]


def together(arrays) -> np.ndarray:
    arrays = [x for x in arrays if x is not None and len(x)]
    return np.concatenate(arrays) if arrays else _NONE


def chunked(docs: DataFrame) -> tuple[DataFrame, int]:
    """(chunk, docs, sizes, data): the rows in order, packed in chunks of a bounded size, and the bytes of all texts."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(known_id().alias("doc"), text.alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    most = min(CHUNK_BYTES, max(LEAST_CHUNK_BYTES, total // (2 * partitions(spark))))

    def pack(batches):
        chunk, texts, ids, size = TaskContext.get().partitionId() << 32, [], [], 0

        def row():
            return pd.DataFrame({"chunk": [chunk], "docs": [np.array(ids, np.int64)], "sizes": [np.fromiter(map(len, texts), np.int32)], "data": [_squeezed(b"".join(texts))]})

        for pdf in batches:
            for doc, raw in zip(pdf["doc"], pdf["text"], strict=True):
                if texts and (size + len(raw) > most or len(texts) >= 1 << 16):
                    yield row()
                    chunk, texts, ids, size = chunk + 1, [], [], 0
                texts.append(raw)
                ids.append(doc)
                size += len(raw)
        if texts:
            yield row()

    small_batches(spark)
    return saved(rows.mapInPandas(pack, "chunk long, docs array<long>, sizes array<int>, data binary"), "chunks"), total


def _squeezed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _pieces(data: bytes, sizes: np.ndarray) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    ends = np.cumsum(sizes, dtype=np.int64)
    return list(map(raw.__getitem__, map(slice, (ends - sizes).tolist(), ends.tolist())))


def repeats(docs: DataFrame, kind: Kind) -> DataFrame:
    """For each row its id (as ``doc``) and the columns of the kind."""
    spark = docs.sparkSession
    rows, total = chunked(docs)
    buckets = max(2 * partitions(spark), total // BUCKET_BYTES)
    small_batches(spark, 4)  # a row is a chunk, or what a chunk and a bucket have to do with each other

    def anchor_rows(batches):
        kept: dict[int, list] = {}
        size = 0

        def sent():
            for chunk, parts in kept.items():
                keys, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.argsort(keys)
                keys, doc = keys[order], doc[order]
                first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                keys, n = keys[first], np.diff(np.r_[first, len(doc)]).astype(np.int32)
                low, high = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
                n[low < high] *= -1  # a negative count: of several documents
                b, a, z = by_bucket(keys, buckets)
                cut = [slice(*x) for x in zip(a.tolist(), z.tolist(), strict=True)]
                yield pd.DataFrame({"bucket": b, "chunk": chunk, "keys": [keys[s].view(np.int64) for s in cut], "low": [low[s] for s in cut], "n": [n[s] for s in cut]})

        for pdf in batches:
            for chunk, doc, sizes, data in zip(pdf["chunk"], pdf["docs"], pdf["sizes"], pdf["data"], strict=True):
                buffer = kind.read(_pieces(data, sizes))
                for key, _, _, owner, *_ in segments(kind, buffer.symbols, buffer.lengths):
                    if len(key):
                        kept.setdefault(chunk, []).append((key, doc[owner]))
                        size += len(key)
            if size > KEPT_ANCHORS:
                yield from sent()
                kept, size = {}, 0
        yield from sent()

    def answered(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of a bucket: for each chunk its anchors that several documents hold, those with very many segments apart."""
        keys, low, n = (np.concatenate(pdf[c].to_list()) for c in ("keys", "low", "n"))
        order = np.argsort(keys)
        keys, low, n = keys[order], low[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        shared = (np.minimum.reduceat(low, first) < np.maximum.reduceat(low, first)) | (np.minimum.reduceat(n, first) < 0)
        many = np.add.reduceat(np.abs(n), first) > HOT_SEGMENTS
        state = np.zeros(len(keys), np.int8)
        state[order] = np.repeat(shared * (1 + many), np.diff(np.r_[first, len(keys)]))
        state = np.split(state, np.cumsum(pdf["keys"].str.len())[:-1])
        out = pd.DataFrame({"chunk": pdf["chunk"], **{c: [k[s == x] for k, s in zip(pdf["keys"], state, strict=True)] for c, x in (("cold", 1), ("hot", 2))}})
        return out[[bool(s.any()) for s in state]]

    sent = rows.mapInPandas(anchor_rows, "bucket long, chunk long, keys array<long>, low array<long>, n array<int>")
    shared = saved(sent.groupBy("bucket").applyInPandas(answered, "chunk long, cold array<long>, hot array<long>"), "shared")

    def below(left: pd.DataFrame, right: pd.DataFrame):
        """The chunk's texts, its segments, and the numbers of the different ones, in an order that is always the same."""
        buffer = kind.read(_pieces(left["data"].iloc[0], left["sizes"].iloc[0]))
        cold, hot = (np.unique(together(right[c]).view(np.uint64)) for c in ("cold", "hot"))
        key, first, count, owner = held(kind, buffer, cold, hot)
        ends = first + count + kind.window - 1
        ids, of, new = numbered(map(buffer.cut, first.tolist(), ends.tolist()))
        return left["docs"].iloc[0], buffer, (key, first, count, owner), ids, of, new, np.argsort(key[new], kind="stable")

    def segment_rows(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["bucket", "chunk", "keys", "docs", "counts", "sizes", "data"]
        if not len(right) or not len(left):
            return pd.DataFrame(columns=columns)
        doc, _, (key, _, count, owner), ids, of, new, order = below(left, right)
        pieces = list(ids)
        pieces = [pieces[i] for i in order.tolist()]
        keys, counts = key[new][order], count[new][order].astype(np.int32)
        low = least_of(of, doc[owner], len(ids))[order]
        sizes = np.fromiter(map(len, pieces), np.int32, len(pieces))
        b, a, z = by_bucket(keys, buckets)
        cut = [slice(*x) for x in zip(a.tolist(), z.tolist(), strict=True)]
        return pd.DataFrame({"bucket": b, "chunk": left["chunk"].iloc[0], "keys": [keys[s].view(np.int64) for s in cut], "docs": [low[s] for s in cut], "counts": [counts[s] for s in cut], "sizes": [sizes[s] for s in cut], "data": [_squeezed(b"".join(pieces[s])) for s in cut]})

    def indexed(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of a bucket: for each chunk the smallest document of each window that it sent, as runs of equal values."""
        keys, docs, counts = (np.concatenate(pdf[c].to_list()) for c in ("keys", "docs", "counts"))
        ids, of, new = numbered(p for data, sizes in zip(pdf["data"], pdf["sizes"], strict=True) for p in _pieces(data, sizes))
        text, low = list(ids), least_of(of, docs, len(ids))
        count = counts[new].astype(np.int64)
        offset = np.cumsum(count) - count
        least = np.empty(int(count.sum()), np.int64)
        by_key = np.argsort(keys[new].view(np.uint64), kind="stable")
        size = np.cumsum((count + kind.window - 1)[by_key])
        run = np.flatnonzero(np.r_[True, np.diff(keys[new][by_key]) != 0, True])
        at = 0
        while at < len(run) - 1:  # a shard ends where a key ends
            stop = max(at + 1, int(np.searchsorted(size[run[1:] - 1], size[run[at]] + SHARD_SYMBOLS, side="right")))
            some = by_key[run[at] : run[stop]]
            some = some[np.argsort(low[some], kind="stable")]
            least[spread(offset[some], count[some])] = kind.index([text[i] for i in some.tolist()], count[some], low[some])
            at = stop
        values, runs = [], []
        for part in np.split(of, np.cumsum(pdf["keys"].str.len())[:-1]):
            got = least[spread(offset[part], count[part])]
            first = np.flatnonzero(np.r_[True, got[1:] != got[:-1]])
            values.append(got[first])
            runs.append(np.diff(np.r_[first, len(got)]))
        return pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "least": values, "runs": runs})

    def finished(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["doc", *[c.split()[0] for c in kind.columns.split(", ")]]
        if not len(left):
            return pd.DataFrame(columns=names)
        right = right.sort_values("bucket")
        doc, buffer, (_, first, count, owner), _, of, new, order = below(left, right)
        gone = np.zeros(len(buffer.symbols), bool)
        if len(first):
            least = np.repeat(together(right["least"]), together(right["runs"]))
            n = count[new][order]
            offset = np.empty(len(new), np.int64)
            offset[order] = np.cumsum(n) - n
            hit = least[spread(offset[of], count)] < np.repeat(doc[owner], count)
            at = spread(first, count)[hit]
            edge = np.bincount(at, minlength=len(gone) + 1) - np.bincount(at + kind.window, minlength=len(gone) + 1)
            gone = np.cumsum(edge)[: len(gone)] > 0
        parts = np.split(gone, np.cumsum(buffer.lengths)[:-1])
        return pd.DataFrame([buffer.result(k, d, g) for k, (d, g) in enumerate(zip(doc, parts, strict=True))], columns=names)

    texts = rows.groupBy("chunk")
    sent = texts.cogroup(shared.groupBy("chunk")).applyInPandas(segment_rows, "bucket long, chunk long, keys array<long>, docs array<long>, counts array<int>, sizes array<int>, data binary")
    least = saved(sent.groupBy("bucket").applyInPandas(indexed, "chunk long, bucket long, least array<long>, runs array<long>"), "least")
    known = shared.withColumn("bucket", F.lit(None).cast("long")).unionByName(least, allowMissingColumns=True)
    return texts.cogroup(known.groupBy("chunk")).applyInPandas(finished, f"doc long, {kind.columns}")
