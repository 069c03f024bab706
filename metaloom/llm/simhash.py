"""SimHash near-dedup by a pigeonring filter.

The 64-bit fingerprint is a ring of four segments of 16 bits.  If two fingerprints differ in at most 3 bits, then by
the pigeonring principle some chain of consecutive segments keeps to its share of the differences at every length:
the first segment differs in at most 3/4 of a bit (so in none), the first two in at most 6/4 (one), the first three
in at most 9/4 (two) and all four in at most 3.  The first two conditions become an exact key: the start, the first
segment, and the second segment or a value one bit from it.  A flip changes the parity of the second segment, so only
the even side needs to send its 16 flips.  Pairs that meet under a key pass the conditions of length two to four
before the full Hamming check.

Fingerprints are made unique first, so thousands of copies are one row.  A key under which many different
fingerprints meet is cut in blocks, and each pair of blocks is a group of its own, so no group outgrows a task.  A
group does not return its pairs but a spanning forest of their links; the components are the same.

Results for odd input.  A null, empty or blank text has fingerprint zero, which is linked like any other.  Each row
has its own fingerprint; rows with one doc_id are one node, so their fingerprints are in one component.  A null doc_id counts as the smallest
id, and its component is null.  Other columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.llm.base import known_id, partitions, real_id, saved, small_batches, unused, utf8
from metaloom.llm.components import components
from metaloom.llm.jaccard import later_copies

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Most different fingerprints in one block of a key.
BLOCK = 2048
SLICE = 1 << 20


def word_slices(data: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """The words of data, a bounded number of bytes at a time."""
    at = 0
    while len(data) - at > size:
        end = at + size
        while end < len(data) and data[end] not in b" \t\n\x0b\f\r":
            end += 1
        yield data[at:end].split()
        at = end
    yield data[at:].split()


def simhash(text: str | None) -> int:
    """The 64-bit SimHash of the shingles of three words, repeats included."""
    counts, n, rest = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for words in word_slices(utf8(text).lower()):
        words = rest + words
        m = len(words) - SHINGLE + 1
        if m > 0:
            h = np.fromiter((digest(b"%b %b %b" % x, SEED) for x in zip(words, words[1:], words[2:], strict=False)), np.uint64, m)
            counts += np.unpackbits(h.view(np.uint8).reshape(m, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n += m
            words = words[m:]
        rest = words
    if not n:
        return digest(b" ".join(rest), SEED) if rest else 0
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc, fp): the fingerprint of each row as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc": pdf["doc"], "fp": np.array([_signed(simhash(t)) for t in pdf["text"]], np.int64)})

    return docs.select(known_id().alias("doc"), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc long, fp long")


def _keys(batches):
    """For each fingerprint and start: its own key, and from even second segments the keys one bit away."""
    flips = np.uint64(1) << np.arange(16, dtype=np.uint64)
    for pdf in batches:
        fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        for start in range(4):
            turn = np.uint64(16 * start)
            ring = (fp << turn) | (fp >> (np.uint64(64) - turn)) if start else fp
            pair = (ring >> np.uint64(32)).astype(np.int64)
            own = pair + (start << 32)
            even = np.bitwise_count(pair & 0xFFFF) % 2 == 0
            away = (own[even].astype(np.uint64)[:, None] ^ flips[None, :]).astype(np.int64).ravel()
            yield pd.DataFrame({"key": np.concatenate([own, away]), "own": np.concatenate([np.ones(len(own), bool), np.zeros(len(away), bool)]), "fp": np.concatenate([fp, np.repeat(fp[even], 16)]).view(np.int64)})


def within(a: np.ndarray, b: np.ndarray, start: np.ndarray | int) -> np.ndarray:
    """Which pairs keep to the chain's shares of the differences from a start on, and to 3 bits in all."""
    turn = np.asarray(start, np.uint64) * np.uint64(16)
    x = a ^ b
    x = (x << turn) | (x >> ((np.uint64(64) - turn) & np.uint64(63)))
    ok = np.bitwise_count(x >> np.uint64(32)) <= DISTANCE * 2 // 4
    ok &= np.bitwise_count(x >> np.uint64(16)) <= DISTANCE * 3 // 4
    return ok & (np.bitwise_count(x) <= DISTANCE)


def forest(fp: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Links of a spanning forest over all pairs of fp that are within distance: each is compared with the rest only
    until it has a place, so a dense group costs about as much as it has members."""
    unseen, found = np.ones(len(fp), bool), []
    for first in range(len(fp)):
        stack = [first] if unseen[first] else []
        unseen[first] = False
        while stack:
            i = stack.pop()
            rest = np.flatnonzero(unseen)
            near = rest[within(fp[i], fp[rest], start)]
            unseen[near] = False
            found += [(fp[i], fp[j]) for j in near]
            stack.extend(near.tolist())
    return found


def _linked(batches):
    """Links in each run of equal (key, x, y); the partition is sorted by them."""
    rest = None

    def of(pdf):
        fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        start = (pdf["key"].to_numpy(np.int64) >> 32).astype(np.uint64)
        cut = np.flatnonzero(np.r_[True, (np.diff(pdf["key"]) != 0) | (np.diff(pdf["x"]) != 0) | (np.diff(pdf["y"]) != 0), True])
        size = np.diff(cut)
        two = cut[:-1][size == 2]
        two = two[within(fp[two], fp[two + 1], start[two])]
        pairs = [np.stack([fp[two], fp[two + 1]], axis=1)]
        for i in np.flatnonzero(size > 2):
            pairs.append(np.array(forest(np.unique(fp[cut[i] : cut[i + 1]]), int(start[cut[i]])), np.uint64).reshape(-1, 2))
        return pd.DataFrame(np.concatenate(pairs).view(np.int64), columns=["a", "b"])

    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        last = (pdf[["key", "x", "y"]] == pdf[["key", "x", "y"]].iloc[-1]).all(axis=1).to_numpy()
        done = len(pdf) - int(last.sum())
        rest = pdf.iloc[done:]
        if done:
            yield of(pdf.iloc[:done])
    if rest is not None:
        yield of(rest)


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links between different fingerprints, with the components of all links of 3 bits or fewer."""
    small_batches(fps.sparkSession, 10_000)
    # A few bytes of fingerprints become many of keys: dealt out evenly first.
    unique = fps.select("fp").distinct().repartition(partitions(fps.sparkSession), "fp")
    keys = unique.mapInPandas(_keys, "key long, own boolean, fp long")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("n_own"))
    # A key with a single fingerprint, or with flips only, links nothing.
    sizes = sizes.filter((F.col("n") > 1) & (F.col("n_own") > 0))
    # Spark takes the keys for as many as the fingerprints, of which each has up to 68: never sent to all tasks by that guess.
    met = keys.hint("merge").join(sizes, "key").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    met = met.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", "fp", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y")).distinct()
    met = met.repartition(partitions(fps.sparkSession), "key", "x", "y").sortWithinPartitions("key", "x", "y")
    return met.select("key", "x", "y", "fp").mapInPandas(_linked, "a long, b long").filter("a != b").distinct()


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row: the smallest doc_id reachable over links of 3 bits or fewer."""
    fps = saved(fingerprints(docs), "simhash")
    nodes = fps.groupBy("fp").agg(F.min("doc").alias("id"))
    found = links(fps, block)
    found = found.join(nodes.select(F.col("fp").alias("a"), F.col("id").alias("u")), "a").join(nodes.select(F.col("fp").alias("b"), F.col("id").alias("v")), "b")
    labels = components(found.select("u", "v"))
    named = nodes.hint("merge").join(labels, nodes["id"] == labels["node"], "left").select("fp", F.coalesce("label", "id").alias("component"))
    both = fps.hint("merge").join(named, "fp")
    return both.select(real_id("doc").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), real_id("component").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each component the document with the smallest id, as it is; rows that repeat its id and text are one.

    Components here are of pairs whose sets of five-word shingles have a Jaccard likeness of 0.8 or more.  The SimHashes of
    the sets are linked as fingerprints are in ``links``, and whole sets decide on each link; a prefix filter adds the
    pairs of that likeness that lie more than three bits apart.
    """
    (key,) = unused(docs, "id")
    gone = later_copies(docs, links).withColumnRenamed("node", key)
    rows = docs.withColumn(key, known_id())
    return rows.join(gone, key, "left_anti").dropDuplicates([key, "text"]).select(docs.columns)
