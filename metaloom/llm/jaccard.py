"""Near duplicates by the exact Jaccard likeness of shingle sets: no pair at or over the threshold is missed.

Two sets with a likeness of 4/5 share at least 4/5 of the larger one.  So if the shingles are in any order that is the
same for all documents, the first n - ceil(4n/5) + 1 shingles of the one and of the other have one in common (prefix
filtering).  Documents that meet under such a shingle are candidates, and the intersection of their whole sets decides.
A 64-bit SimHash alone can't find all of them: at this likeness it differs in about ten bits, and in any number now and then.
So sets whose SimHashes link come first: whole sets decide on each link, and what that unites is not compared again.  The
filter finds the rest.

The order is that of hashes, with shingles that many rows hold at its end, the most frequent last; an order changes
which candidates meet, never the result.  Equal sets are one row.  What is left under a shingle is cut in blocks, and
each pair of blocks returns a spanning forest of its possible links.  If all of those hold, the components are known, so dense
groups cost about as many links as they have members.  If one does not, the sets whose shingles are still in doubt come
again with wide bitmaps, under which hardly a pair is possible that is not alike.  A shingle takes a forest again as long
as the last one united something there; one at which all was refuted is settled by each possible link between
components.  All of that is found in blocks, and only what passes the bitmaps is a row.

Before whole sets move, parity bitmaps bound their difference: each shingle flips one bit, so two bitmaps differ in no
more bits than the sets in shingles, and at this likeness the sets differ in at most (a + b) / 9 of them.  FEW longs
of the bitmap travel with every shingle and decide in the join itself; all of it, two to four bits a shingle, decides
on each pair once.  What passes both is nearly always alike, and whole sets decide on that.

Results for odd input.  A null, empty or blank text has an empty set, and all such texts are near duplicates; a text of
fewer than five words is one shingle.  Rows with one doc_id are one node.  A null doc_id counts as the smallest id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.llm.base import MIX_A, discard, known_id, mixed, partitions, saved, small_batches, utf8
from metaloom.llm.components import components

SHINGLE = 5
#: A shingle is moved to the end of the order if about so many rows or more hold it; at most so many are.  They are
#: looked for in the whole sets of one row in SAMPLE, which the result does not depend on.
HOT, MOST_HOT, SAMPLE = 64, 200_000, 16
#: Longs of a bitmap that travel with each shingle, and most longs of a bitmap; longer ones would only filter better.
FEW, MOST_LONGS = 4, 2048
FOLDED = [f"f{i}" for i in range(FEW)]
#: Most longs of the bitmaps with which sets in doubt come again.
WIDE = 32
#: Most sets in one block of a shingle.
BLOCK = 2048
#: Runs of so many sets are compared in one go where every link counts; longer ones set by set.
SHORT = 24


def shingles(text: str | None) -> np.ndarray:
    """The different shingles of five lower-case words, as hashes in order."""
    words = utf8(text).lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(SHINGLE, len(w))
    n = len(w) - size + 1
    h = w[:n].copy()
    for k in range(1, size):
        h = h * MIX_A + w[k : k + n]
    return np.unique(mixed(h))


def _key(s: np.ndarray) -> int:
    """64 bits that stand for a set."""
    return int.from_bytes(hashlib.md5(s.tobytes()).digest()[:8], "little", signed=True)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(known_id().alias("doc"), F.col("text").cast("string").alias("text"))


def _bits(s: np.ndarray) -> np.ndarray:
    """The parity bitmap of a set: of a power of two of longs, at least FEW, and at least two bits a shingle."""
    longs = FEW
    while longs < MOST_LONGS and 32 * longs < len(s):
        longs *= 2
    odd = np.bincount((s & np.uint64(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _fingerprint(s: np.ndarray) -> int:
    """The SimHash of a set: a bit is 1 if it is in over half of the shingles."""
    counts = np.unpackbits(s.view(np.uint8).reshape(len(s), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(s), bitorder="little").view(np.int64)[0])


def prefixes(rows: DataFrame, hot: np.ndarray) -> DataFrame:
    """(doc, k, n, fp, bits, prefix): the key of each row's set, its size, SimHash and bitmap, and the shingles by which it
    is met.

    hot has the shingles at the end of the order, in order.
    """
    by_value = np.argsort(hot)
    values = hot[by_value]

    def run(batches):
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc"], pdf["text"], strict=True):
                s = shingles(text)
                k, n, fp, bits = _key(s), len(s), _fingerprint(s), _bits(s)
                if len(values) and n:
                    at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                    s = s[np.argsort(np.where(values[at] == s, by_value[at], -1), kind="stable")]
                out.append((doc, k, n, fp, bits, s[: n - (4 * n + 4) // 5 + 1].view(np.int64)))
            yield pd.DataFrame(out, columns=["doc", "k", "n", "fp", "bits", "prefix"])

    return rows.mapInPandas(run, "doc long, k long, n int, fp long, bits array<long>, prefix array<long>")


def _hot(rows: DataFrame) -> np.ndarray:
    """The shingles that many rows hold, the most frequent last."""

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 64):
                yield pd.DataFrame({"s": np.concatenate([shingles(t) for t in pdf["text"][at : at + 64]]).view(np.int64)})

    sample = rows.filter(F.pmod(F.xxhash64("doc"), F.lit(SAMPLE)) == 0).mapInPandas(run, "s long")
    often = sample.groupBy("s").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > HOT // SAMPLE)
    found = often.orderBy(F.desc("c"), "s").limit(MOST_HOT).toPandas()
    return found["s"].to_numpy(np.int64)[::-1].copy().view(np.uint64)


def _alike(rows: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs of keys (u, v) whose whole sets have a likeness of 4/5."""

    def end(x):
        return nodes.select(F.col("k").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"b{x}"))

    close = pairs.join(end("u"), "u").join(end("v"), "v")
    close = saved(close.filter(9 * _differing("bu", "bv") <= F.col("nu") + F.col("nv")).select("u", "v"), "close")
    wanted = close.select(F.col("u").alias("k")).union(close.select(F.col("v").alias("k"))).distinct()
    wanted = nodes.join(wanted, "k", "left_semi").select("doc").distinct()

    def run(batches):
        for pdf in batches:
            sets = [shingles(t) for t in pdf["text"]]
            yield pd.DataFrame({"k": np.array([_key(s) for s in sets], np.int64), "s": [s.view(np.int64) for s in sets]})

    sets = saved(rows.join(wanted, "doc", "left_semi").mapInPandas(run, "k long, s array<long>"), "sets")
    both = close.join(sets.select(F.col("k").alias("u"), F.col("s").alias("su")), "u").join(sets.select(F.col("k").alias("v"), F.col("s").alias("sv")), "v")
    # o / (a + b - o) >= 4/5 in whole numbers.
    near = 9 * F.size(F.array_intersect("su", "sv")) >= 4 * (F.size("su") + F.size("sv"))
    out = saved(both.filter(near).select("u", "v").distinct(), "alike")
    discard(sets, close)
    return out


def _differing(a: str, b: str) -> Column:
    """In how many bits two bitmaps differ; the longer of two neighbouring sizes is folded, which keeps the bound."""

    def xor(x, y):
        return F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q))

    def half(x):
        n = (F.size(x) / 2).cast("int")
        return xor(F.slice(x, F.lit(1), n), F.slice(x, n + 1, n))

    def ones(x):
        return F.aggregate(x, F.lit(0), lambda t, p: t + F.bit_count(p))

    same = F.when(F.size(a) == F.size(b), ones(xor(F.col(a), F.col(b))))
    return same.when(F.size(a) > F.size(b), ones(xor(half(a), F.col(b)))).otherwise(ones(xor(F.col(a), half(b))))


def _few() -> list[Column]:
    """The whole bitmap folded to FEW longs."""

    def part(i):
        every = F.filter("bits", lambda _, at: at % FEW == i)
        return F.aggregate(every, F.lit(0).cast("long"), lambda t, p: t.bitwiseXOR(p))

    return [part(i).alias(f"f{i}") for i in range(FEW)]


def _several(met: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of met with the label of their component, where sets of several components have a shingle."""
    labels = components(found).withColumnRenamed("node", "k")
    labelled = met.join(labels, "k", "left").withColumn("label", F.coalesce("label", "k"))
    # A table of its own, so that Spark can split a shingle that very many sets have; the labelled rows are not kept twice.
    several = saved(labelled.groupBy("s").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("s"), "doubtful")
    out = saved(labelled.join(several, "s", "left_semi"), "several")
    discard(several)
    return out


class _Folded:
    """Bitmaps of FEW longs each."""

    columns = FOLDED

    def __init__(self, pdf):
        self.bits = pdf[FOLDED].to_numpy(np.int64).view(np.uint64)  # bitwise_count takes a signed number for its absolute value

    def differing(self, i, j) -> np.ndarray:
        return np.bitwise_count(self.bits[i] ^ self.bits[j]).sum(axis=-1, dtype=np.int64)


class _Wide:
    """Bitmaps of up to WIDE longs.  Sets of a possible link differ in size by a quarter, so their bitmaps by one halving."""

    columns = ["wide"]

    def __init__(self, pdf):
        rows = [np.asarray(x, np.int64).view(np.uint64) for x in pdf["wide"]]
        self.longs, self.place, self.of = np.array([len(x) for x in rows]), np.zeros(len(rows), np.int64), {}
        for size in np.unique(self.longs):
            mine = np.flatnonzero(self.longs == size)
            self.place[mine] = np.arange(len(mine))
            self.of[size] = np.stack([rows[r] for r in mine])

    def _half(self, size, places):
        x = self.of[size][places]
        return x[..., : size // 2] ^ x[..., size // 2 :]

    def differing(self, i, j) -> np.ndarray:
        """In how many bits row i and each of rows j differ (or rows i and j, one by one); many where the sizes leave no
        possible link."""
        many = np.ndim(i) > 0
        out, mine, theirs = np.full(len(j), 1 << 40, np.int64), self.longs[i], self.longs[j]
        for size in np.unique(mine):
            for other in (size, 2 * size, size // 2):
                at = np.flatnonzero((mine == size) & (theirs == other))
                if len(at):
                    x, y = self.place[i[at] if many else i], self.place[j[at]]
                    a = self._half(size, x) if other < size else self.of[size][x]
                    b = self._half(other, y) if other > size else self.of[other][y]
                    out[at] = np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
        return out


def _could(n, at, bits, i, j) -> np.ndarray:
    """If sizes, places of a first common shingle in both orders and few bits leave room for a likeness of 4/5, for rows i
    (or one row) and rows j."""
    least, most, both = np.minimum(n[i], n[j]), np.maximum(n[i], n[j]), n[i] + n[j]
    out = (5 * least >= 4 * most) & (9 * np.minimum(n[i] - at[i], n[j] - at[j]) >= 4 * both)
    room = np.flatnonzero(out)
    out[room] = 9 * bits.differing(i[room] if np.ndim(i) else i, j[room]) <= both[room]
    return out


def _linking(kind):
    """Possible links between labels in each run of equal (s, x, y), every one where the rows say so, or else spanning
    forests; the partition is sorted."""

    def of(pdf):
        k, label, n, at = (pdf[c].to_numpy(np.int64) for c in ("k", "label", "n", "at"))
        bits, every = kind(pdf), pdf["every"].to_numpy(bool)
        cut = np.flatnonzero(np.r_[True, (np.diff(pdf[["s", "x", "y"]].to_numpy(np.int64), axis=0) != 0).any(axis=1), True])
        first, size = cut[:-1], np.diff(cut)
        at_once = (size == 2) | (every[first] & (size <= SHORT))
        found = [np.zeros((0, 2), np.int64)]
        for g in np.unique(size[at_once & (size > 1)]):
            i, j = ((first[at_once & (size == g)][:, None] + x).ravel() for x in np.triu_indices(g, 1))
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            near = _could(n, at, bits, i, j)
            found.append(np.stack([k[i[near]], k[j[near]]], axis=1))
        for g in np.flatnonzero(~at_once & (size > 2)):
            unseen = np.arange(cut[g], cut[g + 1])
            while len(unseen):
                stack, unseen = [unseen[0]], unseen[1:]
                while stack and len(unseen):
                    i = stack.pop()
                    same = label[unseen] == label[i]
                    near = same.copy()
                    near[~same] = _could(n, at, bits, i, unseen[~same])
                    new = unseen[near & ~same]
                    found.append(np.stack([np.full(len(new), k[i]), k[new]], axis=1))
                    if every[i]:
                        break
                    stack.extend(unseen[near].tolist())
                    unseen = unseen[~near]
        return pd.DataFrame(np.concatenate(found), columns=["u", "v"])

    def run(batches):
        rest = None
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            last = (pdf[["s", "x", "y"]] == pdf[["s", "x", "y"]].iloc[-1]).all(axis=1).to_numpy()
            done = len(pdf) - int(last.sum())
            rest = pdf.iloc[done:].reset_index(drop=True)
            if done:
                yield of(pdf.iloc[:done])
        if rest is not None:
            yield of(rest)

    return run


def _blocked(several: DataFrame, block: int, kind, bits: DataFrame | None = None) -> DataFrame:
    """(u, v), u < v: the possible links between labels in each shingle and pair of blocks, as forests or every one as the
    rows say; bits (k, wide) has the bitmaps that the rows have not with them, which join them on their way to the blocks
    and are in no table."""
    spark = several.sparkSession
    blocks = saved(several.groupBy("s").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")), "blocks")
    met = several.join(blocks, "s").withColumn("mine", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    met = met if bits is None else met.join(bits, "k")
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("s", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "k", "n", "at", "label", "every", *kind.columns)
    met = met.repartition(partitions(spark), "s", "x", "y").sortWithinPartitions("s", "x", "y")
    pairs = met.mapInPandas(_linking(kind), "u long, v long")
    out = saved(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "tree")
    discard(blocks)
    return out


def _in_doubt(several: DataFrame, alike: DataFrame, failed: DataFrame) -> DataFrame:
    """The rows of several under shingles at which an end of a failed link stands, and if every link is due there: if no
    end of a link that holds does.  A pair that is alike and not united was in one tree of its shingle, of which a link
    has failed, so no such shingle is missed; where every link was held against whole sets, nothing is in doubt."""

    def ends(links, united):
        return links.select(F.explode(F.array("u", "v")).alias("k"), F.lit(united).alias("united"))

    at = saved(ends(failed, False).union(ends(alike, True)).groupBy("k").agg(F.max("united").alias("united"), F.min("united").alias("held")), "ends")
    shingle = several.filter(~F.col("every")).join(at, "k").groupBy("s").agg(F.max("united").alias("united"), F.min("held").alias("held"))
    shingle = saved(shingle.filter(~F.col("held")).select("s", (~F.col("united")).alias("every")), "doubtful")
    out = saved(several.select("s", "k", "n", "at").join(shingle, "s"), "in-doubt")
    discard(at, shingle)
    return out


def _wide(nodes: DataFrame) -> DataFrame:
    """(k, wide): the bitmap of each set, folded to WIDE longs at most."""

    def folded(bits: pd.Series) -> pd.Series:
        def one(x):
            x = np.asarray(x, np.int64)
            while len(x) > WIDE:
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            return x

        return bits.map(one)

    return nodes.select("k", F.pandas_udf(folded, "array<long>")("bits").alias("wide"))


def _close(nodes: DataFrame, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(u, v), u < v: sets whose fingerprints are one, each with the first of them, or linked, each fingerprint by its first."""
    first = saved(nodes.groupBy("fp").agg(F.min("k").alias("first")), "fingerprints")
    equal = nodes.select("k", "fp").join(first, "fp").select(F.col("first").alias("u"), F.col("k").alias("v"))
    pairs = linked(first.select("fp"))
    pairs = pairs.join(first.select(F.col("fp").alias("a"), F.col("first").alias("u")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("v")), "b")
    out = equal.union(pairs.select("u", "v")).filter("u != v")
    out = saved(out.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")), "near-fingerprints")
    discard(first)
    return out


def links(docs: DataFrame, linked: Callable[[DataFrame], DataFrame], block: int = BLOCK) -> DataFrame:
    """(u, v): links between ids, with the components of all pairs of a likeness of 4/5.

    linked gives links (a, b) between near fingerprints of a table (fp).
    """
    small_batches(docs.sparkSession)
    rows = _texts(docs)
    # Equal sets are one: the key's smallest document stands for it.
    sets = saved(prefixes(rows, _hot(rows)), "prefixes")
    unique = saved(sets.groupBy("k").agg(F.min("doc").alias("doc"), *(F.first(c).alias(c) for c in ("n", "fp", "bits", "prefix"))), "unique")
    nodes = unique.select("k", "doc", "n", "fp", "bits")
    equal = saved(sets.select("k", F.col("doc").alias("v")).join(nodes.select("k", "doc"), "k").filter("doc < v").select(F.col("doc").alias("u"), "v").distinct(), "equal")
    discard(sets)
    # Near fingerprints first: what they link and whole sets confirm is united, and not compared again.
    close = _close(nodes, linked)
    small_batches(docs.sparkSession)
    found = _alike(rows, nodes, close)
    discard(close)
    shared = saved(unique.select(F.explode("prefix").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("s"), "shared")
    met = unique.select("k", "n", "prefix", *_few()).select("k", "n", *FOLDED, F.posexplode("prefix").alias("at", "s"))
    met = saved(met.join(shared, "s").withColumn("every", F.lit(False)), "met")
    discard(shared)
    # What has different labels still is held against each other in blocks, as far as a forest needs.
    several = _several(met, found)
    tree = _blocked(several, block, _Folded)
    alike = _alike(rows, nodes, tree)
    found, failed = found.union(alike), saved(tree.join(alike, ["u", "v"], "left_anti"), "failed")
    # If all links of the forests hold, they have every component.  If not, what is in doubt comes with wide bitmaps.
    while not failed.isEmpty():
        doubt = _in_doubt(several, alike, failed)
        if doubt.isEmpty():
            discard(doubt)
            break
        discard(tree, several, failed)
        several = _several(doubt, found)
        discard(doubt)
        tree = _blocked(several, block, _Wide, _wide(nodes))
        alike = _alike(rows, nodes, tree)
        found, failed = found.union(alike), saved(tree.join(alike, ["u", "v"], "left_anti"), "failed")
    discard(tree, several, failed, met)
    found = found.join(nodes.select(F.col("k").alias("u"), F.col("doc").alias("a")), "u").join(nodes.select(F.col("k").alias("v"), F.col("doc").alias("b")), "v")
    return equal.union(found.select("a", "b"))


def later_copies(docs: DataFrame, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The ids (null as known_id has it) that are not the smallest of their component."""
    return components(links(docs, linked)).filter("label < node").select("node")
