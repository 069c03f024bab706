"""Benchmark decontamination: size-partitioned MinHash containment search.

An item is the set of its shingles of five words, a document likewise.  Items are partitioned by the size of their
sets, from 2^(k-1) to 2^k - 1.  The partition sets two parameters.  Its sketches are the s smallest shingle hashes of
each item (bottom-s MinHash), s = n - ceil(t * n) + 1 for the partition's largest size n and the threshold t: a
document with a share t of an item's shingles lacks at most n - ceil(t * n) of them, so it holds a member of the
sketch, however long it is.  And only documents with at least ceil(t * m) shingles, for the partition's smallest size
m, are searched for its items.  An item is a candidate if a document holds so many members of its sketch as it must:
all that it may not lack.  Each candidate is verified by the exact containment of its shingles, as words and not as
hashes.

The sketches and items are sent to all tasks only while their size is checked to be small; larger benchmarks are
joined by shuffle, with the same results.  There a sketch hash that very many documents hold has its documents in
several salted parts, each of which meets the items with the hash; sketch members are counted for each pair before any
text moves, and only texts of candidates do.

Results for odd input.  Words are runs of letters, digits and underscores in lower case.  A text of fewer than five
words has its whole sequence as its only shingle; one without words has none and is in no pair.  Repeated rows give
equal rows once: a pair (doc_id, item_id) is returned once, with the highest containment of its rows.  A null doc_id or
item_id stays null.  Other columns are ignored.  Empty tables give an empty result.
"""

from __future__ import annotations

import functools
from collections import defaultdict

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.llm.base import known_id, mixed, real_id, saved, small_batches, unused

WORDS, THRESHOLD = 5, 0.8
#: Characters of benchmark text up to which every task gets all of it.
MOST_SENT = 16 << 20
#: Documents of one sketch hash that meet items in one part.
HOT = 10_000
_FIND = regex.compile(r"[\p{L}\p{N}_]+").findall
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(WORDS)]


@functools.lru_cache(maxsize=1 << 18)
def _word(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))


def words_of(text) -> list[str]:
    return _FIND(text.lower()) if isinstance(text, str) else []


def hashes_of(words: list[str]) -> np.ndarray:
    """A hash for each shingle, in text order."""
    n = min(WORDS, len(words))
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_word, words), np.uint64, len(words))
    m = len(words) - n + 1
    return mixed(sum((h[k : k + m] * _POWERS[k] for k in range(n)), np.zeros(m, np.uint64)) ^ np.uint64(n))


def shingles_of(words: list[str]) -> set[tuple[str, ...]]:
    n = min(WORDS, len(words))
    return set(zip(*[words[k:] for k in range(n)], strict=False)) if n else set()


def lacking(n: int, threshold: float) -> int:
    """How many of n shingles a document may lack."""
    return n - int(np.ceil(threshold * n - 1e-9))


def partition_of(n: int) -> int:
    return n.bit_length()


def least_size(part: int, threshold: float) -> int:
    """The shingles that a document needs to hold an item of the partition."""
    m = 1 << part - 1
    return m - lacking(m, threshold)


def sketch_of(words: list[str], threshold: float) -> tuple[int, np.ndarray, int]:
    """The partition of an item, its sketch, and how many of the sketch a document must hold."""
    h = np.unique(hashes_of(words))
    part = partition_of(len(h))
    sketch = h[: lacking((1 << part) - 1, threshold) + 1]
    return part, sketch, len(sketch) - lacking(len(h), threshold)


def _sketches(items: pd.DataFrame, threshold: float):
    """By partition the shingles that a document needs, the sorted hashes and their items; how many of each item's
    sketch a document must hold; and the items' shingles."""
    parts, shingles, needed = defaultdict(list), [], []
    for k, text in enumerate(items["text"]):
        words = words_of(text)
        shingles.append(shingles_of(words))
        needed.append(1)
        if words:
            part, sketch, needed[-1] = sketch_of(words, threshold)
            parts[part] += [(int(h), k) for h in sketch]
    tables = [(least_size(part, threshold), np.array([h for h, _ in sorted(p)], np.uint64), np.array([k for _, k in sorted(p)])) for part, p in sorted(parts.items())]
    return tables, np.array(needed, np.int64), shingles


def _verified(text_words: list[str], candidates: set[int], shingles: list[set], threshold: float):
    have = shingles_of(text_words)
    for k in sorted(candidates):
        share = len(shingles[k] & have) / len(shingles[k])
        if share >= threshold - 1e-9:
            yield k, share


def _sent(docs: DataFrame, items: pd.DataFrame, threshold: float) -> DataFrame:
    tables, needed, shingles = _sketches(items, threshold)
    ids = [int(x) for x in items["item"]]

    def run(batches):
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc"], pdf["text"], strict=True):
                words = words_of(text)
                h = np.unique(hashes_of(words))
                met: set[int] = set()
                for least, keys, owners in tables:
                    if len(h) < least:
                        break  # the partitions are in the order of sizes
                    at = np.searchsorted(h, keys)
                    hit = at < len(h)
                    hit[hit] = h[at[hit]] == keys[hit]
                    if hit.any():
                        some, held = np.unique(owners[hit], return_counts=True)
                        met.update(some[held >= needed[some]].tolist())
                rows += [(doc, ids[k], len(shingles[k]), share) for k, share in _verified(words, met, shingles, threshold)] if met else []
            yield pd.DataFrame(rows, columns=["doc", "item", "n_shingles", "containment"])

    return docs.mapInPandas(run, "doc long, item long, n_shingles long, containment double")


def _shuffled(docs: DataFrame, items: DataFrame, threshold: float, hot: int = HOT) -> DataFrame:
    """The same by joins on the sketch hash, for benchmarks of any size."""

    def sketched(batches):
        for pdf in batches:
            for item, row, text in zip(pdf["item"], pdf["item_row"], pdf["text"], strict=True):
                if words := words_of(text):
                    part, h, needed = sketch_of(words, threshold)
                    yield pd.DataFrame({"item": item, "item_row": row, "least": least_size(part, threshold), "needed": needed, "hash": h.view(np.int64)})

    def hashed(batches):
        for pdf in batches:
            for doc, row, text in zip(pdf["doc"], pdf["doc_row"], pdf["text"], strict=True):
                h = np.unique(hashes_of(words_of(text)))
                if len(h):
                    yield pd.DataFrame({"doc": doc, "doc_row": row, "size": len(h), "hash": h.view(np.int64)})

    items = items.withColumn("item_row", F.xxhash64("text"))
    docs = docs.withColumn("doc_row", F.xxhash64("text"))
    sketches = saved(items.mapInPandas(sketched, "item long, item_row long, least long, needed long, hash long"), "sketches")
    asked = sketches.select("hash").distinct()
    held = docs.mapInPandas(hashed, "doc long, doc_row long, size long, hash long")
    held = saved(held.join(asked, "hash", "left_semi"), "held")
    # The documents of a hash in parts of about so many; items meet each part.
    parts = held.groupBy("hash").agg(F.ceil(F.count(F.lit(1)) / hot).cast("int").alias("parts"))
    sketches = sketches.join(saved(parts, "parts"), "hash").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    salted = held.join(saved(parts.filter("parts > 1"), "hot-parts"), "hash", "left")
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("doc", "doc_row"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    met = salted.join(sketches.drop("parts"), ["hash", "salt"]).filter(F.col("size") >= F.col("least"))
    met = met.groupBy("doc", "doc_row", "item", "item_row").agg(F.count(F.lit(1)).alias("n"), F.max("needed").alias("needed"))
    met = saved(met.filter(F.col("n") >= F.col("needed")).select("doc", "doc_row", "item", "item_row"), "met")

    def check(batches):
        for pdf in batches:
            rows = []
            for doc, item, a, b in zip(pdf["doc"], pdf["item"], pdf["doc_text"], pdf["item_text"], strict=True):
                rows += [(doc, item, len(s[0]), share) for s in [[shingles_of(words_of(b))]] for _, share in _verified(words_of(a), {0}, s, threshold)]
            yield pd.DataFrame(rows, columns=["doc", "item", "n_shingles", "containment"])

    both = met.join(items.withColumnRenamed("text", "item_text"), ["item", "item_row"]).join(docs.withColumnRenamed("text", "doc_text"), ["doc", "doc_row"])
    return both.select("doc", "item", "doc_text", "item_text").mapInPandas(check, "doc long, item long, n_shingles long, containment double")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, most_sent: int = MOST_SENT) -> DataFrame:
    """(doc_id, item_id, n_shingles, containment): items of which a document holds a share of at least threshold."""
    small_batches(docs.sparkSession)
    items = benchmark.select(known_id("item_id").alias("item"), F.col("text").cast("string").alias("text")).distinct()
    texts = docs.select(known_id("doc_id").alias("doc"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    found = _sent(texts, items.toPandas(), threshold) if size <= most_sent else _shuffled(texts, items, threshold)
    # Of an item's and a document's repeated rows the best pair, as one.
    found = found.groupBy("doc", "item").agg(F.max(F.struct("containment", "n_shingles")).alias("best")).select("doc", "item", "best.*")
    return found.select(real_id("doc").alias("doc_id"), real_id("item").alias("item_id"), "n_shingles", "containment")


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that hold no item."""
    (bad,) = unused(docs, "bad")
    found = contaminated(docs, benchmark, threshold).select(known_id().alias(bad)).distinct()
    return docs.withColumn(bad, known_id()).join(found, bad, "left_anti").select(docs.columns)
