"""Document fingerprints: context-triggered piecewise hashing.

A rolling hash over seven bytes ends a chunk wherever it hits a value that one position in block_size hits; each chunk
gives one of 64 letters from its own hash.  A fingerprint is ``block:signature:signature at the doubled block``, so
that texts of somewhat different length share a block size.  The block size is the least of 3, 6, 12 ... with at most
about 64 chunks, and is halved while a signature has under 32 letters.  A signature has at most 64 letters (32 for the
second); the last chunk reaches to the end of the text, so all bytes count.  Likeness is one less the edit distance
(insertions and deletions) of two signatures at one block size, as a share of their letters, and 0 unless they share
a run of four letters.

All arithmetic over bytes is vectorised, a megabyte at a time.  A text's successor is found without a global order in
one task: ids are dealt to ranges, and the first row of each range goes to the range before it as well.

Results for odd input.  A null text is empty; empty texts have the fingerprint ``3::``, are fully like each other and
not at all like others.  Rows are in the order of doc_id, then text; repeated rows follow each other.  A null doc_id
sorts first and stays null.  Other columns are ignored.  In a table of one row, the row is its own next document.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.llm.base import known_id, mixed, partitions, real_id, small_batches

LEAST_BLOCK, LETTERS, WINDOW, RUN = 3, 64, 7, 4
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
SLICE = 1 << 20
_P = 0x100000001B3
_P_INVERSE = pow(_P, -1, 1 << 64)


@functools.lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _triggers(data: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ends of chunks at a block size, the running hash at each, and which also end a chunk at the doubled size."""
    ends, sums, twice = [], [], []
    run = 0
    for at in range(0, len(data), SLICE):
        part = data[at : at + SLICE]
        lead = min(WINDOW - 1, at)
        near = data[at - lead : at + len(part)].astype(np.uint32)
        h = near * np.uint32(1)
        for k in range(1, WINDOW):
            h[k:] += near[: max(0, len(near) - k)] * np.uint32(pow(0x85EBCA6B, k, 1 << 32))
        h = h[lead:]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        hit = np.flatnonzero(h % np.uint32(block) == block - 1)
        total = np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _powers(_P, SLICE)[: len(part)])
        scale = pow(_P, at, 1 << 64)
        ends.append(hit + at + 1)
        sums.append(total[hit] * np.uint64(scale) + np.uint64(run))
        twice.append(h[hit] % np.uint32(2 * block) == 2 * block - 1)
        run = (run + int(total[-1]) * scale) % (1 << 64)
    ends.append(np.array([len(data)]))
    sums.append(np.array([run], np.uint64))
    twice.append(np.array([True]))
    return np.concatenate(ends), np.concatenate(sums), np.concatenate(twice)


def _signature(ends: np.ndarray, sums: np.ndarray, most: int) -> str:
    if len(ends) > 1 and ends[-2] == ends[-1]:
        ends, sums = ends[:-1], sums[:-1]
    if len(ends) > most:
        ends, sums = np.append(ends[: most - 1], ends[-1]), np.append(sums[: most - 1], sums[-1])
    starts = np.concatenate([[0], ends[:-1]])
    chunk = np.diff(np.concatenate([np.zeros(1, np.uint64), sums]))
    back = np.array([pow(_P_INVERSE, int(s), 1 << 64) for s in starts], np.uint64) if starts[-1] >= SLICE else _powers(_P_INVERSE, SLICE)[starts]
    return ALPHABET[mixed(chunk * back) >> np.uint64(58)].tobytes().decode()


def fingerprint(text: str | bytes | None) -> str:
    raw = text.encode("utf-8", "replace") if isinstance(text, str) else text or b""
    if not raw:
        return f"{LEAST_BLOCK}::"
    data = np.frombuffer(raw, np.uint8)
    block = LEAST_BLOCK
    while block * LETTERS < len(data):
        block *= 2
    while True:
        ends, sums, twice = _triggers(data, block)
        if block == LEAST_BLOCK or len(ends) > LETTERS // 2:
            break
        block //= 2
    return f"{block}:{_signature(ends, sums, LETTERS)}:{_signature(ends[twice], sums[twice], LETTERS // 2)}"


def _plain(signature: str) -> str:
    """Runs of one letter cut to three: they say little about a text."""
    if not any(signature[i] == signature[i + 1] == signature[i + 2] for i in range(len(signature) - 2)):
        return signature
    out = signature[:3]
    for c in signature[3:]:
        if out[-3:] != c * 3:
            out += c
    return out


def common_letters(a: str, b: str) -> int:
    """The length of the longest common subsequence, 64 cells at a step."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for c in b:
        u = free & at.get(c, 0)
        free = ((free + u) | (free - u)) & full
    return len(a) - free.bit_count()


def _alike(a: str, b: str) -> float:
    a, b = _plain(a), _plain(b)
    run = min(RUN, len(a), len(b))
    if not run or {a[i : i + run] for i in range(len(a) - run + 1)}.isdisjoint([b[i : i + run] for i in range(len(b) - run + 1)]):
        return 0.0
    distance = len(a) + len(b) - 2 * common_letters(a, b)
    return 1 - distance / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """From 0 to 1; 1 for equal fingerprints, 0 for block sizes that have no signature in common."""
    if a == b:
        return 1.0
    (x, x1, x2), (y, y1, y2) = ((int(p[0]), p[1], p[2]) for p in (a.split(":"), b.split(":")))
    if x == y:
        return max(_alike(x1, y1), _alike(x2, y2))
    return _alike(x2, y1) if y == 2 * x else _alike(x1, y2) if x == 2 * y else 0.0


def with_next(docs: DataFrame, run, schema: str) -> DataFrame:
    """run over the rows (doc, text) in order, for each range an iterator of (row, next row); the last has the first.

    The cut points of the ranges come from the ids of all rows; there are as many as shuffle partitions.
    """
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    rows = docs.select(known_id().alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = np.unique(np.array(rows.select(F.col("doc").cast("double")).approxQuantile("doc", [k / n for k in range(1, n)], 0.2 / n) if n > 1 else [], float))
    cut_ids = np.array([int(c) for c in cuts], np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cut_ids, ids.to_numpy(np.int64), "right").astype(np.int32))

    firsts = sorted((r[0], r[1]) for r in rows.select("doc").groupBy(range_of("doc").alias("part")).agg(F.min("doc")).collect())
    before = {first: firsts[k - 1][0] for k, (_, first) in enumerate(firsts)}  # the first row of all follows the last

    @F.pandas_udf("array<int>")
    def sent_to(ids: pd.Series) -> pd.Series:
        own = np.searchsorted(cut_ids, ids.to_numpy(np.int64), "right")
        return pd.Series([[2 * int(k), 2 * before[i] + 1] if i in before else [2 * int(k)] for k, i in zip(own, ids, strict=True)])

    dealt = rows.select("doc", "text", F.explode(sent_to("doc")).alias("to"))
    dealt = dealt.select("doc", "text", (F.col("to") % 2).alias("ahead"), F.floor(F.col("to") / 2).cast("int").alias("part"))
    dealt = dealt.repartitionById(n, "part").sortWithinPartitions("ahead", "doc", "text")

    def pairs(batches):
        last = None
        for pdf in batches:
            for doc, text, ahead in zip(pdf["doc"], pdf["text"], pdf["ahead"], strict=True):
                if last is not None:
                    yield last, (doc, text)
                if ahead:
                    return
                last = (doc, text)

    def drained(batches):
        yield from run(pairs(batches))
        for _ in batches:  # further rows with the id of a range's first
            pass

    small_batches(spark)
    return dealt.select("doc", "text", "ahead").mapInPandas(drained, schema)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """The fingerprint of each text and of the text with its second half replaced by the start of the next document."""
    names = ["doc", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(pairs):
        out, known = [], None
        for (doc, text), follower in pairs:
            mine = known if known is not None else fingerprint(text)
            known = fingerprint(follower[1])
            half = len(text) // 2
            edited = (text[: len(text) - half] + follower[1][:half]).encode("utf-8", "replace")
            changed = fingerprint(edited)
            out.append((doc, len(text), hashlib.sha256(edited).hexdigest(), mine, changed, likeness(mine, changed), likeness(mine, known)))
            if len(out) == 4096:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    schema = "doc long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, run, schema).select(real_id("doc").alias("doc_id"), *names[1:])
