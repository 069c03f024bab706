"""Fill-in-middle transformation: a text is cut in three at ranked units, and its middle moves to the end.

The units of a text are found by bit-parallelism over big integers.  ``bytes.translate`` turns the UTF-8 bytes into a
class mask, one bit a byte with the first byte lowest; shifted boolean operations on the masks mark the bytes at which
a unit begins; ``bit_count`` gives the number of units; and the byte of a ranked unit is selected by halving the mask,
counting its lower half and going on in the half that holds the rank.  No unit is ever an object of its own, so a text
costs a bit a byte and a few passes at the speed of memory.

Units are code points (``chars``), words with the white space after them (``words``) or lines with their end
(``lines``); white space before the first word belongs to it.

Results for odd input.  A null or empty text has no unit and stays plain.  A null doc_id is hashed as ``null``.
Repeated rows and ids are rows of their own, equal in their results.  Other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.llm.base import small_batches

#: The marks of prefix, suffix and middle in an output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts so many are transformed, and of a hundred of those so many put the suffix first.
RATE, SUFFIX_FIRST = 90, 20
#: Bytes of output in one batch.
BATCH_BYTES = 1 << 25
SPACE = b" \t\n\v\f\r"


@functools.cache
def _table(members: bytes) -> bytes:
    """For bytes.translate: the digit 1 for members of a class, 0 for all other bytes."""
    return bytes(49 if b in members else 48 for b in range(256))


def class_mask(data: bytes, members: bytes) -> int:
    """An integer whose bit i says whether byte i is in a class."""
    return int(data.translate(_table(members))[::-1] or b"0", 2)


def starts(data: bytes, unit: str = "chars") -> int:
    """An integer whose set bits are the bytes at which a unit begins."""
    if not data:
        return 0
    every = (1 << len(data)) - 1
    if unit == "chars":
        wide, wider, widest = (class_mask(data, bytes(range(b, 256))) for b in (0xC0, 0xE0, 0xF0))
        return every & ~(wide << 1 | wider << 2 | widest << 3)
    if unit == "words":
        inside = every & ~class_mask(data, SPACE)
        found = inside & ~(inside << 1)
        return found ^ (found & -found) | 1
    if unit == "lines":
        return every & (class_mask(data, b"\n") << 1) | 1
    raise ValueError(f"no such unit: {unit}")


def selected(bits: int, size: int, rank: int) -> int:
    """The place of the set bit with a rank, from 0; size if there is none."""
    if rank >= bits.bit_count():
        return size
    at = 0
    while size > 1:
        half = size >> 1
        low = bits & ((1 << half) - 1)
        if rank < (n := low.bit_count()):
            bits, size = low, half
        else:
            bits, size, rank, at = bits >> half, size - half, rank - n, at + half
    return at


def cut(data: bytes, h: tuple[int, int, int, int], unit: str = "chars", rate: int = RATE, suffix_first: int = SUFFIX_FIRST):
    """(units, form, units of the prefix, units of the middle, output) of one text by its four hashes."""
    bits = starts(data, unit)
    n = bits.bit_count()
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if not n or h[2] % 100 >= rate or p in data or s in data or m in data:
        return n, "plain", None, None, data
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    i, j = selected(bits, len(data), a), selected(bits, len(data), b)
    before, middle, after = data[:i], data[i:j], data[j:]
    if h[3] % 100 < suffix_first:
        return n, "spm", a, b - a, b"".join((s, after, p, before, m, middle))
    return n, "psm", a, b - a, b"".join((p, before, s, after, m, middle))


def transformed(docs: DataFrame, seed: int = 1, unit: str = "chars", rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, n, form, prefix_units, middle_units, output) of each document.

    The hashes that place the cuts are groups of eight digits of the SHA-256 of ``seed:doc_id``, so a document is cut
    alike in every run and wherever its task runs.
    """
    small_batches(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    groups = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(4)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"), *groups)
    kinds = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_units", pa.int64()), ("middle_units", pa.int64()), ("output", pa.binary())]

    def run(batches):
        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, (_, kind) in enumerate(kinds)], names=[k for k, _ in kinds])

        for got in batches:
            out, size = [], 0
            ids, texts, *h = (got.column(k) for k in range(6))
            for k in range(got.num_rows):
                out.append((ids[k].as_py(), *cut(texts[k].as_py(), tuple(x[k].as_py() for x in h), unit, rate, suffix_first)))
                size += len(out[-1][-1])
                if size > BATCH_BYTES:
                    yield batch(out)
                    out, size = [], 0
            if out:
                yield batch(out)

    got = rows.mapInArrow(run, "doc_id long, n long, form string, prefix_units long, middle_units long, output binary")
    return got.withColumn("output", F.col("output").cast("string"))


def restored(output="output", form="form"):
    """The text before the transformation, from an output and its form: the parts between the marks in their old order.
    No mark stands in a transformed text, and none can arise where a part meets a mark."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)))
    return F.when(F.col(form) == "psm", F.concat(parts[1], parts[3], parts[2])).when(F.col(form) == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(F.col(output))
