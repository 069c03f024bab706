"""Line dedup: repeated lines leave all documents but the last that holds them.

Only DataFrame functions run here.  The occurrences of long lines, as (hash, document, position), are dealt by
range of (hash, document), and sorted within the ranges by hash, document and position.  The sorted ranges are streamed
once, with no further exchange: a window over each run of (hash, document) marks its first occurrence, and the ranges
are written with these marks.  Counts and largest documents of each hash are partial within the ranges, and only the
partial results of a hash meet.  The range has the document in it, so a line that a third of all documents hold spreads
over many ranges.  Texts do not move for this: the outcome is a keep bitmap for each document, of 63-bit words; words
that keep every line are left out.

Results for odd input.  A null or empty text is one empty line.  Rows with one doc_id are
one document when documents are counted, and all rows with the largest doc_id that holds a line keep it.  A null doc_id sorts before all
others.  A line that repeats within a document counts once, and all its lines go or stay together.  Other columns stay as they are,
whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metaloom.llm.base import known_id, partitions, saved, unused

#: White space that is stripped from both ends of a line (fixed values).
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = 63


def line_key(line: Column) -> Column:
    """The line stripped, A to Z in lower case.  lower() is the same for plain ASCII and several times faster."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(known_id().alias("doc"), text.alias("text")).withColumn("row", F.xxhash64("doc", "text"))


def _lines(text: str = "text") -> Column:
    return F.split(F.col(text), "\n", -1)


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc, row, drops): for each document that loses lines, struct(word, keep) for each 63 lines of which some go.

    Bit i of keep is 1 if line 63 * word + i stays.  row tells rows with one doc_id apart.
    """
    spark = docs.sparkSession
    lines = _rows(docs).select("doc", "row", F.posexplode(_lines()).alias("pos", "line"))
    lines = lines.filter(F.octet_length("line") >= min_chars).withColumn("line", line_key(F.col("line")))
    # Written before ranges are cut, so that sampling the ranges reads hashes and no text is split twice.
    seen = saved(lines.filter(F.char_length("line") >= min_chars).select(F.unhex(F.md5("line")).alias("hash"), "doc", "row", "pos"), "lines")
    ranged = seen.repartitionByRange(partitions(spark), "hash", "doc").sortWithinPartitions("hash", "doc", "pos")
    once = F.row_number().over(Window.partitionBy("hash", "doc").orderBy("pos")) == 1
    seen = saved(ranged.withColumn("once", once), "ranges")
    common = seen.filter("once").groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("last")).filter(F.col("n") >= min_docs)
    # As a table of its own, the join has two exchanges, and Spark can split the lines that very many documents hold.
    common = saved(common, "common")
    gone = seen.join(common.select("hash", "last"), "hash").filter(F.col("doc") < F.col("last"))
    word = (F.col("pos") / WORD).cast("int")
    bit = F.expr(f"shiftleft(1L, pos % {WORD})")
    words = gone.groupBy("doc", "row", word.alias("word")).agg(F.bit_or(bit).alias("gone"))
    full = F.lit((1 << WORD) - 1)
    words = words.select("doc", "row", F.struct("word", full.bitwiseXOR(F.col("gone")).alias("keep")).alias("x"))
    return words.groupBy("doc", "row").agg(F.map_from_entries(F.collect_list("x")).alias("bitmap"))


def _with_kept(docs: DataFrame, min_chars: int, min_docs: int) -> tuple[DataFrame, Column, Column, Column]:
    """docs with columns of its own names, and the text that stays, n_lines and n_dropped as expressions of them."""
    bitmaps = keep_bitmaps(docs, min_chars, min_docs)
    doc, text, row, bitmap = unused(docs, "doc", "whole", "row", "bitmap")
    keyed = docs.withColumn(doc, known_id()).withColumn(text, F.coalesce(F.col("text").cast("string"), F.lit("")))
    keyed = keyed.withColumn(row, F.xxhash64(doc, text))
    both = keyed.join(bitmaps.select(F.col("doc").alias(doc), F.col("row").alias(row), F.col("bitmap").alias(bitmap)), [doc, row], "left")
    full = F.lit((1 << WORD) - 1)
    bits = lambda i: F.coalesce(F.try_element_at(bitmap, (i / WORD).cast("int")), full)
    kept = F.filter(_lines(text), lambda _, i: bits(i).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i % WORD)) != 0)
    dropped = F.aggregate(F.map_values(bitmap), F.lit(0).cast("long"), lambda n, keep: n + WORD - F.bit_count(keep))
    return (
        both,
        F.when(F.col(bitmap).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")),
        (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long"),
        F.coalesce(dropped, F.lit(0)).cast("long"),
    )


def deduplicated(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs, all columns as they are, but for text: the lines that stay."""
    both, text, _, _ = _with_kept(docs, min_chars, min_docs)
    return both.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns])


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The digest of each document: doc_id, n_lines, n_dropped, kept_sha256."""
    both, text, n_lines, n_dropped = _with_kept(docs.select("doc_id", "text"), min_chars, min_docs)
    return both.select(F.col("doc_id").cast("long").alias("doc_id"), n_lines.alias("n_lines"), n_dropped.alias("n_dropped"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))
