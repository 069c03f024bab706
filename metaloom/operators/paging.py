"""Pages of ordered results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clamped(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))


def page_params(limit: int, offset: int) -> tuple[int, int]:
    """A limit of 0 or less is 20, over 100 is 100; an offset below 0 is 0."""
    return (20 if limit <= 0 else min(limit, 100)), max(0, offset)


def paged(df: DataFrame, *order: Column | str, limit: int, offset: int = 0) -> DataFrame:
    """The rows of one page, with total, has_more and next_offset.

    The total is its own aggregate and joins as one row; the page is a top-k, so nothing is sorted whole.
    """
    total = df.agg(F.count(F.lit(1)).alias("total"))
    page = df.orderBy(*order).offset(offset).limit(limit)
    end = offset + limit
    more = F.col("total") > end
    return page.crossJoin(F.broadcast(total)).withColumns({"has_more": more, "next_offset": F.when(more, F.lit(end))})


def summarized(df: DataFrame, *order: Column | str, preview: int = 5) -> DataFrame:
    """One row: how many rows there are, and the first few as an array of structs in order."""
    head = df.orderBy(*order).limit(preview)
    first = head.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias("preview"))
    return df.agg(F.count(F.lit(1)).alias("total")).crossJoin(first)


def truncated(text: Column, limit: int = 2000) -> Column:
    """The text, or its start and a note of how much is left out."""
    left = F.char_length(text) - limit
    return F.when(left > 0, F.concat(F.substring(text, 1, limit), F.lit("... ["), left.cast("string"), F.lit(" more]"))).otherwise(text)


def window_of(text: Column, offset: int, size: int) -> Column:
    """struct(part, total, has_more, next_offset) of one window of a long text."""
    n = F.char_length(text)
    more = n > offset + size
    return F.struct(F.substring(text, offset + 1, size).alias("part"), n.alias("total"), more.alias("has_more"), F.when(more, F.lit(offset + size)).alias("next_offset"))
