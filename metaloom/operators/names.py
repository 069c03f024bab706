"""The closest of very many names to each of very many words, by a join on characters.

The likeness is 2 m / (a + b) with m the characters in matching blocks, of which there are no more than the two share.
A word's characters are tokens with their number of occurrence.  At a likeness of c, a word of length a shares at least
a c / (2 - c) of its tokens, so one of the rarest that are left over without so many is shared (prefix filtering); the
shared tokens bound the likeness of what meets, and the blocks decide.

Results for odd input.  A null or empty word has no close names; a null or empty name is close to none.  Case plays no
part; of names that differ in case only, the largest stands for them.  Among equal likeness the larger lower-case name
comes first.  Repeated words and names count once.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metaloom.functions.tables import materialized
from metaloom.operators.registry import query


def _tokens(low: Column) -> Column:
    chars = F.array_sort(F.filter(F.split(low, ""), lambda c: c != ""))
    return F.transform(chars, lambda c, i: F.concat(c, (i + 1 - F.array_position(chars, c)).cast("string")))


def closest_names(words: DataFrame, names: DataFrame, most: int = 2, cutoff: float = 0.7) -> DataFrame:
    """(word, near): for each different word of words (word), up to so many of names (name), the closest first."""
    words = words.select("word").distinct().withColumn("low", F.lower("word"))
    names = names.filter("name <> ''").groupBy(F.lower("name").alias("low")).agg(F.max("name").alias("name"))
    names = materialized(names.withColumn("tokens", _tokens(F.col("low"))), "names")
    asked = materialized(words.filter("low <> ''").select("low").distinct().withColumn("tokens", _tokens(F.col("low"))), "words")
    often = names.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    often = materialized(often, "tokens")

    def rarest(df, x):
        one = df.select("low", "tokens", F.explode("tokens").alias("t")).join(often, "t", "left")
        nth = F.row_number().over(Window.partitionBy("low").orderBy(F.coalesce("n", F.lit(0)), "t"))
        least = F.ceil(F.size("tokens") * (cutoff / (2 - cutoff)) - 1e-9)
        return one.withColumn("nth", nth).filter(F.col("nth") <= F.size("tokens") - least + 1).select("t", F.col("low").alias(x), F.col("tokens").alias(f"{x}_tokens"))

    a, b = F.size("w_tokens"), F.size("n_tokens")
    enough = 2.0 * F.size(F.array_intersect("w_tokens", "n_tokens")) / (a + b) >= cutoff
    met = rarest(asked, "w").join(rarest(names, "n"), "t").filter((2.0 * F.least(a, b) / (a + b) >= cutoff) & enough)

    def ratio(w: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, y, x).ratio() for x, y in zip(w, n, strict=True)], dtype="float64")

    found = met.select("w", "n").distinct().withColumn("likeness", F.pandas_udf(ratio, "double")("w", "n")).filter(F.col("likeness") >= cutoff)
    nth = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("likeness"), F.desc("n")))
    best = found.withColumn("nth", nth).filter(F.col("nth") <= most).join(names.select(F.col("low").alias("n"), "name"), "n")
    near = best.groupBy(F.col("w").alias("low")).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "name"))), lambda x: x["name"]).alias("near"))
    return words.join(near, "low", "left").select("word", F.coalesce("near", F.array().cast("array<string>")).alias("near"))


@query("X12_names")
def _(d):
    """For each part's type without its fourth letter, the closest of all types."""
    asked = F.concat(F.substring("p_type", 1, 3), F.substring("p_type", 5, 1000))
    return closest_names(d.part.select(asked.alias("word")), d.part.select(F.col("p_type").alias("name")))
