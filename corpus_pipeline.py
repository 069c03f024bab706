"""A corpus pipeline: toxic documents, repeated lines, near duplicates and leaked benchmark items go; the rest is encoded.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its output is written as
Parquet and read again.  All stages but the last return the columns of documents; n_chars follows the text.

Results for odd input.  A null or empty text is no toxic text, one empty line, a near duplicate of all such texts (of
which the smallest id stays, null before all others), holds no benchmark item and has no tokens.  Rows that repeat an
id and a text become one at the near-duplicate stage.  Further columns, whatever their names, are carried along and
leave with the last stage.  Empty documents give an empty result; without labels the grammar's priors score, and
without benchmark items nothing leaks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.llm import bpe, decontam, linededup, simhash, toxicity
from metaloom.llm.base import saved


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar scores below 0.7 stay."""
    return toxicity.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least five documents hold stay in the last of them only."""
    out = linededup.deduplicated(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, Jaccard >= 0.8) the document with the smallest id stays."""
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item stay."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, encoded and decoded."""
    return bpe.encoded(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("near duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("bpe", as_tokens),
]

#: SQL cannot express the toxicity grammar's training; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs, name.replace(" ", "-"))
    return docs
