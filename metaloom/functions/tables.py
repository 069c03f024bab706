"""Tables in the folder that driver and executors share, which cut the lineage of iterative jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of a batch that goes to Python, and rows of one that comes back.
BATCH_ROWS, BATCH_BYTES, BATCH_OUT = 512, 4 << 20, 2048


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only in local mode a new folder takes its place if it is unset, on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "").startswith("local") or "cluster" in spark.conf.get("spark.master"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="metaloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialized(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again; a lost executor costs a read and no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def small_batches(df: DataFrame) -> DataFrame:
    """df, of which few rows and bytes go to Python at a time."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def yielded(df: DataFrame, rows_of: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """Rows that a function yields of each row's first column and the others.

    Few rows and bytes go to Python at a time and few rows come back, so its memory is that of the largest row, however many
    rows a task has or a row yields.
    """
    import pandas as pd

    df = small_batches(df)
    columns, most = [x.split()[0] for x in schema.split(", ")], BATCH_OUT

    def run(batches):
        for pdf in batches:
            out = []
            for key, *values in zip(*(pdf[c] for c in pdf.columns), strict=True):
                for row in rows_of(*values):
                    out.append((key, *row))
                    if len(out) == most:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
            yield pd.DataFrame(out, columns=columns)

    return df.mapInPandas(run, schema)
