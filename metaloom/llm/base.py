"""What the operators share: the shared folder, tables in it, batches and hashes."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch.  Long texts make a batch large, so batches hold few rows.
BATCH_ROWS = 512
#: Stands for a null id in joins and orders; it sorts before every other id.
NULL_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Only in local mode, where all run on one
    machine, a new folder takes its place if it is unset; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "").startswith("local") or "cluster" in spark.conf.get("spark.master"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="metaloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def folder(uri: str):
    """A file system that reaches the shared folder from any task or the driver, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


#: Makes Spark delete a query's shuffle files when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Sizes up to which Spark sends a side of a join to all tasks, through the driver: guessed and measured ones.
_GUESSED, _MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
#: Most bytes by a guess.  Spark takes the rows of an explode or of Python for as many as those they are made of, and files
#: for what they hold, so a side may be a hundred times as large; a measured one is what it is.
GUESSED_BYTES = 256 << 10


@contextmanager
def _set(spark: SparkSession, values: dict[str, str]):
    """Settings for a job; then those of before hold again."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _thresholds(spark: SparkSession) -> dict[str, str]:
    """The session's thresholds, but a guess counts up to GUESSED_BYTES only."""
    guessed = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return {_GUESSED: str(min(guessed, GUESSED_BYTES)), _MEASURED: spark.conf.get(_MEASURED, None) or str(guessed)}


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again.

    This cuts the lineage: later stages, also after a lost executor, read the table and compute nothing twice.  So the
    shuffle files of the job that wrote it are deleted with its end.  The job sends sides of joins to all tasks by what
    they measure, not by guesses, which may be far too low for the driver.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    with _set(spark, {_CLEANUP: "true"} | _thresholds(spark)):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._metaloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes saved tables that nothing reads any more."""
    for df in tables:
        files, path = folder(df._metaloom_path)
        files.delete_dir(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each Spark context, so that tasks can import it anywhere."""
    sc = spark.sparkContext
    if getattr(sc, "_metaloom_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    if root.is_dir():
        out = Path(tempfile.mkdtemp(prefix="metaloom-")) / "metaloom.zip"
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(out))
    sc._metaloom_shipped = True


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Before Python runs on the executors: the package is there, and batches hold few rows."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def known_id(name: str = "doc_id") -> Column:
    """The id, with a value in place of null."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def real_id(name: str) -> Column:
    """The id again, null where it was null."""
    return F.when(F.col(name) != F.lit(NULL_ID), F.col(name))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Each name, with underscores before it until df has no such column; Spark compares names without case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
        taken.add(name.lower())
    return out


def utf8(text) -> bytes:
    return text.encode("utf-8", "replace") if isinstance(text, str) else b""


#: Odd multipliers of the polynomial and mixing hashes (fixed values).
MIX_A = np.uint64(0x9E3779B97F4A7C15)
MIX_B = np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values, so that all bits depend on all bits."""
    x = (x ^ (x >> np.uint64(31))) * MIX_A
    x = (x ^ (x >> np.uint64(29))) * MIX_B
    return x ^ (x >> np.uint64(32))


def rows_of(batches: Iterable) -> Iterator:
    for pdf in batches:
        yield from pdf.itertuples(index=False)
