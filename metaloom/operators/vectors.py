"""A stored inverted-file index of vectors: cells around centroids, searched by their nearest cells, beside the exact scan.

Centroids are fitted on a bounded sample of vectors (``Fit``), which is the only thing that comes to the driver; every
vector is stored, in the directory of its nearest centroid's cell.  A search compares each query with the centroids,
and then with the vectors of its ``probe`` nearest cells only; how many those are is fitted too, so that ten nearest
vectors of the sample are found with the recall asked for, and is stored.  ``upserted`` rewrites the cells that gain, lose or
replace a vector and no other file.

Results for odd input.  Vectors that are null or empty or hold nulls or no numbers have no cell and are not stored, and
such queries find nothing; a vector of zeros has a cell and the cosine null, which is no hit.  Vectors must have the
length of the centroids, others are an error.  Of rows with one id all stay at ``build``, as in the scan; an upsert replaces all of an id, and of several
new rows with it all are stored.  Id 0 is reserved and upserts leave it as it is.  An empty table gives one cell, without
vectors.  Other columns are left out.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.functions.tables import materialized, shared_dir
from metaloom.operators.registry import query
from metaloom.operators.search import dense_top, first_k

SCHEMA = "page long, vec array<double>, cell int"


@dataclass(frozen=True)
class Fit:
    """Bounds of the sample that centroids are fitted on, and how: the vectors with the smallest hashes of their ids."""

    cells: int = 64
    sample: int = 20_000
    rounds: int = 12
    seed: int = 7
    recall: float = 0.95  # within the sample; it is lower by some hundredths where vectors are many more
    trials: int = 200  # sampled vectors that take part as queries


def _clean(rows: DataFrame, key: str = "page", vec: str = "vec") -> DataFrame:
    v = F.col(vec).cast("array<double>")
    plain = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col(key).cast("long").alias(key), v.alias(vec)).filter((F.size(v) > 0) & plain)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def centroids(vectors: DataFrame, fit: Fit) -> tuple[np.ndarray, int]:
    """Unit centroids of spherical k-means over the sample, as many as there are different sampled vectors, if fewer; and
    how many cells a search takes for the recall asked for."""
    rows = _clean(vectors).orderBy(F.xxhash64("page"), "page").limit(fit.sample).select("vec").collect()
    if not rows:
        return np.zeros((1, 0)), 1
    x = _unit(np.array([r[0] for r in rows]))
    pool = np.unique(x, axis=0)
    c = pool[np.random.default_rng(fit.seed).permutation(len(pool))[: fit.cells]]
    for _ in range(fit.rounds):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), c)
    q = x[: fit.trials]
    likeness = q @ x.T
    likeness[np.arange(len(q)), np.arange(len(q))] = -2  # a query is no neighbour of its own
    best = np.argsort(-likeness, axis=1, kind="stable")[:, : min(10, len(x) - 1)]
    if not best.size:
        return c, 1
    place = np.argsort(np.argsort(-(q @ c.T), axis=1, kind="stable"), axis=1)  # of each cell among a query's nearest
    needed = np.take_along_axis(place, (x @ c.T).argmax(1)[best], 1).ravel()
    return c, 1 + int(np.quantile(needed, fit.recall, method="higher"))


def _with_cells(df: DataFrame, vec: str, c: np.ndarray, n: int, out: str) -> DataFrame:
    """Rows with their n nearest centroids, as an array column."""
    names = df.columns

    def run(batches):
        for pdf in batches:
            if c.shape[1] and len(pdf):
                score = _unit(np.array(pdf[vec].tolist(), dtype=float)) @ c.T
                near = np.argsort(-score, axis=1, kind="stable")[:, :n]
            else:
                near = np.zeros((len(pdf), 1), int)
            yield pdf[names].assign(**{out: pd.Series([list(map(int, r)) for r in near], index=pdf.index, dtype=object)})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{fields}, `{out}` array<int>")


def _write(rows: DataFrame, at: str, mode: str):
    writer = rows.hint("rebalance", F.col("cell")).write.partitionBy("cell").mode(mode)
    writer.option("partitionOverwriteMode", "dynamic").parquet(f"{at}/cells")


def _celled(vectors: DataFrame, c: np.ndarray) -> DataFrame:
    return _with_cells(_clean(vectors), "vec", c, 1, "near").select("page", "vec", F.element_at("near", 1).alias("cell"))


def build(vectors: DataFrame, at: str, fit: Fit = Fit()) -> None:
    """Writes the cells of vectors (page, vec) under a folder, and its centroids last: without them there is no index."""
    c, probe = centroids(vectors, fit)
    _write(_celled(vectors, c), at, "errorifexists")
    rows = [(k, [float(v) for v in row], probe) for k, row in enumerate(c)]
    vectors.sparkSession.createDataFrame(rows, "cell int, centroid array<double>, probe int").coalesce(1).write.parquet(f"{at}/centroids")


def stored_fit(spark: SparkSession, at: str) -> tuple[np.ndarray, int]:
    """Centroids, as many as the fit has cells, and the number of cells of a search."""
    rows = spark.read.parquet(f"{at}/centroids").orderBy("cell").collect()
    return np.array([r["centroid"] for r in rows], dtype=float).reshape(len(rows), -1), rows[0]["probe"]


def stored(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(f"{at}/cells")


def nearest(spark: SparkSession, at: str, queries: DataFrame, k: int = 10, probe: int | None = None) -> DataFrame:
    """(query, page, score, rank): of each query (query, qvec) the first k vectors of its nearest cells, by exact cosine.

    Only the cells that some query asks for are read.  Their rows are dealt out to all tasks, so a large cell is no single
    task's; a query meets the rows of its own cells only.
    """
    c, fitted = stored_fit(spark, at)
    asked = _with_cells(_clean(queries, "query", "qvec"), "qvec", c, probe or fitted, "near").select("query", "qvec", "near")
    asked = materialized(asked, "asked")
    cells = [r[0] for r in asked.select(F.explode("near")).distinct().collect()]  # at most as many as there are centroids
    scored = dense_top(stored(spark, at).filter(F.col("cell").isin(cells)), asked, k).filter("score IS NOT NULL")
    return first_k(scored, k, ["query"], F.desc("score"), "page")


def upserted(spark: SparkSession, at: str, new: DataFrame) -> list[int]:
    """Stores new vectors (page, vec) in the place of those with their ids; returns the cells that were rewritten.

    The cells' new rows are written to the shared folder first, so a failure up to there changes nothing.  Each cell's
    directory is then replaced in the commit of Spark's dynamic overwrite.  That commit is not atomic: if the driver
    dies within it, the index must be built again.  An upsert that is run twice gives the same rows as once.
    """
    fresh = materialized(_celled(new.filter("page <> 0"), stored_fit(spark, at)[0]), "fresh")
    ids, table = fresh.select("page").distinct(), stored(spark, at)
    lose = table.select("page", "cell").join(ids, "page", "left_semi").select("cell")
    cells = sorted(r[0] for r in lose.union(fresh.select("cell")).distinct().collect())
    kept = table.filter(F.col("cell").isin(cells)).join(ids, "page", "left_anti").select("page", "vec", "cell")
    rows = materialized(kept.union(fresh.select("page", "vec", "cell")), "cells")
    _write(rows, at, "overwrite")
    emptied = sorted(set(cells) - {r[0] for r in rows.select("cell").distinct().collect()})
    for k in emptied:  # a dynamic overwrite leaves directories that get no row
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/cells/cell={k}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return cells


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query, wanted, got): how many of the exact rows (query, page) of each query were found."""
    both = exact.select("query", "page").join(found.select("query", "page", F.lit(1).alias("hit")), ["query", "page"], "left")
    return both.groupBy("query").agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("got"))


def _vectors(d) -> DataFrame:
    return d.embeddings.select(F.col("vec_id").alias("page"), F.col("embedding").alias("vec"))


def _asked(v: DataFrame) -> DataFrame:
    return v.filter("page % 100 = 0").select(F.col("page").alias("query"), F.col("vec").alias("qvec"))


def _new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"


@query("H02_cells")
def _(d):
    v = _vectors(d)
    at = _new_folder(v.sparkSession)
    build(v, at)
    return nearest(v.sparkSession, at, _asked(v))


@query("K07_cells", """SELECT vec_id AS page, CASE WHEN vec_id % 7 = 3 AND vec_id <> 0 THEN list_reverse(CAST(embedding AS DOUBLE[])) ELSE CAST(embedding AS DOUBLE[]) END AS vec FROM embeddings
UNION ALL SELECT -vec_id, CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id % 7 = 5""")
def _(d):
    """All stored vectors after an upsert that replaces some and adds others."""
    v = _vectors(d)
    spark, at = v.sparkSession, _new_folder(v.sparkSession)
    build(v, at)
    added = v.filter("page % 7 = 5").select((-F.col("page")).alias("page"), "vec")
    upserted(spark, at, v.filter("page % 7 = 3").select("page", F.reverse("vec").alias("vec")).union(added))
    return stored(spark, at).select("page", "vec")
