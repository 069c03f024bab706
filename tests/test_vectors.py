"""The cells of vectors: recall against the exact scan, upserts against a rebuild, and which files they touch."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from metaloom.operators import vectors
from metaloom.operators import search
from metaloom.operators.search import dense, first_k

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("page"), F.col("embedding").alias("vec"))


def test_recall_against_the_exact_scan(spark, rows, tmp_path):
    at = f"file://{tmp_path}/v"
    vectors.build(rows, at)
    assert vectors.stored(spark, at).count() == rows.count()
    asked = rows.filter("page % 10 = 0").select(F.col("page").alias("query"), F.col("vec").alias("qvec"))
    exact = first_k(dense(rows, asked), 10, ["query"], F.desc("score"), "page")
    got = vectors.recall(vectors.nearest(spark, at, asked), exact).agg(F.sum("got") / F.sum("wanted")).first()[0]
    assert got >= 0.9
    every = vectors.nearest(spark, at, asked, probe=1000)  # all cells: the exact rows
    assert vectors.recall(every, exact).filter("got < wanted").count() == 0


def test_clustered_vectors_need_few_cells(spark):
    r = np.random.default_rng(1)
    middle = r.normal(size=(20, 16))
    rows = [(i, [float(v) for v in middle[i % 20] + 0.05 * r.normal(size=16)]) for i in range(600)]
    v = spark.createDataFrame(rows, "page long, vec array<double>")
    c, probe = vectors.centroids(v, vectors.Fit(cells=20))
    assert len(c) == 20 and probe <= 4


def files(tmp_path):
    return {(str(f), os.stat(f).st_mtime_ns) for f in (tmp_path / "v" / "cells").glob("cell=*/*.parquet")}


def test_an_upsert_rewrites_its_cells_only(spark, rows, tmp_path):
    at = f"file://{tmp_path}/v"
    vectors.build(rows, at)
    before = files(tmp_path)
    new = rows.filter("page = 8").select(F.lit(9).cast("long").alias("page"), "vec").union(rows.filter("page = 8").select(F.lit(-1).cast("long"), "vec")).union(rows.filter("page = 8").select(F.lit(0).cast("long"), "vec"))
    cells = vectors.upserted(spark, at, new)
    after = files(tmp_path)
    assert 1 <= len(cells) <= 2
    cell_of = lambda f: int(f[0].split("cell=")[1].split("/")[0])
    assert {cell_of(f) for f in before ^ after} == set(cells)
    want = {r["page"]: r["vec"] for r in rows.collect()}
    want |= {9: want[8], -1: want[8]}
    got = {r["page"]: r["vec"] for r in vectors.stored(spark, at).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert vectors.upserted(spark, at, new) and vectors.stored(spark, at).count() == len(want)  # again, to the same result


def test_a_cell_may_lose_all_its_vectors(spark, tmp_path):
    at, schema = f"file://{tmp_path}/v", "page long, vec array<double>, cell string"
    vectors.build(spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [0.0, 1.0], "y")], schema), at)
    vectors.upserted(spark, at, spark.createDataFrame([(2, [1.0, 0.1], "z")], schema))
    assert {r["page"]: r["vec"] for r in vectors.stored(spark, at).collect()} == {1: [1.0, 0.0], 2: [1.0, 0.1]}


def test_odd_vectors(spark, tmp_path):
    schema = "page long, vec array<double>"
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [0.0, 0.0]), (6, [1.0, 2.0]), (6, [1.0, 2.0]), (None, [2.0, 1.0])], schema)
    vectors.build(odd, f"file://{tmp_path}/v")
    asked = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [])], "query long, qvec array<double>")
    got = [(r["page"], r["score"]) for r in vectors.nearest(spark, f"file://{tmp_path}/v", asked).collect()]
    assert sorted(got, key=str) == [(6, 1.0), (6, 1.0), (None, 0.8)]
    vectors.build(odd.limit(0), f"file://{tmp_path}/none")
    assert vectors.nearest(spark, f"file://{tmp_path}/none", asked).count() == 0


@pytest.mark.parametrize("most, few", [(10_000, 2048), (3, 4)])
def test_firsts_from_matrices_equal_the_scan(spark, monkeypatch, most, few):
    monkeypatch.setattr(search, "DENSE_VECTORS", few)
    monkeypatch.setattr(search, "DENSE_QUERIES", few)
    r = np.random.default_rng(5)
    vecs = [[float(v) for v in r.normal(size=4)] for _ in range(60)]
    vecs += [vecs[3]] * 30 + [[2 * v for v in vecs[3]]] * 5  # many copies, and ties
    vecs += [[v + 1e-9 for v in vecs[3]], [0.0] * 4, None, [1.0, None, 2.0, 3.0], [1.0, 2.0], [float("nan")] * 4, [1e200, 0.0, 0.0, 0.0], []]
    rows = spark.createDataFrame(list(enumerate(vecs)), "page long, vec array<double>")
    asked = rows.filter("page % 6 = 3 OR page > 90").selectExpr("page AS query", "vec AS qvec")
    both = [sorted(first_k(x, 7, ["query"], F.desc("score"), "page").collect(), key=repr) for x in (dense(rows, asked), search.dense_top(rows, asked, 7, most))]
    assert repr(both[0]) == repr(both[1]) and len(both[0]) == 7 * asked.count()
