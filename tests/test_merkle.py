"""Changes between snapshots, against a full comparison; equal folders are never opened."""

import random

import pytest
from pyspark.sql import functions as F

from metaloom.operators import merkle


def table(spark, files):
    return spark.createDataFrame(list(files.items()) or [], "path string, digest string")


def compared(a, b):
    what = lambda p: "added" if p not in a else "removed" if p not in b else "changed"
    return sorted((p, what(p), a.get(p), b.get(p)) for p in a.keys() | b.keys() if a.get(p) != b.get(p))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])


def test_random_snapshots(spark):
    r = random.Random(4)
    old = {"/".join(r.choices("abc", k=r.randint(0, 4)) + [f"f{r.randint(0, 3)}"]): f"{r.randint(0, 5)}" for _ in range(80)}
    new = {p: (d if r.random() < 0.8 else d + "x") for p, d in old.items() if r.random() < 0.85} | {"a/new/deep/er/f": "1", "z": "2"}
    (ra, ta), (rb, tb) = (merkle.trees(table(spark, x)) for x in (old, new))
    assert rows(merkle.changed(ta.union(tb).distinct(), ra, rb)) == compared(old, new)
    assert merkle.trees(table(spark, dict(reversed(old.items()))))[0] == ra


def test_a_file_becomes_a_folder(spark):
    old, new = {"a/x": "1", "b": "2"}, {"a": "3", "b/y": "2"}
    (ra, ta), (rb, tb) = (merkle.trees(table(spark, x)) for x in (old, new))
    assert rows(merkle.changed(ta.union(tb).distinct(), ra, rb)) == compared(old, new)


def test_equal_folders_are_not_opened(spark):
    """With the entries of all equal folders taken out of the table, the result is the same."""
    old = {f"d{i}/e{j}/f{k}": f"{i}{j}{k}" for i in range(4) for j in range(3) for k in range(3)}
    new = old | {"d1/e2/f0": "other"}
    (ra, ta), (rb, tb) = (merkle.trees(table(spark, x)) for x in (old, new))
    both = ta.union(tb).distinct()
    need = {ra, rb}
    for t, name in ((ra, "d1"), (rb, "d1")):
        d = both.filter((F.col("tree") == t) & (F.col("name") == name)).first()["digest"]
        need |= {d, both.filter((F.col("tree") == d) & (F.col("name") == "e2")).first()["digest"]}
    few = both.filter(F.col("tree").isin(sorted(need)))
    assert few.count() < both.count()
    assert rows(merkle.changed(few, ra, rb)) == [("d1/e2/f0", "changed", "120", "other")]


def test_odd_snapshots(spark):
    odd = spark.createDataFrame([(None, "1"), ("", "1"), ("/", "1"), ("a//b", "1"), ("a/b", "2"), ("c", None)], "path string, digest string")
    root, stored = merkle.trees(odd)
    none, empty = merkle.trees(odd.limit(0))
    assert none == merkle.EMPTY and empty.count() == 0
    assert rows(merkle.changed(stored, none, root)) == [("a/b", "added", None, "2")]
    assert rows(merkle.changed(stored, root, none)) == [("a/b", "removed", "2", None)]
    assert merkle.changed(stored, root, root).count() == 0
    with pytest.raises(ValueError, match="no tree"):
        merkle.changed(stored, root, "0")
    with pytest.raises(ValueError, match="a file and a folder"):
        merkle.trees(table(spark, {"a": "1", "a/b": "2"}))
