"""Queries over whole texts and all texts, against brute force."""

import re

from metaloom.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def test_escape_of_whole_texts(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {k: t if t is None else re.sub(r'([+\-!(){}\[\]^"~*?:\\/&|])', r"\\\1", t) for k, t in texts.items()}
    assert any(len(t or "") > 60 for t in texts.values())
    assert {r["doc_id"]: r["q"] for r in QUERIES["X01"](spark, SF).collect()} == want


def test_sources_of_all_texts(spark):
    ids = [r["o_orderkey"] for r in spark.read.parquet(f"{SF}/orders.parquet").collect()]
    table = lambda k: "Справочник.ordrs" if k % 11 == 0 else "Справочник.orders"
    want = sorted(x for k in ids for x in ((k, table(k), "Т", ""), (k, "Справочник.customer", "Ц", "left"), (k, "Вт", "", "")))
    assert any(k % 11 == 0 for k in ids)
    assert sorted((r["id"], r["source"], r["alias"], r["joined"]) for r in QUERIES["Q02"](spark, SF).collect()) == want


def test_counts_of_cleared_edges_move_edges_once(spark):
    from metaloom.adapters import Data
    from metaloom.operators.service import cleared, cleared_counts

    nodes = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z"), ("d", "z")], "id string, kind string")
    rows = [("r", "c", "d"), ("r", "c", "d"), ("r", "a", "c"), ("r", "c", "a"), ("s", "d", "c"), ("s", "c", "c"), ("r", None, "c"), ("r", "c", None), ("t", "b", "c")]
    edges, plain = (spark.createDataFrame(x, "rel string, src string, dst string") for x in (rows, [("s", "d", "c"), ("s", "d", "c"), ("q", "c", "b")]))
    want = {r["rel"]: r["count"] for r in cleared(edges.distinct().union(plain), nodes, ["x", "y"]).groupBy("rel").count().collect()}
    assert {r["rel"]: r["n"] for r in cleared_counts(plain, edges, nodes, ["x", "y"]).collect()} == want == {"r": 3, "s": 4}
    data = Data(spark, SF)
    assert data.repeated("g_edges").distinct().count() == data.g_edges.count() < data.repeated("g_edges").count()
    plan = QUERIES["K04"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    moved = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert moved and not [x for x in moved if x.count(",") > 2]  # by all columns of an edge
