"""Bounded traversals of the property graph.

A level of a breadth-first search is one join of the frontier with the edges and one anti-join with the nodes seen.
Levels are written as tables, so each is computed once, and the search ends at the first empty level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.functions.tables import materialized
from metaloom.operators.paging import clamped
from metaloom.operators.registry import query


def levels(edges: DataFrame, start: DataFrame, depth: int, until: str | None = None) -> list[DataFrame]:
    """Levels of (node, distance, path) from the nodes of start(node); of the shortest paths to a node the least one.

    With until, the search ends at the level that holds that node.
    """
    edges = materialized(edges.select("src", "dst").filter("src <> dst").distinct(), "edges")
    level = start.select("node", F.lit(0).alias("distance"), F.array("node").alias("path"))
    out = [materialized(level, "level")]
    for k in range(1, depth + 1):
        ahead = out[-1].join(edges, out[-1]["node"] == edges["src"]).select(F.col("dst").alias("node"), "path")
        seen = reduce(DataFrame.union, [x.select("node") for x in out])
        ahead = ahead.join(seen, "node", "left_anti").groupBy("node").agg(F.min("path").alias("path"))
        level = materialized(ahead.select("node", F.lit(k).alias("distance"), F.concat("path", F.array("node")).alias("path")), "level")
        if level.isEmpty():
            break
        out.append(level)
        if until is not None and not level.filter(F.col("node") == until).isEmpty():
            break
    return out


def distances(edges: DataFrame, start: DataFrame, depth: int) -> list[DataFrame]:
    """Levels of (node, distance) from the nodes of start(node)."""
    edges = materialized(edges.select("src", "dst").filter("src <> dst").distinct(), "edges")
    out = [start.select("node", F.lit(0).alias("distance"))]
    for k in range(1, depth + 1):
        ahead = out[-1].join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        seen = reduce(DataFrame.union, [x.select("node") for x in out])
        level = materialized(ahead.join(seen, "node", "left_anti").select("node", F.lit(k).alias("distance")), "level")
        if level.isEmpty():
            break
        out.append(level)
    return out


def reachable(edges: DataFrame, start: str, depth: int, limit: int, reverse: bool = False) -> DataFrame:
    """(node, min_distance) of the nodes that start leads to, or that lead to it, nearest first."""
    e = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if reverse else edges
    one = edges.sparkSession.createDataFrame([(start,)], "node string")
    found = reduce(DataFrame.union, distances(e, one, clamped(depth, 1, 10)))
    return found.filter("distance > 0").select("node", F.col("distance").alias("min_distance")).orderBy("min_distance", "node").limit(clamped(limit, 1, 500))


def callers(calls: DataFrame, of: str, depth: int = 3, limit: int = 100) -> DataFrame:
    return reachable(calls, of, depth, limit, reverse=True)


def callees(calls: DataFrame, of: str, depth: int = 3, limit: int = 100) -> DataFrame:
    return reachable(calls, of, depth, limit)


def shortest_path(edges: DataFrame, a: str, b: str, depth: int, directed: bool = True) -> DataFrame:
    """One row (length, path): the least of the shortest paths; without any, length is null and path is empty."""
    spark = edges.sparkSession
    e = edges.select("src", "dst")
    e = e if directed else e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    found = levels(e, spark.createDataFrame([(a,)], "node string"), clamped(depth, 1, 10), until=b)
    hit = reduce(DataFrame.union, found).filter(F.col("node") == b).agg(F.min("distance").alias("length"), F.min("path").alias("path"))
    return hit.select("length", F.coalesce(F.array_join("path", " > "), F.lit("")).alias("path"))


def dependency_paths(edges: DataFrame, start: str, depth: int) -> DataFrame:
    """(node, depth, relations, path) of the nodes that edges in any direction lead to: of the shortest paths the least.

    A level keeps one path a node, as a shortest path has shortest beginnings; hubs cost their edges and not their
    paths.  Each level is a table, so it is computed once.
    """
    e = edges.select("rel", "src", "dst")
    both = materialized(e.union(e.select("rel", F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct(), "edges")
    at = edges.sparkSession.createDataFrame([(start, 0, "", start)], "node string, depth int, relations string, path string")
    out = [at]
    for k in range(1, clamped(depth, 1, 3) + 1):
        relations = F.concat("relations", F.lit("" if k == 1 else ">"), "rel")
        step = out[-1].join(both, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.concat("path", F.lit(">"), "dst").alias("path"), relations.alias("relations"))
        seen = reduce(DataFrame.union, [x.select("node") for x in out])
        step = step.groupBy("node").agg(F.min(F.struct("path", "relations")).alias("x")).join(seen, "node", "left_anti")
        out.append(materialized(step.select("node", F.lit(k).alias("depth"), "x.relations", "x.path"), "paths"))
    return reduce(DataFrame.union, out[1:])


def dependency_tree(edges: DataFrame, start: str, depth: int = 2, limit: int = 50) -> DataFrame:
    """The nearest nodes that depend on each other with start: their least depth and path, the total, and whether more are left."""
    nodes = dependency_paths(edges, start, depth)
    total = nodes.agg(F.count(F.lit(1)).alias("total"))
    top = nodes.orderBy("depth", "node").limit(clamped(limit, 1, 100)).crossJoin(F.broadcast(total))
    return top.withColumn("truncated", F.col("total") > clamped(limit, 1, 100))


def tree(objects: DataFrame, edges: DataFrame, root: str | None = None, depth: int = 5) -> DataFrame:
    """(root, depth, id, name) of a hierarchy below one root, or below all nodes without a parent.

    A level is a join; the depth is bounded, so a cycle ends.
    """
    parents = edges.filter("rel = 'PARENT_OF'").select("src", "dst")
    nodes = objects.filter("kind = 'Subsystem'").select("id", "name")
    if root is None:
        roots = nodes.select("id").join(parents.select(F.col("dst").alias("id")), "id", "left_anti")
    else:
        roots = nodes.select("id").filter(F.col("id") == root)
    at = roots.select(F.col("id").alias("root"), F.lit(0).alias("depth"), "id")
    out = [at]
    for k in range(1, depth + 1):
        at = at.join(parents, at["id"] == parents["src"]).select("root", F.lit(k).alias("depth"), F.col("dst").alias("id"))
        out.append(at)
    return reduce(DataFrame.union, out).join(nodes, "id").select("root", "depth", "id", "name")


_BFS = """WITH RECURSIVE t AS (SELECT min({here}) AS node FROM g_calls),
b AS (SELECT node, 0 AS d FROM t UNION SELECT c.{there}, b.d + 1 FROM b JOIN g_calls c ON c.{here} = b.node WHERE b.d < {depth})
SELECT node, min(d) AS min_distance FROM b WHERE node <> (SELECT node FROM t) GROUP BY node ORDER BY min_distance, node LIMIT {limit}"""


def _least(df: DataFrame, column: str) -> str:
    return df.agg(F.min(column)).first()[0]


@query("G01", _BFS.format(here="dst", there="src", depth=5, limit=500), "g_calls")
def _(d):
    return callers(d.g_calls, _least(d.g_calls, "dst"), depth=5, limit=500)


@query("G02", _BFS.format(here="src", there="dst", depth=4, limit=100), "g_calls")
def _(d):
    return callees(d.g_calls, _least(d.g_calls, "src"), depth=4, limit=100)


_ENDS = "(SELECT min(src) FROM g_calls)", "(SELECT max(c2.dst) FROM g_calls c1 JOIN g_calls c2 ON c2.src = c1.dst WHERE c1.src = (SELECT min(src) FROM g_calls) AND c2.dst <> c1.src)"


@query("G03", f"""WITH RECURSIVE w AS (SELECT {_ENDS[0]} AS node, [{_ENDS[0]}] AS path, 0 AS d
UNION ALL SELECT c.dst, list_append(path, c.dst), d + 1 FROM w JOIN g_calls c ON c.src = w.node WHERE d < 5 AND NOT list_contains(path, c.dst)),
h AS (SELECT d, path FROM w WHERE node = {_ENDS[1]})
SELECT min(d) AS length, coalesce(array_to_string(min(path), ' > '), '') AS path FROM h WHERE d = (SELECT min(d) FROM h)""", "g_calls")
def _(d):
    calls = materialized(d.g_calls, "calls")
    a = _least(calls, "src")
    first = calls.filter(F.col("src") == a).select(F.col("dst").alias("via"))
    b = calls.join(first, F.col("src") == F.col("via")).filter(F.col("dst") != a).agg(F.max("dst")).first()[0]
    return shortest_path(calls, a, b, 5)


@query("G04", """WITH RECURSIVE u AS (SELECT src, dst FROM g_edges WHERE rel IN ('PARENT_OF', 'CONTAINS', 'OWNED_BY', 'BASED_ON')),
e AS (SELECT src, dst FROM u UNION SELECT dst, src FROM u),
w AS (SELECT 'Catalog.C1' AS node, ['Catalog.C1'] AS path, 0 AS d
UNION ALL SELECT e.dst, list_append(path, e.dst), d + 1 FROM w JOIN e ON e.src = w.node WHERE d < 3 AND NOT list_contains(path, e.dst)),
h AS (SELECT d, path FROM w WHERE node = 'Subsystem.N3')
SELECT min(d) AS length, coalesce(array_to_string(min(path), ' > '), '') AS path FROM h WHERE d = (SELECT min(d) FROM h)""", "g_edges")
def _(d):
    used = d.g_edges.filter("rel IN ('PARENT_OF', 'CONTAINS', 'OWNED_BY', 'BASED_ON')")
    return shortest_path(used, "Catalog.C1", "Subsystem.N3", 3, directed=False)


@query("G05", """WITH b AS (SELECT rel, src, dst, rel || '|' || src || '|' || dst AS edge FROM g_edges UNION ALL SELECT rel, dst, src, rel || '|' || src || '|' || dst FROM g_edges),
p AS (SELECT dst AS node, 1 AS depth, rel AS relations, 'Subsystem.N3>' || dst AS path FROM b WHERE src = 'Subsystem.N3'
UNION ALL SELECT y.dst, 2, x.rel || '>' || y.rel, 'Subsystem.N3>' || x.dst || '>' || y.dst FROM b x JOIN b y ON y.src = x.dst AND y.edge <> x.edge WHERE x.src = 'Subsystem.N3'),
n AS (SELECT node, min({'depth': depth, 'path': path, 'relations': relations}) AS x FROM p WHERE node <> 'Subsystem.N3' GROUP BY node)
SELECT node, x.depth AS depth, x.relations AS relations, x.path AS path, (SELECT CAST(count(*) AS BIGINT) FROM n) AS total, (SELECT count(*) FROM n) > 100 AS truncated
FROM n ORDER BY x.depth, node LIMIT 100""", "g_edges")
def _(d):
    return dependency_tree(d.g_edges, "Subsystem.N3", 2, 100)


@query("G06", """WITH RECURSIVE p AS (SELECT src, dst FROM g_edges WHERE rel = 'PARENT_OF'),
t AS (SELECT id AS root, 0 AS depth, id FROM g_objects WHERE kind = 'Subsystem' AND id NOT IN (SELECT dst FROM p)
UNION ALL SELECT t.root, t.depth + 1, p.dst FROM t JOIN p ON p.src = t.id WHERE t.depth < 5)
SELECT t.root, t.depth, t.id, o.name FROM t JOIN g_objects o ON o.id = t.id""", "g_objects g_edges")
def _(d):
    return tree(d.g_objects, d.g_edges)
