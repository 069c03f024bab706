"""Statistics over the graph, and checks of counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metaloom.operators.paging import clamped
from metaloom.operators.registry import query


def counts_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def coverage(resolved: Column, unresolved: Column, outside: Column) -> Column:
    """Percent of calls that are resolved among those that can be; 0 if there are none."""
    base = resolved + unresolved - outside
    return F.when(base > 0, F.round(100 * resolved / base, 2)).otherwise(F.lit(0.0))


def graph_stats(objects: DataFrame, edges: DataFrame, callsites: DataFrame) -> DataFrame:
    """(section, key, n): objects by kind, edges by type, and call sites by outcome, each table read once."""
    a = objects.groupBy(F.col("kind").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("object").alias("section"), "key", "n")
    b = edges.groupBy(F.col("rel").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("section"), "key", "n")
    one = callsites.agg(F.count_if("resolved").alias("resolved"), F.count_if(~F.col("resolved")).alias("unresolved"))
    c = one.select(F.explode(F.create_map(F.lit("resolved"), F.col("resolved"), F.lit("unresolved"), F.col("unresolved"))).alias("key", "n")).select(F.lit("callsite").alias("section"), "key", "n")
    return a.union(b).union(c)


def top(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    return counts_by(df, key).orderBy(F.desc("n"), key).limit(k)


def code_stats(callsites: DataFrame, calls: DataFrame, operates: DataFrame, k: int = 10) -> DataFrame:
    """(section, key, n): hottest callees and callers, reasons and ways of access, k of each."""
    out = None
    for name, df, key in (("callee", calls, "dst"), ("caller", calls, "src"), ("reason", callsites.filter("not resolved"), "reason"), ("via", operates, "via")):
        part = top(df, key, k).select(F.lit(name).alias("section"), F.col(key).alias("key"), "n")
        out = part if out is None else out.union(part)
    return out


def unresolved_report(callsites: DataFrame, hidden: list[str], reason: str | None = None, limit: int = 50) -> DataFrame:
    """(reason, n, shown): a histogram of all reasons, and whether the default view shows each; an asked reason is shown."""
    shown = F.col("reason") == reason if reason else ~F.col("reason").isin(hidden)
    return callsites.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).withColumn("shown", shown).orderBy(F.desc("n"), "reason").limit(clamped(limit, 1, 500))


def ownership(callables: DataFrame, operates: DataFrame) -> DataFrame:
    """One row: callables, orphans, their percentage, and a verdict."""
    owned = operates.select(F.col("src").alias("id")).distinct().withColumn("owned", F.lit(1))
    one = callables.join(owned, "id", "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("owned").isNull()).alias("orphans"))
    pct = F.when(F.col("n") > 0, F.round(100.0 * F.col("orphans") / F.col("n"), 3)).otherwise(0.0)
    one = one.withColumn("orphan_pct", pct)
    verdict = F.when(F.col("n") == 0, "EMPTY").when(F.col("orphans") == F.col("n"), "BROKEN").when(F.col("orphan_pct") >= 1, "PARTIAL").otherwise("OK")
    return one.withColumn("state", verdict)


def tally(rows: DataFrame, kept: Column, reason: Column, min_ratio: float = 0.9) -> DataFrame:
    """One row: seen, kept, dropped for a reason, unexplained, and whether too few are kept."""
    one = rows.agg(F.count(F.lit(1)).alias("seen"), F.count_if(kept).alias("kept"), F.count_if(~kept & reason.isNotNull()).alias("dropped"))
    one = one.withColumn("unexplained", F.col("seen") - F.col("kept") - F.col("dropped"))
    return one.withColumn("alarm", (F.col("unexplained") != 0) | (F.col("kept") < min_ratio * F.col("seen")))


def rollup_by_file(diagnostics: DataFrame) -> DataFrame:
    """For each file: issues, the first issue, and its distinct codes in the order they are first seen."""
    codes = diagnostics.groupBy("file", "code").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    files = codes.groupBy("file").agg(F.sum("n").alias("n"), F.min_by("code", "pos").alias("first_code"), F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("x"))
    return files.select("file", "n", "first_code", F.array_join(F.col("x.code"), ",").alias("codes"))


def inventory(declared: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, state): what only one of two lists has."""
    a = declared.select(key).distinct().withColumn("a", F.lit(1))
    b = known.select(key).distinct().withColumn("b", F.lit(1))
    both = a.join(b, key, "full").filter("a IS NULL OR b IS NULL")
    return both.select(key, F.when(F.col("b").isNull(), "declared_only").otherwise("known_only").alias("state"))


def kinds_with_counts(kinds: list[str], rows: DataFrame, key: str) -> DataFrame:
    """A count for each of a fixed list of kinds, zero if there is none."""
    base = rows.sparkSession.createDataFrame([(k,) for k in kinds], f"{key} string")
    return base.join(counts_by(rows, key), key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def drift(baseline: DataFrame, actual: DataFrame, invariants: list[str], tolerance: float = 5.0) -> DataFrame:
    """(name, expected, actual, pct, state): invariants allow no drift, other counts some."""
    both = baseline.join(actual, "name", "full")
    off = F.col("actual") - F.col("expected")
    pct = F.when(F.col("expected") != 0, F.round(100.0 * off / F.col("expected"), 1))
    state = (
        F.when(F.col("expected").isNull(), "new")
        .when(F.col("actual").isNull(), "missing")
        .when(F.col("name").isin(invariants) if invariants else F.lit(False), F.when(off == 0, "ok").otherwise("broken"))
        .when(F.abs(F.coalesce(pct, F.lit(0.0))) <= tolerance, "ok")
        .otherwise("drift")
    )
    return both.select("name", "expected", "actual", pct.alias("pct"), state.alias("state"))


def collisions(rows: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys, and rows that repeat one; counts are taken by key first, so no set of keys is gathered."""
    by = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return by.agg(F.count(F.lit(1)).alias("distinct"), F.sum(F.col("n") - 1).alias("repeats"))


@query("A01", """SELECT 'object' AS section, kind AS key, CAST(count(*) AS BIGINT) AS n FROM g_objects GROUP BY kind
UNION ALL SELECT 'edge', rel, CAST(count(*) AS BIGINT) FROM g_edges GROUP BY rel
UNION ALL SELECT 'callsite', CASE WHEN resolved THEN 'resolved' ELSE 'unresolved' END, CAST(count(*) AS BIGINT) FROM g_callsites GROUP BY 2""", "g_objects g_edges g_callsites")
def _(d):
    return graph_stats(d.g_objects, d.g_edges, d.g_callsites)


@query("A02", "SELECT kind, CAST(count(*) AS BIGINT) AS n FROM g_objects GROUP BY kind ORDER BY n DESC, kind", "g_objects")
def _(d):
    return counts_by(d.g_objects, "kind").orderBy(F.desc("n"), "kind")


@query("A03", "SELECT type_kind, CAST(count(*) AS BIGINT) AS n FROM g_attributes GROUP BY type_kind ORDER BY n DESC, type_kind LIMIT 10", "g_attributes")
def _(d):
    return top(d.g_attributes, "type_kind")


@query("A03_targets", "SELECT dst, CAST(count(*) AS BIGINT) AS n FROM g_edges WHERE rel IN ('REGISTERS', 'BASED_ON') GROUP BY dst ORDER BY n DESC, dst LIMIT 10", "g_edges")
def _(d):
    return top(d.g_edges.filter("rel IN ('REGISTERS', 'BASED_ON')"), "dst")


def _top_sql(section: str, key: str, table: str, where: str = "") -> str:
    return f"SELECT * FROM (SELECT '{section}' AS section, {key} AS key, CAST(count(*) AS BIGINT) AS n FROM {table} {where} GROUP BY {key} ORDER BY n DESC, key LIMIT 10) x_{section}"


@query("A04", " UNION ALL ".join([_top_sql("callee", "dst", "g_calls"), _top_sql("caller", "src", "g_calls"), _top_sql("reason", "reason", "g_callsites", "WHERE NOT resolved"), _top_sql("via", "via", "g_operates")]), "g_calls g_operates")
def _(d):
    return code_stats(d.g_callsites, d.g_calls, d.g_operates)


@query("A05", "SELECT reason, CAST(count(*) AS BIGINT) AS n, reason NOT IN ('view', 'click') AS shown FROM g_callsites GROUP BY reason", "g_callsites")
def _(d):
    return unresolved_report(d.g_callsites, ["view", "click"])


@query("A09", "SELECT tool_name, quantile_cont(duration_ms, 0.5) AS p50, quantile_cont(duration_ms, 0.95) AS p95 FROM tool_calls GROUP BY tool_name", "tool_calls")
def _(d):
    return d.tool_calls.groupBy("tool_name").agg(F.percentile("duration_ms", 0.5).alias("p50"), F.percentile("duration_ms", 0.95).alias("p95"))


@query("A10", """SELECT n, orphans, orphan_pct, CASE WHEN n = 0 THEN 'EMPTY' WHEN orphans = n THEN 'BROKEN' WHEN orphan_pct >= 1 THEN 'PARTIAL' ELSE 'OK' END AS state
FROM (SELECT n, orphans, CASE WHEN n > 0 THEN round(100.0 * CAST(orphans AS DOUBLE) / n, 3) ELSE 0 END AS orphan_pct
FROM (SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE id NOT IN (SELECT src FROM g_operates WHERE via = 'view')) AS BIGINT) AS orphans FROM g_callables))""", "g_callables g_operates")
def _(d):
    return ownership(d.g_callables, d.g_operates.filter("via = 'view'"))


@query("A11", """SELECT CAST(count(*) AS BIGINT) AS seen, CAST(count(*) FILTER (WHERE resolved) AS BIGINT) AS kept, CAST(count(*) FILTER (WHERE NOT resolved) AS BIGINT) AS dropped,
CAST(0 AS BIGINT) AS unexplained, count(*) FILTER (WHERE resolved) < 0.9 * count(*) AS alarm FROM g_callsites""", "g_callsites")
def _(d):
    return tally(d.g_callsites, F.col("resolved"), F.col("reason"))


@query("A12", """SELECT user_id AS file, CAST(count(*) AS BIGINT) AS n, arg_min(event_type, event_id) AS first_code,
(SELECT string_agg(event_type, ',' ORDER BY p) FROM (SELECT event_type, min(event_id) AS p FROM events e2 WHERE e2.user_id = e.user_id GROUP BY event_type)) AS codes
FROM events e GROUP BY user_id""")
def _(d):
    return rollup_by_file(d.events.select(F.col("user_id").alias("file"), F.col("event_type").alias("code"), F.col("event_id").alias("pos")))


@query("A13", """SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'declared_only' ELSE 'known_only' END AS state
FROM (SELECT DISTINCT p_brand || p_size AS k FROM part WHERE p_size < 30) a FULL JOIN (SELECT DISTINCT p_brand || p_size AS k FROM part WHERE p_size > 20) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def _(d):
    k = d.part.select(F.concat("p_brand", "p_size").alias("k"), "p_size")
    return inventory(k.filter("p_size < 30"), k.filter("p_size > 20"), "k")


@query("A14", """SELECT t.tool, CAST(count(c.id) AS BIGINT) AS calls, CAST(count(c.id) FILTER (WHERE NOT c.success) AS BIGINT) AS errors, max(c.id) AS last_id, count(c.id) = 0 AS never_called
FROM (VALUES ('click'), ('view'), ('error'), ('unused')) AS t(tool) LEFT JOIN tool_calls c ON c.tool_name = t.tool GROUP BY t.tool""", "tool_calls")
def _(d):
    return usage(d.spark.createDataFrame([(x,) for x in ("click", "view", "error", "unused")], "tool string"), d.tool_calls)


def usage(registered: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls, errors and the last call of each registered tool, and which were never called."""
    by = calls.groupBy(F.col("tool_name").alias("tool")).agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("success")).alias("errors"), F.max("id").alias("last_id"))
    out = registered.join(by, "tool", "left")
    return out.select("tool", F.coalesce("calls", F.lit(0)).cast("long").alias("calls"), F.coalesce("errors", F.lit(0)).cast("long").alias("errors"), "last_id", F.col("calls").isNull().alias("never_called"))


@query("A15", """SELECT server_name, string_agg(tool_name || ' ×' || n, ', ' ORDER BY n DESC, tool_name) AS tally
FROM (SELECT server_name, tool_name, count(*) AS n FROM tool_calls GROUP BY server_name, tool_name) x GROUP BY server_name""", "tool_calls")
def _(d):
    return call_tally(d.tool_calls, "server_name")


def call_tally(calls: DataFrame, key: str) -> DataFrame:
    """(key, tally): 'tool ×n, ...' with the most frequent first."""
    by = counts_by(calls, key, "tool_name").withColumn("x", F.struct((-F.col("n")).alias("neg"), F.concat("tool_name", F.lit(" ×"), "n").alias("said")))
    return by.groupBy(key).agg(F.sort_array(F.collect_list("x")).alias("x")).select(key, F.array_join(F.col("x.said"), ", ").alias("tally"))


@query("A16", """SELECT tool_name, CAST(count(*) FILTER (WHERE success) AS BIGINT) AS n_ok, CAST(count(*) FILTER (WHERE NOT success) AS BIGINT) AS n_fail,
max(id) FILTER (WHERE success) AS last_ok, max(id) FILTER (WHERE NOT success) AS last_fail FROM tool_calls GROUP BY tool_name""", "tool_calls")
def _(d):
    ok = F.col("success")
    return d.tool_calls.groupBy("tool_name").agg(F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_fail"), F.max(F.when(ok, F.col("id"))).alias("last_ok"), F.max(F.when(~ok, F.col("id"))).alias("last_fail"))


def age_bucket(day: Column, today: Column) -> Column:
    age = F.datediff(today, day)
    return F.when(day.isNull(), "unknown").when(age <= 90, "<=90").when(age <= 365, "<=365").when(age <= 730, "<=730").otherwise("older")


@query("A17", """SELECT CASE WHEN d <= 90 THEN '<=90' WHEN d <= 365 THEN '<=365' WHEN d <= 730 THEN '<=730' ELSE 'older' END AS bucket, CAST(count(*) AS BIGINT) AS n
FROM (SELECT date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') AS d FROM orders) x GROUP BY 1""")
def _(d):
    return counts_by(d.orders.select(age_bucket(F.to_date("o_orderdate"), F.lit("2001-08-01").cast("date")).alias("bucket")), "bucket")


@query("A18", """SELECT k AS event_type, CAST(count(e.event_id) AS BIGINT) AS n FROM (VALUES ('click'), ('view'), ('none')) AS t(k) LEFT JOIN events e ON e.event_type = k GROUP BY k""")
def _(d):
    return kinds_with_counts(["click", "view", "none"], d.events, "event_type")


@query("A19", """WITH b AS (SELECT * FROM (VALUES ('click', 2000), ('view', 2010), ('error', 5), ('gone', 7)) AS t(name, expected)),
a AS (SELECT event_type AS name, CAST(count(*) AS BIGINT) AS actual FROM events GROUP BY event_type),
j AS (SELECT coalesce(b.name, a.name) AS name, CAST(expected AS BIGINT) AS expected, actual, CASE WHEN expected <> 0 THEN round(100.0 * CAST(actual - expected AS DOUBLE) / expected, 1) END AS pct FROM b FULL JOIN a ON a.name = b.name)
SELECT name, expected, actual, pct, CASE WHEN expected IS NULL THEN 'new' WHEN actual IS NULL THEN 'missing' WHEN name = 'error' THEN CASE WHEN actual = expected THEN 'ok' ELSE 'broken' END
WHEN abs(coalesce(pct, 0)) <= 5 THEN 'ok' ELSE 'drift' END AS state FROM j""")
def _(d):
    base = d.spark.createDataFrame([("click", 2000), ("view", 2010), ("error", 5), ("gone", 7)], "name string, expected long")
    return drift(base, counts_by(d.events, "event_type", name="actual").withColumnRenamed("event_type", "name"), ["error"])


@query("A20", "SELECT CAST(count(DISTINCT h) AS BIGINT) AS \"distinct\", CAST(count(*) - count(DISTINCT h) AS BIGINT) AS repeats FROM (SELECT md5(text) AS h FROM documents) x")
def _(d):
    return collisions(d.documents.select(F.md5("text").alias("h")), "h")


@query("A23", "SELECT access, CAST(count(*) AS BIGINT) AS n FROM g_operates GROUP BY access", "g_operates")
def _(d):
    return counts_by(d.g_operates, "access")


@query("K05", "SELECT rel, CAST(count(*) AS BIGINT) AS n FROM g_edges GROUP BY rel", "g_edges")
def _(d):
    return edge_snapshot(d.g_edges)


def edge_snapshot(edges: DataFrame) -> DataFrame:
    """Edge counts by type, materialised, so that later statistics do not read the edges."""
    from metaloom.functions.tables import materialized

    return materialized(counts_by(edges, "rel"), "edge-counts")


@query("C12", """SELECT CASE WHEN r + u - o > 0 THEN round(100.0 * CAST(r AS DOUBLE) / (r + u - o), 2) ELSE 0 END AS coverage FROM (SELECT count(*) FILTER (WHERE resolved) AS r,
count(*) FILTER (WHERE NOT resolved) AS u, count(*) FILTER (WHERE NOT resolved AND line % 2 = 0) AS o FROM g_callsites) x""", "g_callsites")
def _(d):
    one = d.g_callsites.agg(F.count_if("resolved").alias("r"), F.count_if(~F.col("resolved")).alias("u"), F.count_if(~F.col("resolved") & (F.col("line") % 2 == 0)).alias("o"))
    return one.select(coverage(F.col("r"), F.col("u"), F.col("o")).alias("coverage"))


@query("Q02_rollup", """SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def _(d):
    return d.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("qty"))


def usage_differences(registered: DataFrame, declared: DataFrame, calls: DataFrame) -> DataFrame:
    """(tool, state) of three sets of tools: registered but never called, called but unknown, registered but not declared."""
    called = calls.select(F.col("tool_name").alias("tool")).distinct()
    state = lambda a, b, name: a.select("tool").distinct().join(b.select("tool"), "tool", "left_anti").select("tool", F.lit(name).alias("state"))
    return state(registered, called, "never_called").union(state(called, registered, "unknown")).union(state(registered, declared, "not_declared"))


@query("U03", """WITH r(tool) AS (VALUES ('click'), ('view'), ('unused')), d(tool) AS (VALUES ('click'), ('unused'))
SELECT tool, 'never_called' AS state FROM r WHERE tool NOT IN (SELECT tool_name FROM tool_calls) UNION ALL
SELECT DISTINCT tool_name, 'unknown' FROM tool_calls WHERE tool_name NOT IN (SELECT tool FROM r) UNION ALL SELECT tool, 'not_declared' FROM r WHERE tool NOT IN (SELECT tool FROM d)""", "tool_calls")
def _(d):
    tools = lambda *names: d.spark.createDataFrame([(x,) for x in names], "tool string")
    return usage_differences(tools("click", "view", "unused"), tools("click", "unused"), d.tool_calls)


def without_pages(hits: DataFrame, key: str, limit: int, reason: str, instead: str) -> DataFrame:
    """For each key of ranked hits, which have no pages by nature: how many came back, why, and what to do instead."""
    by = hits.groupBy(key).agg(F.count(F.lit(1)).alias("returned"))
    return by.select(key, F.lit("none").alias("pagination"), "returned", F.lit(False).alias("has_more"), F.lit(None).cast("int").alias("next_offset"), F.lit(limit).alias("limit"), F.lit(reason).alias("pagination_reason"), F.lit(instead).alias("pagination_instead"))


@query("P03", """SELECT tool_name, 'none' AS pagination, CAST(least(count(*), 20) AS BIGINT) AS returned, false AS has_more, CAST(NULL AS INT) AS next_offset, CAST(20 AS INT) AS "limit", 'ranked' AS pagination_reason, 'refine' AS pagination_instead
FROM tool_calls GROUP BY tool_name""", "tool_calls")
def _(d):
    ranked = d.tool_calls.withColumn("rank", F.row_number().over(W.partitionBy("tool_name").orderBy(F.desc("duration_ms"), "id"))).filter("rank <= 20")
    return without_pages(ranked, "tool_name", 20, "ranked", "refine")
