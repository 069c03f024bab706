"""Incremental maintenance: digests, change plans, three-way sync, slices and stale call sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.operators.registry import query


def digests(lines: DataFrame, owner: str = "owner", line: str = "line") -> DataFrame:
    """(owner, digest): SHA-256 of an owner's sorted lines."""
    joined = F.array_join(F.sort_array(F.collect_list(line)), "\n")
    return lines.groupBy(owner).agg(F.sha2(joined, 256).alias("digest"))


def corpus_fingerprint(files: DataFrame, version: str) -> DataFrame:
    """One row: a digest over all files' digests and the pipeline version, whatever the order of the rows.

    Files are hashed in 4096 groups first, so that no task holds all lines.
    """
    line = F.sha2(F.concat_ws("\t", *files.columns), 256)
    parts = files.select(line.alias("h")).groupBy(F.substring("h", 1, 3).alias("part")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), "\n"), 256).alias("h"))
    return parts.agg(F.sha2(F.concat(F.lit(version + "\n"), F.array_join(F.sort_array(F.collect_list(F.concat("part", "h"))), "\n")), 256).alias("fingerprint"))


def blob_hash(text: Column) -> Column:
    """The object id that git gives a file."""
    data = text.cast("binary")
    return F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length(data).cast("string")).cast("binary"), F.lit(bytearray(1)), data))


def blob_variants(text: Column) -> Column:
    """The ids of a text as it is, with LF and with CRLF line ends, without repeats."""
    lf = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    return F.array_distinct(F.array(blob_hash(text), blob_hash(lf), blob_hash(F.replace(lf, F.lit("\n"), F.lit("\r\n")))))


def change_plan(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(owner, action): added, removed or changed between two digest tables (owner, digest); the root owner is left out."""
    a, b = current.select("owner", F.col("digest").alias("now")), stored.select("owner", F.col("digest").alias("was"))
    both = a.join(b, "owner", "full").filter(F.col("owner").cast("string") != "_root")
    action = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("was"), "changed")
    return both.select("owner", action.alias("action")).filter("action IS NOT NULL")


def plan_summary(plan: DataFrame, stored: DataFrame, max_partial: int) -> DataFrame:
    """One row: counts by action, and whether all has to be done anew: nothing is stored, or too much has changed."""
    one = plan.agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("added", "removed", "changed")], F.count(F.lit(1)).alias("n"))
    empty = stored.limit(1).agg((F.count(F.lit(1)) == 0).alias("empty"))
    return one.crossJoin(empty).select("added", "removed", "changed", (F.col("empty") | (F.col("n") > max_partial)).alias("full"))


def sync_plan(graph: DataFrame, disk: DataFrame, head: DataFrame) -> DataFrame:
    """(path, apply, dirty) of three versions (path, hash): apply where graph and disk differ, dirty where disk and head do."""
    g, d, h = (x.select("path", F.col("hash").alias(n)) for x, n in ((graph, "g"), (disk, "d"), (head, "h")))
    both = g.join(d, "path", "full").join(h, "path", "full")
    apply = F.when(~F.col("g").eqNullSafe(F.col("d")), F.when(F.col("d").isNull(), "remove").otherwise("upsert"))
    dirty = F.when(~F.col("d").eqNullSafe(F.col("h")), F.coalesce("d", F.lit("deleted")))
    return both.select("path", apply.alias("apply"), dirty.alias("dirty")).filter("apply IS NOT NULL OR dirty IS NOT NULL")


def candidates(*paths: DataFrame, unowned: DataFrame) -> DataFrame:
    """The union of path sets, without the paths that nobody owns."""
    out = paths[0].select("path")
    for p in paths[1:]:
        out = out.union(p.select("path"))
    return out.distinct().join(unowned.select("path"), "path", "left_anti")


def owner_plan(paths: DataFrame, max_owners: int = 300) -> DataFrame:
    """(owner, removes, upserts, phase) of planned paths (path, owner, action); removals come first."""
    by = paths.groupBy("owner").agg(F.count_if(F.col("action") == "remove").alias("removes"), F.count_if(F.col("action") == "upsert").alias("upserts"))
    return by.withColumn("phase", F.when(F.col("removes") > 0, 1).otherwise(2))


def replaced_slice(edges: DataFrame, slice_ids: DataFrame, new_edges: DataFrame) -> DataFrame:
    """edges without those that leave a slice's nodes, and with the slice's new edges; edges into the slice stay."""
    kept = edges.join(slice_ids.select(F.col("id").alias("src")), "src", "left_anti")
    return kept.select("rel", "src", "dst").union(new_edges.select("rel", "src", "dst"))


def restaled(callsites: DataFrame, callables: DataFrame, reason: str = "stale_after_incremental") -> DataFrame:
    """Call sites whose callee has gone are unresolved, for a reason that counts as debt."""
    there = callables.select(F.col("id").alias("callee")).distinct().withColumn("there", F.lit(1))
    both = callsites.join(there, "callee", "left")
    gone = F.col("resolved") & F.col("callee").isNotNull() & F.col("there").isNull()
    return both.select("id", "callee", (F.col("resolved") & ~gone).alias("resolved"), F.when(gone, reason).otherwise(F.col("reason")).alias("reason"))


def stale_debt(callsites: DataFrame, reasons: list[str]) -> DataFrame:
    return callsites.filter(~F.col("resolved") & F.col("reason").isin(reasons)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def owner_of(path: Column) -> Column:
    """The object that a file belongs to: its first two folders, or the root."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 2, F.concat_ws("/", F.slice(parts, 1, 2))).otherwise(F.lit("_root"))


def suffix_fingerprints(files: DataFrame) -> DataFrame:
    """(suffix, n, digest) of files (path, size, mtime_ns), in one pass over the list.

    A suffix's lines are hashed in 4096 groups first, and the groups' digests then, so no task holds all its lines.
    """
    line = F.sha2(F.concat_ws("\t", "path", "size", "mtime_ns"), 256)
    suffix = F.regexp_extract("path", r"(\.[^./]*)$", 1)
    parts = files.select(suffix.alias("suffix"), line.alias("h")).groupBy("suffix", F.substring("h", 1, 3).alias("part"))
    parts = parts.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("h")), "\n"), 256).alias("h"))
    return parts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("part", "h"))), "\n"), 256).alias("digest"))


_NOW = """SELECT owner, sha256(string_agg(line || CASE WHEN owner % 10 = 2 THEN chr(9) || 'x' ELSE '' END, chr(10) ORDER BY line || CASE WHEN owner % 10 = 2 THEN chr(9) || 'x' ELSE '' END)) AS digest FROM line_digests WHERE owner % 10 <> 0 GROUP BY owner"""
_WAS = "SELECT owner, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM line_digests WHERE owner % 10 <> 1 GROUP BY owner"
_PLAN = f"""SELECT coalesce(a.owner, b.owner) AS owner, CASE WHEN b.owner IS NULL THEN 'added' WHEN a.owner IS NULL THEN 'removed' ELSE 'changed' END AS action
FROM ({_NOW}) a FULL JOIN ({_WAS}) b ON a.owner = b.owner WHERE a.digest IS DISTINCT FROM b.digest"""


def _versions(d) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of the order lines, which differ by construction in added, removed and changed owners."""
    lines = d.line_digests
    marked = lines.withColumn("line", F.when(F.col("owner") % 10 == 2, F.concat("line", F.lit("\tx"))).otherwise(F.col("line")))
    return digests(marked.filter("owner % 10 <> 0")), digests(lines.filter("owner % 10 <> 1"))


@query("X08", "SELECT owner, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM line_digests GROUP BY owner", "line_digests")
def _(d):
    return digests(d.line_digests)


@query("X09", "SELECT doc_id, sha1('blob ' || octet_length(encode(text)) || chr(0) || text) AS blob FROM documents")
def _(d):
    return d.documents.select("doc_id", blob_hash(F.col("text")).alias("blob"))


@query("X10", """WITH l AS (SELECT sha256(o_orderkey || chr(9) || o_orderstatus) AS h FROM orders),
p AS (SELECT left(h, 3) AS part, sha256(string_agg(h, chr(10) ORDER BY h)) AS h FROM l GROUP BY 1)
SELECT sha256('v1' || chr(10) || string_agg(part || h, chr(10) ORDER BY part || h)) AS fingerprint FROM p""")
def _(d):
    return corpus_fingerprint(d.orders.select(F.col("o_orderkey").cast("string"), "o_orderstatus"), "v1")


@query("X11", "SELECT doc_id, md5(source || ':' || lang || ':' || doc_id) AS key FROM documents")
def _(d):
    return d.documents.select("doc_id", F.md5(F.concat_ws(":", "source", "lang", F.col("doc_id").cast("string"))).alias("key"))


@query("U01", _PLAN, "line_digests")
def _(d):
    return change_plan(*_versions(d))


@query("U01_summary", f"""SELECT CAST(count(*) FILTER (WHERE action = 'added') AS BIGINT) AS added, CAST(count(*) FILTER (WHERE action = 'removed') AS BIGINT) AS removed,
CAST(count(*) FILTER (WHERE action = 'changed') AS BIGINT) AS changed, count(*) > 300 AS "full" FROM ({_PLAN}) p""", "line_digests")
def _(d):
    now, was = _versions(d)
    return plan_summary(change_plan(now, was), was, 300)


@query("U02", """SELECT CAST(k AS BIGINT) AS path FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders UNION SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) u
WHERE k NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)""")
def _(d):
    a = d.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("path"))
    b = d.orders.select(F.col("o_custkey").alias("path"))
    c = d.lineitem.filter("l_quantity > 45").select(F.col("l_orderkey").alias("path"))
    return candidates(a, b, c, unowned=d.customer.filter("c_nationkey = 3").select(F.col("c_custkey").alias("path")))


_SYNC = """SELECT coalesce(g.path, d.path, h.path) AS path, CASE WHEN g.hash IS DISTINCT FROM d.hash THEN CASE WHEN d.hash IS NULL THEN 'remove' ELSE 'upsert' END END AS "apply",
CASE WHEN d.hash IS DISTINCT FROM h.hash THEN coalesce(d.hash, 'deleted') END AS dirty
FROM (SELECT o_orderkey AS path, o_orderstatus AS hash FROM orders WHERE o_orderkey % 7 <> 0) g
FULL JOIN (SELECT o_orderkey AS path, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS hash FROM orders WHERE o_orderkey % 11 <> 0) d ON g.path = d.path
FULL JOIN (SELECT o_orderkey AS path, o_orderstatus AS hash FROM orders WHERE o_orderkey % 13 <> 0) h ON coalesce(g.path, d.path) = h.path"""


def _three(d):
    o = d.orders.select(F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("hash"))
    disk = o.filter("path % 11 <> 0").withColumn("hash", F.when(F.col("path") % 5 == 0, "X").otherwise(F.col("hash")))
    return o.filter("path % 7 <> 0"), disk, o.filter("path % 13 <> 0")


@query("T04", f'SELECT * FROM ({_SYNC}) s WHERE "apply" IS NOT NULL OR dirty IS NOT NULL')
def _(d):
    return sync_plan(*_three(d))


@query("T05", f"""SELECT o_custkey AS owner, CAST(count(*) FILTER (WHERE "apply" = 'remove') AS BIGINT) AS removes, CAST(count(*) FILTER (WHERE "apply" = 'upsert') AS BIGINT) AS upserts,
CASE WHEN count(*) FILTER (WHERE "apply" = 'remove') > 0 THEN 1 ELSE 2 END AS phase FROM ({_SYNC}) s JOIN orders ON o_orderkey = path WHERE "apply" IS NOT NULL GROUP BY o_custkey""")
def _(d):
    owners = d.orders.select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("owner"))
    plan = sync_plan(*_three(d)).filter("apply IS NOT NULL").join(owners, "path")
    return owner_plan(plan.select("path", "owner", F.col("apply").alias("action")))


@query("T07", """SELECT rel, CAST(count(*) AS BIGINT) AS n FROM (SELECT rel, src, dst FROM g_edges WHERE src NOT IN ('Subsystem.N1', 'Subsystem.N2')
UNION ALL SELECT 'CONTAINS', 'Subsystem.N1', dst FROM g_edges WHERE src = 'Subsystem.N2' AND rel = 'CONTAINS') x GROUP BY rel""", "g_edges")
def _(d):
    ids = d.spark.createDataFrame([("Subsystem.N1",), ("Subsystem.N2",)], "id string")
    new = d.g_edges.filter("src = 'Subsystem.N2' AND rel = 'CONTAINS'").withColumn("src", F.lit("Subsystem.N1"))
    return replaced_slice(d.g_edges, ids, new).groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


_STALE = """SELECT s.id, s.callee, s.resolved AND NOT (s.callee IS NOT NULL AND c.id IS NULL) AS resolved,
CASE WHEN s.resolved AND s.callee IS NOT NULL AND c.id IS NULL THEN 'stale_after_incremental' ELSE s.reason END AS reason
FROM g_callsites s LEFT JOIN (SELECT id FROM g_callables WHERE NOT is_export) c ON c.id = s.callee"""


@query("T08", _STALE, "g_callables")
def _(d):
    return restaled(d.g_callsites, d.g_callables.filter("NOT is_export"))


@query("T09", f"SELECT reason, CAST(count(*) AS BIGINT) AS n FROM ({_STALE}) x WHERE NOT resolved AND reason IN ('stale_after_incremental', 'error') GROUP BY reason", "g_callables")
def _(d):
    return stale_debt(restaled(d.g_callsites, d.g_callables.filter("NOT is_export")), ["stale_after_incremental", "error"])


@query("T10", """WITH l AS (SELECT '.' || lang AS suffix, sha256(source || '/' || lang || '/' || doc_id || '.' || lang || chr(9) || n_chars || chr(9) || (doc_id % 7)) AS h FROM documents),
p AS (SELECT suffix, left(h, 3) AS part, count(*) AS n, sha256(string_agg(h, chr(10) ORDER BY h)) AS h FROM l GROUP BY 1, 2)
SELECT suffix, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(part || h, chr(10) ORDER BY part || h)) AS digest FROM p GROUP BY suffix""")
def _(d):
    path = F.concat(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")), F.lit("."), F.col("lang"))
    return suffix_fingerprints(d.documents.select(path.alias("path"), F.col("n_chars").alias("size"), (F.col("doc_id") % 7).alias("mtime_ns")))


@query("T11", "SELECT source || '/' || lang AS owner, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1")
def _(d):
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return d.documents.groupBy(owner_of(path).alias("owner")).agg(F.count(F.lit(1)).alias("n"))


@query("T12", """SELECT CAST(count(*) AS BIGINT) AS behind_files, count(*) = 0 AS in_sync FROM (""" + _SYNC + """) s WHERE "apply" IS NOT NULL""")
def _(d):
    return described(sync_plan(*_three(d)))


def described(plan: DataFrame) -> DataFrame:
    """One row: how many files the graph is behind, and whether it is in sync."""
    return plan.agg(F.count("apply").alias("behind_files")).withColumn("in_sync", F.col("behind_files") == 0)


# Facts of inferred types.

AMBIGUOUS = "AMBIGUOUS"


def merged_facts(facts: DataFrame) -> DataFrame:
    """(key, kind, confidence): one kind or AMBIGUOUS; the first fact's confidence stays.

    The outcome does not depend on the order of the facts but for the confidence, which goes by seq.
    """
    by = facts.groupBy("key").agg(F.min("kind").alias("a"), F.max("kind").alias("b"), F.min_by("confidence", "seq").alias("confidence"))
    return by.select("key", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(AMBIGUOUS).alias("kind"), "confidence")


def merged_passes(*passes: DataFrame) -> DataFrame:
    """(reason, n) of several passes (reason, n), summed."""
    out = passes[0]
    for p in passes[1:]:
        out = out.unionByName(p)
    return out.groupBy("reason").agg(F.sum("n").alias("n"))


@query("G08", """SELECT key, CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) ELSE 'AMBIGUOUS' END AS kind, arg_min(confidence, seq) AS confidence FROM g_facts GROUP BY key""", "g_facts")
def _(d):
    return merged_facts(d.g_facts)


@query("G09", "SELECT reason, CAST(count(*) AS BIGINT) AS n FROM g_callsites GROUP BY reason", "g_callsites")
def _(d):
    part = lambda c: d.g_callsites.filter(c).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return merged_passes(part("line < 50"), part("line >= 50"))
