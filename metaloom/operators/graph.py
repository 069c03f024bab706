"""Lookups and joins over the property graph: objects, edges, attributes, callables and call sites.

Objects are rows (id, kind, name, synonym, full_name_eng, full_name_ru, kind_ru); edges are rows (rel, src, dst).
Edge tables are best written partitioned by rel, so that a filter on rel prunes files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.operators.paging import clamped, paged
from metaloom.operators.registry import query


def named(ref: str) -> Column:
    """Whether an object goes by a name: its id, an English or Russian full name, or the Russian kind and name."""
    return (F.col("id") == ref) | (F.col("full_name_eng") == ref) | (F.col("full_name_ru") == ref) | (F.concat_ws(".", "kind_ru", "name") == ref)


def lookup(objects: DataFrame, ref: str) -> DataFrame:
    """The object of that name, the one with the least id if there are several."""
    return objects.filter(named(ref)).orderBy("id").limit(1)


def resolved(nodes: DataFrame, ref: str) -> DataFrame:
    """By id or full name, else by a bare name that only one node has; columns id and by."""
    exact = nodes.filter((F.col("id") == ref) | (F.col("full_name") == ref)).agg(F.min("id").alias("id"))
    bare = nodes.filter(F.col("name") == ref).agg(F.when(F.count(F.lit(1)) == 1, F.min("id")).alias("bare"))
    both = exact.crossJoin(bare)
    return both.select(F.coalesce("id", "bare").alias("id"), F.when(F.col("id").isNotNull(), "exact").when(F.col("bare").isNotNull(), "name").alias("by"))


def of_kind(objects: DataFrame, kind: str | None) -> DataFrame:
    """Objects of an English or Russian kind, in any case."""
    if kind is None:
        return objects
    return objects.filter((F.lower("kind") == kind.lower()) | (F.lower("kind_ru") == kind.lower()))


def containing(objects: DataFrame, text: str) -> DataFrame:
    """Substring search over names, synonyms and full names."""
    low = text.lower()
    return objects.filter(F.lower("name").contains(low) | F.lower("synonym").contains(low) | F.lower("full_name_ru").contains(low) | F.lower("full_name_eng").contains(low))


def scope(edges: DataFrame, root: str, depth: int = 5) -> DataFrame:
    """Ids of a subsystem and of its subsystems down to a depth."""
    parents = edges.filter("rel = 'PARENT_OF'").select("src", "dst")
    level = parents.sparkSession.createDataFrame([(root,)], "id string")
    out = level
    for _ in range(depth):
        level = level.join(parents, level["id"] == parents["src"]).select(F.col("dst").alias("id"))
        out = out.union(level)
    return out.distinct()


def in_scope(objects: DataFrame, edges: DataFrame, root: str, depth: int = 5) -> DataFrame:
    """Objects that a subsystem or one below it contains."""
    members = edges.filter("rel = 'CONTAINS'").join(scope(edges, root, depth), F.col("src") == F.col("id"), "left_semi").select("dst")
    return objects.join(members, objects["id"] == members["dst"], "left_semi")


def attribute_type(attributes: DataFrame, parent: str, name: str) -> DataFrame:
    """The types of an attribute of an object itself, or if it has none of that name, of its tabular sections."""
    found = attributes.filter((F.col("parent") == parent) & (F.col("name") == name))
    own = found.withColumn("via", F.when(F.col("section").isNull(), 0).otherwise(1))
    best = own.agg(F.min("via").alias("best"))
    return own.crossJoin(F.broadcast(best)).filter("via = best").select("id", "section", "role", "type_kind", "target")


def referrers(attributes: DataFrame, target: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """Attributes whose type leads to an object, by the object that owns them."""
    found = attributes.filter(F.col("target") == target)
    found = found.select(F.col("parent").alias("root"), F.coalesce("section", F.lit("")).alias("section"), F.col("name").alias("attribute"), "role")
    return paged(found, "root", "attribute", "section", limit=clamped(limit, 1, 200), offset=max(0, offset))


def object_attributes(attributes: DataFrame, parent: str, include_tabular: bool = True, role: str | None = None) -> DataFrame:
    """(section, attributes): an ordered list of (name, role, types) of the object and of each tabular section."""
    found = attributes.filter(F.col("parent") == parent)
    found = found if include_tabular else found.filter(F.col("section").isNull())
    found = found if role is None else found.filter(F.col("role") == role)
    each = found.groupBy("section", "name", "role").agg(F.min("pos").alias("pos"), F.array_join(F.array_sort(F.collect_set("type_kind")), "; ").alias("types"))
    line = F.concat_ws(":", "name", "role", "types")
    listed = each.groupBy("section").agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("x"))
    return listed.select("section", F.array_join(F.col("x.line"), ",").alias("attributes"))


def references(edges: DataFrame, objects: DataFrame, ref: str, outgoing: bool, limit: int, offset: int = 0) -> DataFrame:
    """Edges of any type between an object and others, in the order of the other end."""
    here, there = ("src", "dst") if outgoing else ("dst", "src")
    found = edges.filter(F.col(here) == ref).join(objects.select("id", "kind"), F.col(there) == F.col("id"))
    return paged(found.select("rel", F.col(there).alias("other"), "kind"), "other", "rel", limit=limit, offset=offset)


def details(objects: DataFrame, edges: DataFrame, ref: str, preview: int = 10) -> DataFrame:
    """An object with its counts of edges in and out, a preview of neighbours, and its subsystems."""
    one = lookup(objects, ref).select("id", "kind", "name", "synonym")
    touching = edges.filter((F.col("src") == ref) | (F.col("dst") == ref))
    facts = touching.agg(
        F.count_if(F.col("src") == ref).alias("n_out"),
        F.count_if(F.col("dst") == ref).alias("n_in"),
        F.array_join(F.slice(F.array_sort(F.collect_set(F.when(F.col("src") == ref, F.col("dst")).otherwise(F.col("src")))), 1, preview), ",").alias("preview"),
        F.array_join(F.array_sort(F.collect_set(F.when((F.col("rel") == "CONTAINS") & (F.col("dst") == ref), F.col("src")))), ",").alias("subsystems"),
    )
    return one.crossJoin(F.broadcast(facts))


def subsystems(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """All subsystems and how many objects each contains itself."""
    contained = edges.filter("rel = 'CONTAINS'").groupBy("src").agg(F.count("dst").alias("n"))
    subs = objects.filter("kind = 'Subsystem'")
    return subs.join(contained, subs["id"] == contained["src"], "left").select("id", "synonym", F.coalesce("n", F.lit(0)).cast("long").alias("n_members"))


def subsystem_members(objects: DataFrame, edges: DataFrame, ref: str, limit: int, offset: int = 0) -> DataFrame:
    root = lookup(objects, ref).select(F.col("id").alias("src"))
    ids = edges.filter("rel = 'CONTAINS'").join(F.broadcast(root), "src").select(F.col("dst").alias("id"))
    return paged(objects.join(ids, "id").select("id", "kind", "name"), "id", limit=limit, offset=offset)


def operating_on(operates: DataFrame, ref: str, via: str | None, limit: int = 100) -> DataFrame:
    """Callables that work on an object, perhaps only in one way."""
    found = operates.filter(F.col("dst") == ref)
    found = found if via is None else found.filter(F.col("via") == via)
    return found.select("src", "via", "access").orderBy("src", "via", "access").limit(clamped(limit, 1, 500))


def dead_objects(objects: DataFrame, edges: DataFrame, kind: str | None = None) -> DataFrame:
    """Objects that no subsystem contains; subsystems themselves only if asked for."""
    contained = edges.filter("rel = 'CONTAINS'").select(F.col("dst").alias("id"))
    found = of_kind(objects, kind) if kind else objects.filter("kind <> 'Subsystem'")
    return found.join(contained, "id", "left_anti").select("id", "kind", "name")


def dead_callables(callables: DataFrame, calls: DataFrame, handlers: list[str], include_exports: bool = False, module: str | None = None) -> DataFrame:
    """Callables that nothing calls, without event handlers and, unless asked for, without exports."""
    found = callables.filter(~F.col("name").isin(handlers)) if handlers else callables
    found = found if include_exports else found.filter(~F.coalesce("is_export", F.lit(False)))
    found = found if module is None else found.filter(F.col("module_id") == module)
    return found.join(calls.select(F.col("dst").alias("id")), "id", "left_anti").select("id", "module_id")


def split_by_match(rows: DataFrame, keys: DataFrame, on: str, reason: str) -> DataFrame:
    """rows with kept and a reason: kept where keys has the value."""
    there = keys.select(on).distinct().withColumn("__there", F.lit(True))
    return rows.join(there, on, "left").withColumn("kept", F.coalesce("__there", F.lit(False))).withColumn("reason", F.when(~F.col("kept"), reason)).drop("__there")


def join_hints(attributes: DataFrame, left: str, right: str) -> DataFrame:
    """Ways to join two tables: references from one to the other, also from tabular sections, and back."""
    a = attributes.filter(((F.col("parent") == left) & (F.col("target") == right)) | ((F.col("parent") == right) & (F.col("target") == left)))
    return a.select(F.col("parent").alias("from_table"), F.coalesce("section", F.lit("")).alias("section"), F.col("name").alias("attribute"), F.col("target").alias("to_table"))


def owned_by_prefix(owners: DataFrame, members: DataFrame) -> DataFrame:
    """(owner, id): members whose id is an owner's id or begins with it and a dot.

    Each id is cut at its dots and the pieces are joined by equality, so no pair of rows is tried twice and no side
    has to be small.
    """
    parts = F.split("id", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))
    cut = members.select("id", F.explode(prefixes).alias("owner"))
    return cut.join(owners.select(F.col("id").alias("owner")).distinct(), "owner").select("owner", "id")


def reference_check(rows: DataFrame, objects: DataFrame, ref: str) -> DataFrame:
    """How many references of each kind lead to a known object, and how many do not."""
    there = objects.select(F.col("id").alias(ref)).distinct().withColumn("__there", F.lit(1))
    both = rows.join(there, ref, "left")
    return both.groupBy("rel").agg(F.count("__there").alias("n_resolved"), F.count_if(F.col("__there").isNull()).alias("n_unresolved"))


def listed(objects: DataFrame, kind: str | None, limit: int, offset: int = 0) -> DataFrame:
    return paged(of_kind(objects, kind).select("id", "kind", "full_name_ru"), "full_name_ru", "id", limit=limit, offset=offset)


def written_edges(edges: DataFrame, nodes: DataFrame, known: list[str], order: str = "seq") -> DataFrame:
    """Edges as a merge leaves them: known types, both ends exist, and of equal (rel, src, dst) the last one."""
    ids = nodes.select("id").distinct()
    found = edges.filter(F.col("rel").isin(known)).join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    rest = [c for c in edges.columns if c not in ("rel", "src", "dst", order)]
    last = found.groupBy("rel", "src", "dst").agg(F.max_by(F.struct(order, *rest), order).alias("x"))
    return last.select("rel", "src", "dst", *[F.col(f"x.{c}").alias(c) for c in (order, *rest)])


def write_report(edges: DataFrame, nodes: DataFrame, known: list[str]) -> DataFrame:
    """(rel, sent, matched, created, dropped) of a write of edges."""
    ids = nodes.select("id").distinct()
    a, b = ids.withColumnsRenamed({"id": "src"}).withColumn("s", F.lit(1)), ids.withColumnsRenamed({"id": "dst"}).withColumn("d", F.lit(1))
    both = edges.join(a, "src", "left").join(b, "dst", "left")
    is_known = F.col("rel").isin(known)
    ok = is_known & F.col("s").isNotNull() & F.col("d").isNotNull()
    pairs = both.groupBy("rel", "src", "dst").agg(F.count(F.lit(1)).alias("sent"), F.count_if(ok).alias("matched"), F.count_if(~is_known).alias("dropped"))
    return pairs.groupBy("rel").agg(F.sum("sent").alias("sent"), F.sum("matched").alias("matched"), F.count_if(F.col("matched") > 0).alias("created"), F.sum("dropped").alias("dropped"))


_PAGE = "CAST(count(*) OVER () AS BIGINT) AS total"


def _paged_sql(columns: str, body: str, order: str, limit: int, offset: int = 0) -> str:
    end = limit + offset
    return f"""SELECT {columns}, total, total > {end} AS has_more, CASE WHEN total > {end} THEN {end} END AS next_offset
FROM (SELECT *, {_PAGE}, row_number() OVER (ORDER BY {order}) AS rn FROM ({body}) b) p WHERE rn > {offset} AND rn <= {end}"""


@query("F01", "SELECT id, kind, name, synonym FROM g_objects WHERE full_name_ru = 'Справочники.C7' ORDER BY id LIMIT 1", "g_objects")
def _(d):
    return lookup(d.g_objects, "Справочники.C7").select("id", "kind", "name", "synonym")


@query("F02", """SELECT coalesce(e.id, b.id) AS id, CASE WHEN e.id IS NOT NULL THEN 'exact' WHEN b.id IS NOT NULL THEN 'name' END AS "by"
FROM (SELECT min(id) AS id FROM g_callables WHERE id = 'U3.D5' OR full_name = 'U3.D5') e,
  (SELECT CASE WHEN count(*) = 1 THEN min(id) END AS id FROM g_callables WHERE name = 'U3.D5') b""", "g_callables")
def _(d):
    return resolved(d.g_callables, "U3.D5")


@query("F03", "SELECT id, kind FROM g_objects WHERE lower(kind_ru) = 'подсистема' OR lower(kind) = 'подсистема'", "g_objects")
def _(d):
    return of_kind(d.g_objects, "ПОДСИСТЕМА").select("id", "kind")


@query("F04", "SELECT kind, CAST(count(*) AS BIGINT) AS n FROM g_objects WHERE NOT list_contains(['Subsystem', 'Module'], kind) GROUP BY kind", "g_objects")
def _(d):
    labelled = d.g_objects.withColumn("labels", F.array("kind", F.lit("MetadataObject")))
    out = labelled.filter(~F.array_contains("labels", "Module") & ~F.array_contains("labels", "Subsystem"))
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("F05", """SELECT id, name, synonym FROM g_objects WHERE contains(lower(name), 'auto') OR contains(lower(synonym), 'auto')
OR contains(lower(full_name_ru), 'auto') OR contains(lower(full_name_eng), 'auto')""", "g_objects")
def _(d):
    return containing(d.g_objects, "AUTO").select("id", "name", "synonym")


@query("F06", """WITH RECURSIVE s AS (SELECT 'Subsystem.R2' AS id, 0 AS d UNION SELECT e.dst, s.d + 1 FROM s JOIN g_edges e ON e.src = s.id AND e.rel = 'PARENT_OF' WHERE s.d < 5)
SELECT o.id, o.kind FROM g_objects o WHERE o.id IN (SELECT e.dst FROM g_edges e JOIN s ON e.src = s.id WHERE e.rel = 'CONTAINS')""", "g_objects g_edges")
def _(d):
    return in_scope(d.g_objects, d.g_edges, "Subsystem.R2").select("id", "kind")


@query("J01", "SELECT id, section, role, type_kind, target FROM g_attributes WHERE parent = 'orders' AND name = 'l_partkey'", "g_attributes")
def _(d):
    return attribute_type(d.g_attributes, "orders", "l_partkey")


@query("J02", _paged_sql("root, section, attribute, role", "SELECT parent AS root, coalesce(section, '') AS section, name AS attribute, role FROM g_attributes WHERE target = 'nation'", "root, attribute, section", 200), "g_attributes")
def _(d):
    return referrers(d.g_attributes, "nation", limit=500)


@query("J03", """SELECT section, string_agg(name || ':' || role || ':' || type_kind, ',' ORDER BY pos) AS attributes FROM g_attributes WHERE parent = 'orders' GROUP BY section""", "g_attributes")
def _(d):
    return object_attributes(d.g_attributes, "orders")


@query("J04", _paged_sql("rel, other, kind", "SELECT e.rel, e.src AS other, o.kind FROM g_edges e JOIN g_objects o ON o.id = e.src WHERE e.dst = 'Catalog.C1'", "other, rel", 20), "g_objects g_edges")
def _(d):
    return references(d.g_edges, d.g_objects, "Catalog.C1", outgoing=False, limit=20)


@query("J04_out", _paged_sql("rel, other, kind", "SELECT e.rel, e.dst AS other, o.kind FROM g_edges e JOIN g_objects o ON o.id = e.dst WHERE e.src = 'Document.O1'", "other, rel", 3, 1), "g_objects g_edges")
def _(d):
    return references(d.g_edges, d.g_objects, "Document.O1", outgoing=True, limit=3, offset=1)


@query("J05", """SELECT o.id, o.kind, o.name, o.synonym, CAST(count(*) FILTER (WHERE src = 'Catalog.C1') AS BIGINT) AS n_out, CAST(count(*) FILTER (WHERE dst = 'Catalog.C1') AS BIGINT) AS n_in,
  array_to_string(list_sort(list(DISTINCT CASE WHEN src = 'Catalog.C1' THEN dst ELSE src END))[1:10], ',') AS preview,
  array_to_string(list_sort(list(DISTINCT src) FILTER (WHERE rel = 'CONTAINS')), ',') AS subsystems
FROM g_objects o, g_edges e WHERE o.id = 'Catalog.C1' AND (src = 'Catalog.C1' OR dst = 'Catalog.C1') GROUP BY o.id, o.kind, o.name, o.synonym""", "g_objects g_edges")
def _(d):
    return details(d.g_objects, d.g_edges, "Catalog.C1")


@query("J06", """SELECT o.id, o.synonym, CAST(count(e.dst) AS BIGINT) AS n_members FROM g_objects o LEFT JOIN g_edges e ON e.src = o.id AND e.rel = 'CONTAINS'
WHERE o.kind = 'Subsystem' GROUP BY o.id, o.synonym""", "g_objects g_edges")
def _(d):
    return subsystems(d.g_objects, d.g_edges)


@query("J07", _paged_sql("id, kind, name", "SELECT o.id, o.kind, o.name FROM g_edges e JOIN g_objects o ON o.id = e.dst WHERE e.rel = 'CONTAINS' AND e.src = 'Subsystem.N3'", "id", 25, 5), "g_objects g_edges")
def _(d):
    return subsystem_members(d.g_objects, d.g_edges, "Подсистемы.N3", limit=25, offset=5)


@query("J08", "SELECT src, via, access FROM g_operates WHERE dst = 'Catalog.C8' AND via = 'purchase' ORDER BY src, via, access LIMIT 500", "g_operates")
def _(d):
    return operating_on(d.g_operates, "Catalog.C8", "purchase", limit=9999)


@query("J09", """SELECT parent || '.' || coalesce(section, '') AS callable, string_agg(name, ', ' ORDER BY pos) AS params, CAST(count(*) AS BIGINT) AS n FROM g_attributes GROUP BY parent, section""", "g_attributes")
def _(d):
    params = d.g_attributes.withColumn("callable", F.concat_ws(".", "parent", F.coalesce("section", F.lit(""))))
    return signatures(params)


def signatures(params: DataFrame) -> DataFrame:
    """(callable, params, n): the parameters of each callable in their order."""
    listed_ = params.groupBy("callable").agg(F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("x"))
    return listed_.select("callable", F.array_join(F.col("x.name"), ", ").alias("params"), F.size("x").cast("long").alias("n"))


@query("J10", "SELECT id, kind, name FROM g_objects o WHERE kind <> 'Subsystem' AND NOT EXISTS (SELECT 1 FROM g_edges e WHERE e.rel = 'CONTAINS' AND e.dst = o.id)", "g_objects g_edges")
def _(d):
    return dead_objects(d.g_objects, d.g_edges)


@query("J11", "SELECT id, module_id FROM g_callables c WHERE NOT is_export AND name NOT IN ('D1', 'D30') AND NOT EXISTS (SELECT 1 FROM g_calls k WHERE k.dst = c.id)", "g_callables g_calls")
def _(d):
    return dead_callables(d.g_callables, d.g_calls, ["D1", "D30"])


@query("J12", "SELECT CAST(count(*) AS BIGINT) AS n_orphans FROM g_callables c WHERE NOT EXISTS (SELECT 1 FROM g_operates o WHERE o.src = c.id AND o.via = 'purchase')", "g_callables g_operates")
def _(d):
    owned = d.g_operates.filter("via = 'purchase'").select(F.col("src").alias("id"))
    return d.g_callables.join(owned, "id", "left_anti").agg(F.count(F.lit(1)).alias("n_orphans"))


@query("J13", """SELECT o_orderkey, o_custkey, c_custkey IS NOT NULL AS kept, CASE WHEN c_custkey IS NULL THEN 'no_owner' END AS reason
FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3) c ON c_custkey = o_custkey""")
def _(d):
    keys = d.customer.filter("c_nationkey <> 3").select(F.col("c_custkey").alias("o_custkey"))
    return split_by_match(d.orders.select("o_orderkey", "o_custkey"), keys, "o_custkey", "no_owner")


@query("J14", """SELECT parent AS from_table, coalesce(section, '') AS section, name AS attribute, target AS to_table FROM g_attributes
WHERE (parent = 'orders' AND target = 'part') OR (parent = 'part' AND target = 'orders')""", "g_attributes")
def _(d):
    return join_hints(d.g_attributes, "orders", "part")


@query("J15", "SELECT o.id AS owner, c.id FROM (SELECT DISTINCT module_id AS id FROM g_callables) o JOIN g_callables c ON c.id = o.id OR starts_with(c.id, o.id || '.')", "g_callables")
def _(d):
    return owned_by_prefix(d.g_callables.select(F.col("module_id").alias("id")), d.g_callables.select("id"))


@query("J18", """SELECT rel, CAST(count(o.id) AS BIGINT) AS n_resolved, CAST(count(*) - count(o.id) AS BIGINT) AS n_unresolved
FROM g_edges e LEFT JOIN (SELECT id FROM g_objects WHERE kind <> 'Enum') o ON o.id = e.dst GROUP BY rel""", "g_objects g_edges")
def _(d):
    return reference_check(d.g_edges, d.g_objects.filter("kind <> 'Enum'"), "dst")


@query("P02", _paged_sql("o_orderkey, o_totalprice", "SELECT o_orderkey, o_totalprice FROM orders", "o_totalprice DESC, o_orderkey", 20, 40))
def _(d):
    return paged(d.orders.select("o_orderkey", "o_totalprice"), F.desc("o_totalprice"), "o_orderkey", limit=20, offset=40)


@query("P05", _paged_sql("id, kind, full_name_ru", "SELECT id, kind, full_name_ru FROM g_objects WHERE kind = 'Catalog'", "full_name_ru, id", 50, 100), "g_objects")
def _(d):
    return listed(d.g_objects, "catalog", 50, 100)


@query("P04", """SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '... [' || (length(text) - 200) || ' more]' ELSE text END AS short,
  substr(text, 101, 50) AS part, length(text) > 150 AS has_more FROM documents""")
def _(d):
    part = window_of_text()
    return d.documents.select("doc_id", _truncated(), part["part"].alias("part"), part["has_more"].alias("has_more"))


def window_of_text() -> Column:
    from metaloom.operators.paging import window_of

    return window_of(F.col("text"), 100, 50)


def _truncated() -> Column:
    from metaloom.operators.paging import truncated

    return truncated(F.col("text"), 200).alias("short")




@query("K02", """SELECT rel, CAST(count(*) * 2 AS BIGINT) AS sent, CAST(sum(CASE WHEN rel <> 'OWNED_BY' AND ok THEN 2 ELSE 0 END) AS BIGINT) AS matched,
  CAST(sum(CASE WHEN rel <> 'OWNED_BY' AND ok THEN 1 ELSE 0 END) AS BIGINT) AS created, CAST(sum(CASE WHEN rel = 'OWNED_BY' THEN 2 ELSE 0 END) AS BIGINT) AS dropped
FROM (SELECT e.rel, (e.src IN (SELECT id FROM g_objects)) AND (e.dst IN (SELECT id FROM g_objects WHERE synonym <> 'AUTOMOBILE')) AS ok
  FROM g_edges e WHERE rel IN ('PARENT_OF', 'CONTAINS', 'OWNED_BY')) x GROUP BY rel""", "g_objects g_edges")
def _(d):
    sent = d.g_edges.filter("rel IN ('PARENT_OF', 'CONTAINS', 'OWNED_BY')").withColumn("line", F.explode(F.array(F.lit(1), F.lit(2))))
    nodes = d.g_objects.filter("synonym <> 'AUTOMOBILE' OR kind = 'Subsystem'").select("id")
    return write_report(sent, nodes, ["PARENT_OF", "CONTAINS"])


@query("K01", """SELECT rel, src, dst, 2 AS line FROM g_edges WHERE rel IN ('PARENT_OF', 'CONTAINS')""", "g_edges")
def _(d):
    sent = d.g_edges.filter("rel IN ('PARENT_OF', 'CONTAINS')").withColumn("seq", F.explode(F.array(F.lit(2), F.lit(1)))).withColumn("line", F.col("seq"))
    return written_edges(sent, d.g_objects, ["PARENT_OF", "CONTAINS"]).drop("seq")
