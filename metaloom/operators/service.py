"""The outer operators: guarded SQL, scopes, field pages, module paths, schedules, reports and journals."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.functions.tables import materialized
from metaloom.operators.incremental import change_plan, replaced_slice
from metaloom.operators.paging import page_params
from metaloom.operators.registry import query
from metaloom.operators.search import EXACT, FUZZY, FUZZY_LENGTH, PREFIX, fetch_size, query_words
from metaloom.plans import querylang as ql
from metaloom.sources.metadata_xml import FOLDERS

#: Words that begin statements which write (fixed values).
WRITES = "insert update delete merge drop create alter truncate grant revoke set use cache load".split()
MOST_ROWS = 200


def read_only(sql: str) -> str:
    """The statement, if it only reads; words are compared whole, so a column named dataset is no SET."""
    bare = re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S).strip().rstrip(";")
    words = re.findall(r"\w+", bare.lower())
    if not words or words[0] not in ("select", "with", "values", "from", "table") or ";" in bare or any(w in WRITES for w in words):
        raise ValueError("only a single reading statement is allowed")
    return sql.strip().rstrip(";")


def free_query(spark: SparkSession, sql: str, most: int = MOST_ROWS) -> DataFrame:
    """A reading statement over registered views, with at most so many rows."""
    return spark.sql(read_only(sql)).limit(most)


def scope_of(asked: str | None, default: str | None) -> tuple[str | None, str | None]:
    """(scope, note): what is asked for, else the default; a star means no scope."""
    if asked:
        return (None, "scope is switched off") if asked == "*" else (asked, None)
    return (default, f"the default scope {default} holds") if default and default != "*" else (None, None)


def fulltext_terms(text: str) -> list[tuple[str, str, float]]:
    """(word, match, weight) of a query: prefix, exact, and fuzzy for words of four letters."""
    return [(w, m, x) for w in query_words(text) for m, x in (("prefix", PREFIX), ("exact", EXACT), ("fuzzy", FUZZY)) if m != "fuzzy" or len(w) >= FUZZY_LENGTH]


def field_page(objects: DataFrame, fields: str, limit: int, offset: int = 0) -> DataFrame:
    """objects with one page of an array of fields and its total; 0 is all, over 500 is 500, below 0 is 50."""
    limit = 50 if limit < 0 else 500 if limit > 500 else limit
    page = F.slice(fields, offset + 1, limit) if limit else F.slice(fields, offset + 1, F.greatest(F.size(fields), F.lit(1)))
    return objects.withColumn("total", F.size(fields)).withColumn(fields, page)


#: Modules of an object by their file, modules of the configuration, and kinds of objects that have one module, which has the
#: object's id, by their folder (fixed values).
MODULES = ["ObjectModule", "ManagerModule", "RecordSetModule", "ValueManagerModule"]
CONFIGURATION = ["SessionModule", "ManagedApplicationModule", "OrdinaryApplicationModule", "ExternalConnectionModule"]
ONE_MODULE = {"CommonModules": "Ext/Module", "CommonForms": "Ext/Form/Module", "CommonCommands": "Ext/CommandModule", "HTTPServices": "Ext/Module", "WebServices": "Ext/Module"}


def _lookup(key: Column, values: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def module_of(path: Column) -> Column:
    """struct(id, kind, parent, role) of a source file by its path; null for others.

    Folder/Name/Ext/Module, forms and commands of an object, objects that are one module, and modules of the configuration
    itself, which an extension's prefix excludes.
    """
    bare = F.regexp_replace(path, r"^tests-extension/", "")
    top, name, rest = (F.regexp_extract(bare, r"^([^/]+)/([^/]+)/(.+)\.bsl$", k) for k in (1, 2, 3))
    kind, only = _lookup(top, FOLDERS), _lookup(top, ONE_MODULE)
    owner = F.concat_ws(".", kind, name)
    of = lambda id_, kind_, parent, role: F.struct(id_.alias("id"), kind_.alias("kind"), parent.alias("parent"), role.alias("role"))
    none, role = F.lit(None).cast("string"), F.regexp_extract(rest, "^Ext/([^/]+)$", 1)
    form, command = F.regexp_extract(rest, "^Forms/([^/]+)/Ext/Form/Module$", 1), F.regexp_extract(rest, "^Commands/([^/]+)/Ext/CommandModule$", 1)
    own = F.regexp_extract(path, r"^Ext/([^/]+)\.bsl$", 1)
    return (
        F.when(own.isin(CONFIGURATION), of(F.concat(F.lit("Configuration."), own), F.lit("ConfigurationModule"), none, own))
        .when(only.isNotNull(), F.when(rest == only, of(owner, kind, none, kind)))
        .when(kind.isNull(), None)
        .when(role.isin(MODULES), of(F.concat_ws(".", owner, role), role, owner, role))
        .when(form != "", of(F.concat(owner, F.lit(".Form."), form), F.lit("Form"), owner, F.lit("Form")))
        .when(command != "", of(F.concat(owner, F.lit(".Command."), command), F.lit("Command"), owner, F.lit("Command")))
    )


def schedule(text: str) -> tuple[str, int | None, int, int]:
    """(kind, weekday, hour, minute) of 'daily 03:00' or 'weekly mon 03:00'."""
    days = "sun mon tue wed thu fri sat".split()
    m = re.fullmatch(r"(?:(daily)|(weekly)\s+(\w{3}))\s+(\d{1,2}):(\d{2})", text.strip().lower())
    if not m or (m[2] and m[3] not in days) or int(m[4]) > 23 or int(m[5]) > 59:
        raise ValueError(f"no schedule: {text!r}")
    return ("daily", None, int(m[4]), int(m[5])) if m[1] else ("weekly", days.index(m[3]) + 1, int(m[4]), int(m[5]))


def markdown(rows: DataFrame, title: str) -> str:
    """A report of a small table, such as metrics by dataset."""
    data = rows.collect()
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " - |" * len(rows.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in data)]) + "\n"


def appended(rows: DataFrame, path: str) -> None:
    """Adds rows to a journal of JSON lines."""
    rows.write.mode("append").json(path)


def cleared(edges: DataFrame, nodes: DataFrame, labels: list[str], label: str = "kind") -> DataFrame:
    """edges without those that touch a node with one of the labels."""
    gone = nodes.filter(F.col(label).isin(labels)).select("id")
    return edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti").select("rel", "src", "dst")


def cleared_counts(edges: DataFrame, repeated: DataFrame, nodes: DataFrame, labels: list[str], label: str = "kind") -> DataFrame:
    """(rel, n): how many of the edges, and of the different ones of the repeated edges, touch no node with one of the labels.

    Edges move once, by src, which serves to make repeated ones one and to leave out those that begin at such a node; what
    is left is counted by (rel, dst) before it moves again.
    """
    gone = nodes.filter(F.col(label).isin(labels)).select("id")
    without = lambda df, end: df.join(gone.select(F.col("id").alias(end)).hint("shuffle_hash"), end, "left_anti")
    kept = without(repeated.repartition("src").distinct(), "src").select("rel", "dst").unionByName(without(edges, "src").select("rel", "dst"))
    ends = kept.groupBy("rel", "dst").agg(F.count(F.lit(1)).alias("n"))
    return without(ends, "dst").groupBy("rel").agg(F.sum("n").alias("n"))


def stored_fingerprints(digests: DataFrame, chunk: int = 5000) -> DataFrame:
    """(chunk, n, digest): owners' digests in groups of about chunk owners by hash, as they are stored."""
    groups = F.pmod(F.xxhash64("owner"), F.lit(max(1, -(-digests.count() // chunk)))).cast("int")
    return digests.groupBy(groups.alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "owner", "digest"))), "\n"), 256).alias("digest"))


def applied(edges: DataFrame, plan: DataFrame, new_edges: DataFrame, stored: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, digests) after a change plan: slices of removed and changed owners go before those of added and changed
    ones come, and the new digests are stored only with the edges."""
    slices = plan.select(F.col("owner").cast("string").alias("id"))
    out = materialized(replaced_slice(edges, slices, new_edges.join(slices.select(F.col("id").alias("src")), "src", "left_semi")), "edges")
    return out, materialized(current, "digests")


def reindex_decision(n: int, forced: bool, changed: bool, skip_if_any: bool) -> str:
    """Whether to build an index anew."""
    if forced or not n:
        return "full"
    return "skip" if skip_if_any or not changed else "full"


@query("F08", "SELECT c_mktsegment AS dataset, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY c_mktsegment")
def _(d):
    d.customer.createOrReplaceTempView("free_customer")
    return free_query(d.spark, "SELECT c_mktsegment AS dataset, count(*) AS n FROM free_customer /* UPDATE */ GROUP BY c_mktsegment")


@query("F09", "SELECT * FROM (VALUES ('заказ', 'prefix', 1e0), ('заказ', 'exact', 2e0), ('заказ', 'fuzzy', 0.5e0), ('до', 'prefix', 1e0), ('до', 'exact', 2e0)) AS t(word, match, weight)")
def _(d):
    return d.spark.createDataFrame(fulltext_terms("Заказ, до"), "word string, match string, weight double")


@query("P01", "SELECT * FROM (VALUES (0, 20), (500, 100), (7, 7)) AS t(asked, got)")
def _(d):
    return d.spark.createDataFrame([(a, page_params(a, -1)[0]) for a in (0, 500, 7)], "asked int, got int")


@query("P07", "SELECT parent, CAST(count(*) AS INT) AS total, array_to_string(list_sort(list(name))[2:3], ',') AS names FROM g_attributes GROUP BY parent", "g_attributes")
def _(d):
    fields = d.g_attributes.groupBy("parent").agg(F.array_sort(F.collect_list("name")).alias("names"))
    return field_page(fields, "names", 2, 1).select("parent", "total", F.array_join("names", ",").alias("names"))


#: Paths of all folders and shapes, dealt to documents, and what they are.
_FOLDER = sorted(FOLDERS) + ["Odd"]
_SHAPES = ["Ext/ObjectModule.bsl", "Ext/ManagerModule.bsl", "Ext/RecordSetModule.bsl", "Ext/ValueManagerModule.bsl", "Forms/F/Ext/Form/Module.bsl", "Commands/C/Ext/CommandModule.bsl", "Ext/Module.bsl", "Ext/Form/Module.bsl", "Ext/CommandModule.bsl", "Ext/Form.xml"]
_LONE = [f"Ext/{x}.bsl" for x in CONFIGURATION] + ["tests-extension/Ext/SessionModule.bsl", "Ext/Module.bsl", "Catalogs/X.bsl"]


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query("S10", f"""WITH p AS (SELECT doc_id, {_list(_FOLDER)}[doc_id % {len(_FOLDER)} + 1] AS folder, {_list([FOLDERS.get(x, "") for x in _FOLDER])}[doc_id % {len(_FOLDER)} + 1] AS kind,
  {_list(_SHAPES)}[(doc_id // {len(_FOLDER)}) % {len(_SHAPES)} + 1] AS shape, doc_id % 11 = 5 AS lone, {_list(_LONE)}[doc_id % {len(_LONE)} + 1] AS lone_path FROM documents),
m AS (SELECT doc_id, CASE
  WHEN lone THEN CASE WHEN lone_path IN ('Ext/SessionModule.bsl', 'Ext/ManagedApplicationModule.bsl', 'Ext/OrdinaryApplicationModule.bsl', 'Ext/ExternalConnectionModule.bsl')
    THEN ['Configuration.' || split_part(split_part(lone_path, '/', 2), '.', 1), 'ConfigurationModule', NULL, split_part(split_part(lone_path, '/', 2), '.', 1)] END
  WHEN folder IN ('CommonModules', 'HTTPServices', 'WebServices') THEN CASE WHEN shape = 'Ext/Module.bsl' THEN [kind || '.M' || doc_id, kind, NULL, kind] END
  WHEN folder = 'CommonForms' THEN CASE WHEN shape = 'Ext/Form/Module.bsl' THEN [kind || '.M' || doc_id, kind, NULL, kind] END
  WHEN folder = 'CommonCommands' THEN CASE WHEN shape = 'Ext/CommandModule.bsl' THEN [kind || '.M' || doc_id, kind, NULL, kind] END
  WHEN folder = 'Odd' THEN NULL
  WHEN shape LIKE 'Forms/%' THEN [kind || '.M' || doc_id || '.Form.F', 'Form', kind || '.M' || doc_id, 'Form']
  WHEN shape LIKE 'Commands/%' THEN [kind || '.M' || doc_id || '.Command.C', 'Command', kind || '.M' || doc_id, 'Command']
  WHEN shape LIKE 'Ext/%Module.bsl' AND shape NOT IN ('Ext/Module.bsl', 'Ext/Form/Module.bsl', 'Ext/CommandModule.bsl')
    THEN [kind || '.M' || doc_id || '.' || replace(shape[5:], '.bsl', ''), replace(shape[5:], '.bsl', ''), kind || '.M' || doc_id, replace(shape[5:], '.bsl', '')] END AS m FROM p)
SELECT doc_id, m[1] AS id, m[2] AS kind, m[3] AS parent, m[4] AS role FROM m""")
def _(d):
    pick = lambda values, k: F.get(F.array(*map(F.lit, values)), (k % len(values)).cast("int"))
    n = F.col("doc_id")
    path = F.concat(F.when(n % 2 == 1, "tests-extension/").otherwise(""), pick(_FOLDER, n), F.lit("/M"), n.cast("string"), F.lit("/"), pick(_SHAPES, F.floor(n / len(_FOLDER))))
    return d.documents.select("doc_id", module_of(F.when(n % 11 == 5, pick(_LONE, n)).otherwise(path)).alias("m")).select("doc_id", "m.*")


@query("X14", "SELECT * FROM (VALUES ('daily 03:00', 'daily', CAST(NULL AS INT), 3, 0), ('weekly mon 23:15', 'weekly', 2, 23, 15)) AS t(said, kind, weekday, hour, minute)")
def _(d):
    return d.spark.createDataFrame([(s, *schedule(s)) for s in ("daily 03:00", "weekly mon 23:15")], "said string, kind string, weekday int, hour int, minute int")


@query("X26", """SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM g_edges WHERE rel IN ('OWNED_BY', 'BASED_ON') GROUP BY 1, 2""", "g_edges")
def _(d):
    return claim_pairs(d.g_edges, ["OWNED_BY", "BASED_ON"])


def claim_pairs(edges: DataFrame, rels: list[str]) -> DataFrame:
    """Pairs of objects with an edge of some types, whatever its direction, each once."""
    return edges.filter(F.col("rel").isin(rels)).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


@query("K04", "SELECT rel, CAST(count(*) AS BIGINT) AS n FROM g_edges WHERE rel IN ('PARENT_OF', 'BASED_ON') OR (rel = 'CONTAINS' AND dst LIKE 'Catalog.S%') GROUP BY rel", "g_edges")
def _(d):
    kinds = d.g_objects.withColumn("kind", F.when(F.col("id").startswith("Catalog.C"), "Customer").otherwise(F.col("kind")))
    lines, edges = ["REGISTERS", "BASED_ON"], d.repeated("g_edges")  # a line of an order may repeat another's edge
    return cleared_counts(edges.filter(~F.col("rel").isin(lines)), edges.filter(F.col("rel").isin(lines)), kinds, ["Customer", "Enum"])


@query("K06")
def _(d):
    from metaloom.operators.incremental import digests

    return stored_fingerprints(digests(d.line_digests))


@query("U05", """SELECT CASE WHEN e.n IS NULL THEN 'gone' WHEN o.o_orderkey % 10 = 2 THEN 'rewritten' ELSE 'same' END AS state, CAST(count(*) AS BIGINT) AS n
FROM orders o LEFT JOIN (SELECT owner, count(*) AS n FROM line_digests WHERE owner % 10 <> 0 GROUP BY owner) e ON e.owner = o.o_orderkey GROUP BY 1""", "line_digests")
def _(d):
    """Old edges of owners that were stored, changed to those of the current ones by the plan."""
    from metaloom.operators.incremental import _versions

    now, was = _versions(d)
    edge = lambda keys, rel: keys.select(rel.alias("rel"), F.col("owner").cast("string").alias("src"), F.lit("x").alias("dst"))
    old = edge(was, F.lit("old"))
    new = edge(now, F.when(F.col("owner") % 10 == 2, "new").otherwise("old"))
    edges, _digests = applied(old, change_plan(now, was), new, was, now)
    both = d.orders.select(F.col("o_orderkey").cast("string").alias("src")).join(edges, "src", "left")
    state = F.when(F.col("rel").isNull(), "gone").when(F.col("rel") == "new", "rewritten").otherwise("same")
    return both.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("T13", "SELECT * FROM (VALUES (0, 'full'), (5, 'skip')) AS t(n, decision)")
def _(d):
    return d.spark.createDataFrame([(n, reindex_decision(n, False, False, True)) for n in (0, 5)], "n int, decision string")


@query("H05", "SELECT * FROM (VALUES (1, 11), (5, 15), (20, 60), (50, 100)) AS t(asked, fetched)")
def _(d):
    return d.spark.createDataFrame([(n, fetch_size(n)) for n in (1, 5, 20, 50)], "asked int, fetched int")


@query("Q10", "SELECT true AS valid, CAST(2 AS BIGINT) AS tables")
def _(d):
    from metaloom.operators.queries import catalog_of

    catalog = catalog_of(d.g_attributes)
    got = ql.check(ql.build(catalog, ["Справочник.orders", "Справочник.customer"]), catalog)
    return d.spark.createDataFrame([(got["valid"], got["tables_checked"])], "valid boolean, tables long")


@query("Q06", "SELECT parent, CAST(count(*) FILTER (WHERE section IS NULL) + 10 AS BIGINT) AS n FROM g_attributes GROUP BY parent", "g_attributes")
def _(d):
    from metaloom.operators.queries import catalog_of

    return d.spark.createDataFrame([(e.name, len(e.fields) + len(e.standard())) for e in catalog_of(d.g_attributes).by.values()], "parent string, n long")


def resolved_scope(asked: Column, default: Column) -> Column:
    """The scope of a request: what it asks for, else the default; a star is none.  A prefix of its kind is cut off."""
    asked, default = (F.trim(F.coalesce(x, F.lit(""))) for x in (asked, default))
    scope = F.when(asked == "*", "").when(asked != "", asked).otherwise(default)
    return F.regexp_replace(scope, r"(?iu)^(subsystem|подсистема|подсистемы)\.", "")


@query("F07", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_brand WHEN 1 THEN '' WHEN 2 THEN p_brand WHEN 3 THEN p_brand ELSE CASE WHEN p_size > 20 THEN '' ELSE 'N1' END END AS scope FROM part""")
def _(d):
    k = F.col("p_partkey") % 5
    asked = F.when(k == 0, F.concat(F.lit(" "), "p_brand", F.lit(" "))).when(k == 1, F.lit(" * ")).when(k == 2, F.concat(F.lit("Subsystem."), "p_brand")).when(k == 3, F.concat(F.lit("подсистемы."), "p_brand"))
    default = F.when(F.col("p_size") <= 20, F.lit("Подсистема.N1"))
    return d.part.select("p_partkey", resolved_scope(asked, default).alias("scope"))
