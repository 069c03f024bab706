"""Document checks: entity links, claims, validation, dictionaries, journals and datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.functions.text import comparable, sentences
from metaloom.operators.registry import query

#: What the text of a name looks like, and stems of verbs that claim a link (fixed values).
NAME = r"(?U)\b[\p{L}][\p{L}\d_]{2,}\.[\p{L}][\p{L}\d_]{2,}\b"
LINK_STEMS = "вызыва пишем пишет запис чита обновля формиру заполня использу движени".split()
STOP = "тел рис см т.е т.к стр п гл".split()


def candidates(statements: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, name, canon, known): names in the text of statements (id, text), by a dictionary (alias, canon).

    Without an entry, a name counts as unknown only if its first part is one that the dictionary knows.
    """
    found = statements.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(NAME), F.lit(0)))).alias("name"))
    found = found.withColumn("alias", F.lower("name")).withColumn("prefix", F.split_part("alias", F.lit("."), F.lit(1)))
    found = found.filter(~F.col("prefix").isin(STOP))
    prefixes = aliases.select(F.split_part(F.lower("alias"), F.lit("."), F.lit(1)).alias("prefix")).distinct().withColumn("known", F.lit(True))
    both = found.join(aliases.select(F.lower("alias").alias("alias"), "canon").distinct(), "alias", "left").join(prefixes, "prefix", "left")
    return both.filter("canon IS NOT NULL OR known").select("id", "name", "canon", F.col("canon").isNotNull().alias("known"))


def classified(statements: DataFrame, aliases: DataFrame, pairs: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, category): missing, unverifiable, contradicts or confirmed.

    A statement that claims a link contradicts if a name in it has no edge, in either direction, to a target.
    """
    c = candidates(statements, aliases)
    both_ways = pairs.select("src", "dst").union(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    linked = both_ways.join(targets.select(F.col("target").alias("src")), "src", "left_semi").select(F.col("dst").alias("canon")).distinct().withColumn("linked", F.lit(True))
    facts = c.join(linked, "canon", "left").groupBy("id").agg(F.count_if(~F.col("known")).alias("n_unknown"), F.count_if("known").alias("n_known"), F.count_if(F.col("known") & F.col("linked").isNull()).alias("n_apart"))
    claims = F.exists(F.array(*map(F.lit, LINK_STEMS)), lambda s: F.contains(F.lower("text"), s))
    out = statements.select("id", claims.alias("claims")).join(facts, "id", "left")
    category = F.when(F.col("n_unknown") > 0, "missing").when(F.coalesce("n_known", F.lit(0)) == 0, "unverifiable").when(F.col("claims") & (F.col("n_apart") > 0), "contradicts").otherwise("confirmed")
    return out.select("id", category.alias("category"))


def lost(statements: DataFrame, drafts: DataFrame) -> DataFrame:
    """Statements (page, id, text) that are not in their page's draft (page, draft), but for white space and case."""
    both = statements.join(drafts, "page", "left")
    return both.filter(~F.coalesce(F.contains(comparable(F.col("draft")), comparable(F.col("text"))), F.lit(False))).select("page", "id")


def verdict(ok: Column, unsupported: Column, n: Column, unverifiable: Column, disputed: Column) -> Column:
    return F.when(~ok, "postpone").when(unsupported > 0, "by hand").when((unverifiable == 0) & (n > 0), "outdated").when(disputed > 0, "review").otherwise("migrate")


def invalid(docs: DataFrame, kinds: list[str], least: int = 40) -> DataFrame:
    """(id, problem) of documents (id, type, title, body, publish): one row for each rule that is broken."""
    alone = [
        (F.col("id").isNull() | (F.col("id").cast("string") == ""), "no id"),
        (~F.coalesce(F.col("type").isin(kinds), F.lit(False)), "unknown type"),
        (F.char_length(F.trim(F.coalesce("body", F.lit("")))) < least, "short body"),
    ]
    each = docs.select("id", F.explode(F.filter(F.array(*[F.when(c, p) for c, p in alone]), lambda p: p.isNotNull())).alias("problem"))
    twice = lambda key, what: docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key, F.lit(what).alias("problem"))
    ids = twice("id", "repeated id")
    title = docs.filter("publish").select("id", F.lower("title").alias("t"))
    titles = title.join(title.groupBy("t").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "t").select("id", F.lit("repeated title").alias("problem"))
    return each.union(ids).union(titles)


def dictionary(objects: DataFrame) -> DataFrame:
    """(key, canon, collides) of three forms of each object's name, without case; the first in order of id wins."""
    forms = F.array(F.struct(F.lit(1).alias("form"), F.col("full_name_eng").alias("alias")), F.struct(F.lit(2).alias("form"), F.col("full_name_ru").alias("alias")), F.struct(F.lit(3).alias("form"), F.concat_ws(".", "kind_ru", "name").alias("alias")))
    each = objects.select("id", F.explode(forms).alias("x")).select(F.lower("x.alias").alias("key"), "id")
    return each.groupBy("key").agg(F.min("id").alias("canon"), (F.min("id") != F.max("id")).alias("collides"))


def forbidden(files: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(path, rule) of files (path, text) that match a named pattern."""
    hits = F.array(*[F.when(F.col("text").rlike(p), name) for name, p in sorted(patterns.items())])
    return files.select("path", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("rule"))


def parsed_journal(lines: DataFrame) -> DataFrame:
    """(state, tool, n) of JSON lines (value): calls, starts, and lines that are no JSON."""
    row = F.from_json("value", "ts string, tool string, event string, ms double", {"mode": "PERMISSIVE"})
    seen = lines.filter(F.trim("value") != "").select(row.alias("r"))
    state = F.when(F.col("r.ts").isNull(), "malformed").when(F.col("r.event") == "start", "start").otherwise("call")
    return seen.groupBy(state.alias("state"), F.col("r.tool").alias("tool")).agg(F.count(F.lit(1)).alias("n"))


def parsed_dataset(lines: DataFrame, known: list[str]) -> DataFrame:
    """(id, tool, n_hard, n_unknown) of dataset lines; blanks and // comments are none."""
    body = lines.filter(~F.trim("value").startswith("//") & (F.trim("value") != ""))
    row = F.from_json("value", "id string, tool string, expect struct<hard: array<struct<type: string>>>")
    hard = F.coalesce(F.col("r.expect.hard.type"), F.array().cast("array<string>"))
    return body.select(row.alias("r")).select("r.id", "r.tool", F.size(hard).alias("n_hard"), F.size(F.filter(hard, lambda t: ~t.isin(known))).alias("n_unknown"))


def affected(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(id, n) of documents (id, targets) with targets among some names; the arrays are exploded and joined by equality."""
    each = docs.select("id", F.explode("targets").alias("name")).distinct()
    return each.join(names.select("name").distinct(), "name").groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def _statements(d) -> DataFrame:
    """Statements about orders: some name an object, some a missing one, some claim a link."""
    k = F.col("o_orderkey")
    text = F.when(k % 4 == 0, F.concat(F.lit("Документ использует Catalog.C"), F.lpad(F.col("o_custkey").cast("string"), 8, "0"))).when(k % 4 == 1, F.concat(F.lit("Смотри Catalog.Zz"), k.cast("string"))).when(k % 4 == 2, F.concat(F.lit("Есть объект Catalog.C"), F.lpad(F.col("o_custkey").cast("string"), 8, "0"))).otherwise(F.lit("Здесь нет ничего, рис.Один тоже"))
    return d.orders.select(k.alias("id"), text.alias("text"))


def _aliases(d) -> DataFrame:
    name = F.concat(F.lit("Catalog.C"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))
    return d.customer.select(name.alias("alias"), F.concat(F.lit("Catalog.C"), F.col("c_custkey").cast("string")).alias("canon"))


@query("X17", """SELECT o_orderkey AS id, o_orderkey % 4 <> 1 AS known FROM orders WHERE o_orderkey % 4 <> 3""")
def _(d):
    return candidates(_statements(d), _aliases(d)).select("id", "known")


@query("X18", """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 1 THEN 'missing' WHEN 3 THEN 'unverifiable' WHEN 2 THEN 'confirmed'
ELSE CASE WHEN c_nationkey = 3 THEN 'confirmed' ELSE 'contradicts' END END AS category FROM orders JOIN customer ON c_custkey = o_custkey""")
def _(d):
    targets = d.spark.createDataFrame([("Subsystem.N3",)], "target string")
    return classified(_statements(d), _aliases(d), d.g_edges.filter("rel = 'CONTAINS'"), targets)


@query("X19", r"""SELECT doc_id, CAST(len(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+(\p{Lu})', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: length(s) >= 12)) AS INT) AS n FROM documents""")
def _(d):
    return d.documents.select("doc_id", F.size(sentences(F.col("text"))).alias("n"))


@query("X20", r"""SELECT doc_id AS page, doc_id AS id FROM documents WHERE doc_id % 3 = 0 AND trim(text) <> ''""")
def _(d):
    mine = d.documents.filter("trim(text) <> ''").select(F.col("doc_id").alias("page"), F.col("doc_id").alias("id"), "text")
    drafts = d.documents.select(F.col("doc_id").alias("page"), F.when(F.col("doc_id") % 3 == 0, "another text").otherwise(F.concat(F.lit("A. "), F.upper("text"), F.lit("  \n"))).alias("draft"))
    return lost(mine.filter("page % 3 = 0"), drafts)


@query("X21", """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'postpone' WHEN o_orderkey % 5 = 0 THEN 'by hand' WHEN o_orderkey % 3 = 0 THEN 'outdated' WHEN o_orderkey % 2 = 0 THEN 'review' ELSE 'migrate' END AS verdict FROM orders""")
def _(d):
    k = F.col("o_orderkey")
    return d.orders.select("o_orderkey", verdict(k % 7 != 0, (k % 5 == 0).cast("int"), F.lit(3), (k % 3 != 0).cast("int"), (k % 2 == 0).cast("int")).alias("verdict"))


@query("X22", """SELECT doc_id AS id, 'short body' AS problem FROM documents WHERE length(trim(text)) < 40 UNION ALL SELECT doc_id, 'unknown type' FROM documents WHERE lang = 'es'
UNION ALL SELECT doc_id, 'repeated title' FROM documents WHERE source = 'src3' AND lower(left(text, 20)) IN (SELECT lower(left(text, 20)) FROM documents WHERE source = 'src3' GROUP BY 1 HAVING count(*) > 1)""")
def _(d):
    docs = d.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("type"), F.substring("text", 1, 20).alias("title"), F.col("text").alias("body"), (F.col("source") == "src3").alias("publish"))
    return invalid(docs, ["en", "de", "fr"])


@query("X23", "SELECT parent, name, CASE type_kind WHEN 'String' THEN 'Строка' WHEN 'Number' THEN 'Число' WHEN 'Date' THEN 'Дата' ELSE 'СправочникСсылка.' || target END AS types FROM g_attributes", "g_attributes")
def _(d):
    return compat_types(d.g_attributes)


def compat_types(attributes: DataFrame) -> DataFrame:
    """(parent, name, types): an attribute's types by their Russian names, joined by '; '."""
    kind = F.col("type_kind")
    said = F.when(kind == "String", "Строка").when(kind == "Number", "Число").when(kind == "Date", "Дата").otherwise(F.concat(F.lit("СправочникСсылка."), "target"))
    return attributes.groupBy("parent", "name").agg(F.array_join(F.array_sort(F.collect_set(said)), "; ").alias("types"))


@query("X25", """SELECT key, min(id) AS canon, min(id) <> max(id) AS collides FROM (SELECT lower(full_name_eng) AS key, id FROM g_objects UNION ALL SELECT lower(full_name_ru), id FROM g_objects UNION ALL SELECT lower(kind_ru || '.' || name), id FROM g_objects) x GROUP BY key""", "g_objects")
def _(d):
    return dictionary(d.g_objects)


@query("X27", r"""SELECT doc_id AS path, 'mail' AS rule FROM documents WHERE regexp_matches(text, '[a-z0-9.]+@[a-z0-9.]+\.[a-z]{2,}') UNION ALL SELECT doc_id, 'number' FROM documents WHERE regexp_matches(text, '[0-9]{6,}')""")
def _(d):
    return forbidden(d.documents.select(F.col("doc_id").alias("path"), "text"), {"mail": r"[a-z0-9.]+@[a-z0-9.]+\.[a-z]{2,}", "number": "[0-9]{6,}"})


@query("X28", r"""SELECT coalesce(nullif(regexp_extract(text, '([A-Z][a-z]+)', 1), ''), 'none') AS tag, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1""")
def _(d):
    return d.documents.groupBy(F.coalesce(F.nullif(F.regexp_extract("text", "([A-Z][a-z]+)", 1), F.lit("")), F.lit("none")).alias("tag")).agg(F.count(F.lit(1)).alias("n"))


@query("S16", """SELECT CASE WHEN event_id % 50 = 0 THEN 'malformed' WHEN event_type = 'signup' THEN 'start' ELSE 'call' END AS state, CASE WHEN event_id % 50 = 0 THEN NULL ELSE event_type END AS tool, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2""")
def _(d):
    start = F.when(F.col("event_type") == "signup", "start")
    line = F.to_json(F.struct(F.col("ts").cast("string").alias("ts"), F.col("event_type").alias("tool"), start.alias("event"), F.col("value").alias("ms")))
    return parsed_journal(d.events.select(F.when(F.col("event_id") % 50 == 0, "{broken").otherwise(line).alias("value")))


@query("S17", """SELECT CAST(event_id AS VARCHAR) AS id, event_type AS tool, 2 AS n_hard, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS n_unknown FROM events WHERE event_id % 10 <> 0""")
def _(d):
    hard = F.array(F.struct(F.lit("non_empty").alias("type")), F.struct(F.when(F.col("event_id") % 2 == 0, "odd").otherwise("field_equals").alias("type")))
    line = F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("tool"), F.struct(hard.alias("hard")).alias("expect")))
    return parsed_dataset(d.events.select(F.when(F.col("event_id") % 10 == 0, "// none").otherwise(line).alias("value")), ["non_empty", "field_equals"])


@query("J16", """SELECT l_orderkey AS id, CAST(count(DISTINCT l_partkey) AS BIGINT) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10) GROUP BY l_orderkey""")
def _(d):
    docs = d.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_partkey").alias("targets"))
    return affected(docs, d.part.filter("p_size < 10").select(F.col("p_partkey").alias("name")))
