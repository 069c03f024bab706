"""Code analysis: parsed modules as rows, resolution of calls, and inference of parameter types to a fix-point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.functions import code
from metaloom.functions.tables import materialized, partitions, yielded
from metaloom.operators.incremental import AMBIGUOUS, merged_facts
from metaloom.operators.registry import query


def _mapped(modules: DataFrame, rows_of, schema: str) -> DataFrame:
    """Rows that a function of (module, text) yields; modules are dealt out by number, as their bytes say little of the work."""
    return yielded(modules.select("module", "text").repartition(partitions(modules), "module"), rows_of, schema)


def callables(modules: DataFrame) -> DataFrame:
    """A row for each procedure and function of modules (module, text)."""

    def rows(text):
        for c in code.parse_module(text)[0]:
            yield c.name, c.kind, c.export, c.directive, c.line_start, c.line_end, ", ".join(p.name for p in c.params)

    return _mapped(modules, rows, "module string, name string, kind string, is_export boolean, directive string, line_start int, line_end int, params string")


def call_sites(modules: DataFrame) -> DataFrame:
    """A row for each call, with the module it names (its own if none), and its arguments."""

    def rows(text):
        for c in code.parse_module(text)[0]:
            for module, method, line, column, args in code.calls(c):
                yield c.name, module, method, line, column, args

    return _mapped(modules, rows, "module string, caller string, module_ref string, method string, line int, col int, args array<string>")


def assignments(modules: DataFrame) -> DataFrame:
    def rows(text):
        for c in code.parse_module(text)[0]:
            for e in code.events(c):
                yield c.name, *e

    return _mapped(modules, rows, "module string, callable string, event string, variable string, value string")


def scopes(modules: DataFrame) -> DataFrame:
    def rows(text):
        for c in code.parse_module(text)[0]:
            for name in sorted(code.local_names(c)):
                yield c.name, name

    return _mapped(modules, rows, "module string, callable string, name string")


def inferred(modules: DataFrame) -> DataFrame:
    """Kinds of the variables of each callable, as its own assignments tell them."""

    def rows(text):
        found = code.parse_module(text)[0]
        returns = {c.name.lower(): k for c in found if (k := code.return_type(c, code.local_types(c, {}, {})))}
        for c in found:
            for name, (kind, sure) in sorted(code.local_types(c, returns, {}).items()):
                yield c.name, name, kind, sure

    return _mapped(modules, rows, "module string, callable string, name string, kind string, confidence double")


def masked_modules(modules: DataFrame) -> DataFrame:
    """Each text with strings and comments blanked."""
    return _mapped(modules, lambda t: [(code.masked(t or ""),)], "module string, masked string")


def resolved_calls(sites: DataFrame, known: DataFrame, builtins: list[str], plurals: list[str]) -> DataFrame:
    """(outcome, n) of sites (module, module_ref, method) by a cascade of rules, as joins with the known callables.

    Built-in functions and manager names are outside; then another module's export, then a callable of the own module.
    """
    low = lambda c: F.lower(F.col(c))
    s = sites.withColumn("ref", low("module_ref")).withColumn("m", low("method")).withColumn("own", low("module"))
    target = F.when(F.col("ref") == "", F.col("own")).otherwise(F.col("ref"))
    k = known.select(low("module").alias("k_module"), low("name").alias("k_name"), F.col("is_export").alias("k_export")).distinct()
    modules = known.select(low("module").alias("known_module")).distinct()
    both = s.withColumn("target", target).join(k, (F.col("target") == F.col("k_module")) & (F.col("m") == F.col("k_name")), "left")
    both = both.join(modules, F.col("target") == F.col("known_module"), "left")
    local = F.col("target") == F.col("own")
    outcome = (
        F.when((F.col("ref") == "") & F.col("m").isin(builtins), "builtin")
        .when(F.col("ref").isin(plurals), "manager")
        .when(F.col("k_name").isNotNull() & (local | F.col("k_export")), "resolved")
        .when(F.col("k_name").isNotNull(), "not_exported")
        .when(F.col("known_module").isNotNull(), "no_such_method")
        .otherwise("unknown_module")
    )
    return both.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def fixpoint(sites: DataFrame, most: int = 8, least_gain: float = 0.01) -> DataFrame:
    """(key, kind) of parameters: sites (caller, callee, seq, kind) pass a kind, or without one the caller's own kind.

    Each round joins the sites with the facts so far and merges them; kinds that differ become AMBIGUOUS and pass no
    further.  It ends when nothing changes, when a round after the first adds under one percent, or after eight rounds.
    """
    sites = materialized(sites.select("caller", "callee", "seq", "kind"), "sites")
    given = sites.filter("kind IS NOT NULL").select(F.col("callee").alias("key"), "kind", "seq", F.lit(1.0).alias("confidence"))
    facts = materialized(merged_facts(given), "facts")
    n = facts.count()
    for k in range(2, most + 1):
        known = facts.filter(F.col("kind") != AMBIGUOUS).select(F.col("key").alias("caller"), F.col("kind").alias("passed"), (F.col("confidence") - 0.1).alias("confidence"))
        moved = sites.filter("kind IS NULL").join(known, "caller").select(F.col("callee").alias("key"), F.col("passed").alias("kind"), "seq", "confidence")
        old = facts.select("key", "kind", F.lit(-1).cast("long").alias("seq"), "confidence")
        new = materialized(merged_facts(old.unionByName(moved)), "facts")
        changed = new.join(facts.select("key", F.col("kind").alias("was")), "key", "left").filter(~F.col("kind").eqNullSafe(F.col("was"))).count()
        facts, gain, n = new, new.count() - n, new.count()
        if not changed or (k > 2 and gain < least_gain * n and changed < least_gain * n):
            break
    return facts.select("key", "kind", F.round("confidence", 3).alias("confidence"))


def gap_kinds(sites: DataFrame, params: DataFrame, assigned: DataFrame) -> DataFrame:
    """(gap, n): why variables (callable, name) have no type: a parameter, an untyped assignment, or no assignment."""
    p = params.select("callable", "name").distinct().withColumn("p", F.lit(1))
    a = assigned.select("callable", "name").distinct().withColumn("a", F.lit(1))
    both = sites.join(p, ["callable", "name"], "left").join(a, ["callable", "name"], "left")
    gap = F.when(F.col("p") == 1, "param").when(F.col("a") == 1, "local_untyped_assign").otherwise("no_assignment")
    return both.groupBy(gap.alias("gap")).agg(F.count(F.lit(1)).alias("n"))


def sample_modules(callsites: DataFrame, args: Column | None = None) -> DataFrame:
    """Modules in source form that make the calls of a call-site table; some calls stand in strings and comments."""
    body = F.concat(F.lit("  "), "callee", F.lit("("), F.lit('1, "a,b", Ф(2, 3)') if args is None else args, F.lit("); // "), "callee", F.lit("()"))
    sites = callsites.filter("callee IS NOT NULL").select("module_id", "caller", "callee", "id")
    lines = sites.repartition(partitions(sites), "module_id").groupBy("module_id", "caller").agg(F.sort_array(F.collect_list(F.struct("id", body.alias("line")))).alias("x"))
    name = F.split_part("caller", F.lit("."), F.lit(2))
    text = F.concat(F.lit("&НаСервере\nПроцедура "), name, F.lit("(Знач А, Б = 5) Экспорт\n  К = Новый Массив;\n  Т = К;\n  С = Справочники.Товары.Найти(А);\n"), F.array_join(F.col("x.line"), "\n"), F.lit("\nКонецПроцедуры\n"))
    return lines.groupBy(F.col("module_id").alias("module")).agg(F.array_join(F.sort_array(F.collect_list(text)), "\n").alias("text"))


@query("C01")
def _(d):
    return masked_modules(sample_modules(d.g_callsites)).select("module", F.md5("masked").alias("masked"), F.char_length("masked").alias("n"))


@query("C02", """SELECT module_id AS module, split_part(caller, '.', 2) AS name, 'procedure' AS kind, true AS is_export, '&НаСервере' AS directive, 'А, Б' AS params, CAST(count(*) + 4 AS INT) AS lines
FROM g_callsites WHERE callee IS NOT NULL GROUP BY module_id, caller""", "g_callsites")
def _(d):
    return callables(sample_modules(d.g_callsites)).select("module", "name", "kind", "is_export", "directive", "params", (F.col("line_end") - F.col("line_start")).alias("lines"))


@query("C04", """SELECT module_id AS module, split_part(caller, '.', 2) AS caller, split_part(callee, '.', 1) AS module_ref, split_part(callee, '.', 2) AS method, CAST(count(*) AS BIGINT) AS n
FROM g_callsites WHERE callee IS NOT NULL GROUP BY 1, 2, 3, 4""", "g_callsites")
def _(d):
    found = call_sites(sample_modules(d.g_callsites)).filter("module_ref <> '' AND module_ref <> 'Товары'")
    return found.groupBy("module", "caller", "module_ref", "method").agg(F.count(F.lit(1)).alias("n"))


@query("C03", """SELECT '1 | "a,b" | Ф(2, 3)' AS args, CAST(count(*) AS BIGINT) AS n FROM g_callsites WHERE callee IS NOT NULL""", "g_callsites")
def _(d):
    found = call_sites(sample_modules(d.g_callsites)).filter("module_ref <> '' AND module_ref <> 'Товары'")
    return found.groupBy(F.array_join("args", " | ").alias("args")).agg(F.count(F.lit(1)).alias("n"))


@query("C05", """SELECT e AS event, v AS variable, w AS value, (SELECT CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT caller FROM g_callsites WHERE callee IS NOT NULL) c) AS n
FROM (VALUES ('new', 'К', 'Массив'), ('copy', 'Т', 'К'), ('manager', 'С', 'Catalog.Товары'), ('access', 'Найти', 'Catalog.Товары')) AS t(e, v, w)""", "g_callsites")
def _(d):
    return assignments(sample_modules(d.g_callsites)).groupBy("event", "variable", "value").agg(F.count(F.lit(1)).alias("n"))


@query("C06", """SELECT n AS name, (SELECT CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT caller FROM g_callsites WHERE callee IS NOT NULL) c) AS n FROM (VALUES ('а'), ('б'), ('к'), ('т'), ('с')) AS t(n)""", "g_callsites")
def _(d):
    return scopes(sample_modules(d.g_callsites)).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("C07", """SELECT n AS name, k AS kind, c AS confidence, (SELECT CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT caller FROM g_callsites WHERE callee IS NOT NULL) c) AS n
FROM (VALUES ('к', 'Массив', 0.95e0), ('т', 'Массив', 0.9e0), ('с', 'Catalog.Товары', 0.9e0)) AS t(n, k, c)""", "g_callsites")
def _(d):
    return inferred(sample_modules(d.g_callsites)).groupBy("name", "kind", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query("C09", """WITH k AS (SELECT DISTINCT module_id AS m, split_part(caller, '.', 2) AS n FROM g_callsites WHERE callee IS NOT NULL AND module_id <> 'U7'),
s AS (SELECT split_part(callee, '.', 1) AS m, split_part(callee, '.', 2) AS n FROM g_callsites WHERE callee IS NOT NULL)
SELECT CASE WHEN k.n IS NOT NULL THEN 'resolved' WHEN s.m IN (SELECT m FROM k) THEN 'no_such_method' ELSE 'unknown_module' END AS outcome, CAST(count(*) AS BIGINT) AS n
FROM s LEFT JOIN k ON k.m = s.m AND k.n = s.n GROUP BY 1""", "g_callsites")
def _(d):
    modules = sample_modules(d.g_callsites)
    sites = call_sites(modules).filter("module_ref <> '' AND module_ref <> 'Товары'")
    return resolved_calls(sites, callables(modules).filter("module <> 'U7'"), ["сообщить"], list(code.MANAGERS))


@query("C10", """WITH f AS (SELECT * FROM (VALUES (0, 'А', 'Number', 0.9e0), (0, 'Б', 'String', 0.9e0), (1, 'А', 'Массив', 0.85e0), (1, 'Б', 'Catalog.Товары', 0.8e0), (2, 'А', 'Структура', 0.9e0), (2, 'Б', 'Массив', 0.8e0)) AS t(m, param, kind, confidence))
SELECT split_part(callee, '.', 1) AS module, split_part(callee, '.', 2) AS name, param, kind, confidence, CAST(count(*) AS BIGINT) AS n
FROM g_callsites JOIN f ON id % 3 = m WHERE callee IN (SELECT caller FROM g_callsites WHERE callee IS NOT NULL) GROUP BY ALL""", "g_callsites")
def _(d):
    args = F.when(F.col("id") % 3 == 0, '1, "a,b", Ф(2, 3)').when(F.col("id") % 3 == 1, "К, С, 5").otherwise("Новый Структура(К), Т")
    modules = materialized(sample_modules(d.g_callsites, args), "modules")
    facts = argument_facts(typed_arguments(modules), callables(modules))
    return facts.groupBy("module", "name", "param", "kind", "confidence").agg(F.count(F.lit(1)).alias("n"))


def typed_arguments(modules: DataFrame) -> DataFrame:
    """A row for each argument whose type its callable tells: the call, the place, the kind and its confidence."""

    def rows(text):
        found = code.parse_module(text)[0]
        returns = {c.name.lower(): k for c in found if (k := code.return_type(c, code.local_types(c, {}, {})))}
        for c in found:
            types = code.local_types(c, returns, {})
            for module, method, line, column, args in code.calls(c):
                for position, arg in enumerate(args):
                    if known := code.type_of(arg, types):
                        yield c.name, module, method, line, column, position, *known

    return _mapped(modules, rows, "module string, caller string, module_ref string, method string, line int, col int, position int, kind string, confidence double")


def argument_facts(arguments: DataFrame, known: DataFrame) -> DataFrame:
    """(module, name, param, kind, confidence): what the arguments of resolved calls tell of the callees' parameters.

    A call resolves to a callable of its own module, or to an exported one of the module that it names.  Arguments go to
    parameters by place, those beyond the last one to none, and passing costs 0.1 of the confidence.
    """
    low = lambda c: F.lower(F.col(c))
    first = F.min_by(F.struct("module", "name", "is_export", "params"), "line_start").alias("x")
    k = known.groupBy(low("module").alias("to"), low("name").alias("called")).agg(first).select("to", "called", "x.*")
    k = k.select("to", "called", "module", "name", "is_export", F.posexplode(F.split("params", ", ")).alias("position", "param")).filter("param <> ''")
    own = low("module")
    a = arguments.select(own.alias("own"), F.when(F.col("module_ref") == "", own).otherwise(low("module_ref")).alias("to"), low("method").alias("called"), "position", "kind", "confidence")
    both = a.join(k, ["to", "called", "position"]).filter((F.col("to") == F.col("own")) | F.col("is_export"))
    return both.select("module", "name", "param", "kind", F.round(F.greatest(F.col("confidence") - 0.1, F.lit(0.0)), 3).alias("confidence"))


@query("C11", """SELECT 'Catalog.Товары' AS target, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT caller FROM g_callsites WHERE callee IS NOT NULL) c""", "g_callsites")
def _(d):
    found = assignments(sample_modules(d.g_callsites)).filter("event = 'access'")
    return found.select("module", "callable", F.col("value").alias("target")).distinct().groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@query("C13", """SELECT CASE WHEN event_id % 4 = 0 THEN 'param' WHEN event_id % 3 = 0 THEN 'local_untyped_assign' ELSE 'no_assignment' END AS gap, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1""")
def _(d):
    v = d.events.select(F.col("user_id").cast("string").alias("callable"), F.col("event_id").cast("string").alias("name"), "event_id")
    return gap_kinds(v, v.filter("event_id % 4 = 0"), v.filter("event_id % 3 = 0"))


@query("C14", """SELECT kind, target, CAST(count(*) AS BIGINT) AS n FROM (SELECT type_kind AS kind, target FROM g_attributes) x GROUP BY kind, target""", "g_attributes")
def _(d):
    return typed(d.g_attributes)


def typed(attributes: DataFrame) -> DataFrame:
    """The types that attributes have, each once, and how many have it; a null target is a value of its own."""
    return attributes.groupBy(F.col("type_kind").alias("kind"), "target").agg(F.count(F.lit(1)).alias("n"))


@query("C15", "SELECT parent, array_to_string(list_sort(list(DISTINCT lower(name))), ',') AS names FROM g_attributes GROUP BY parent", "g_attributes")
def _(d):
    return d.g_attributes.groupBy("parent").agg(F.array_join(F.array_sort(F.collect_set(F.lower("name"))), ",").alias("names"))


@query("G07")
def _(d):
    kind = F.when(F.col("line") % 3 == 0, F.col("reason"))
    return fixpoint(d.g_callsites.filter("callee IS NOT NULL").select("caller", "callee", F.col("id").alias("seq"), kind.alias("kind")))
