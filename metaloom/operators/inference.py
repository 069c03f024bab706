"""Types of parameters, variables and returned values across modules, as one least fix-point over flows of types.

Parsing gives rows; all the rest is joins.  A node is a parameter, a variable or the returned value of a callable.  Seeds
give nodes a kind: a constructor, a manager's object, a literal argument.  Flows pass a kind on, with a loss of
confidence: a copy, an argument to the parameter of the callable that the call resolves to, a variable to the value its
function returns, a returned value to the variable that a call assigns, in whatever module.  So types of parameters and
types of returned values feed each other.

Facts form a lattice: no kind, one kind with its highest confidence, AMBIGUOUS.  Two kinds that meet are AMBIGUOUS, which
stays and is passed on like a kind.  The least fix-point is unique, whatever the order of rounds, so it can be
maintained: when modules change, only what their rows had a part in is derived again.

Nodes and flows are dealt to parts of a bounded number of flows, by callable.  A round goes through all parts at once: each
takes what others have told it, passes on what that changes within itself until nothing changes (semi-naive), and tells other
parts of the changes once.  So rounds grow with the calls from part to part on a path, not with its steps, and small tables
take one.  Around a cycle confidence only falls, so rounds end.  Flows and seeds carry the module that they come from (the
derivation table).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metaloom.functions import code
from metaloom.functions.tables import materialized, partitions
from metaloom.operators.code import _mapped
from metaloom.operators.incremental import AMBIGUOUS
from metaloom.operators.registry import query

#: Confidence in hundredths, of a constructor, a manager's object and a literal, and what a step loses (fixed values).
CONSTRUCTED, MANAGED, LITERAL, COPIED, PASSED = 95, 90, 90, 5, 10
#: Flows in one part, on average.
PART = 250_000
#: Codes of no kind and of AMBIGUOUS; those of kinds are positive.
NONE, BOTH = 0, -1
#: Rows of a part: its flows, its facts, and what it is told; arrays as bytes.
PACKED = "part int, what string, a binary, b binary, c binary, d binary"
#: Most rows of a table that is sent to all tasks.
FEW = 50_000
IDENTIFIER = r"^[\p{L}_][\p{L}\p{N}_]*$"


def node(module: Column, callable_: Column, role: str, name: Column | None = None) -> Column:
    """The name of a node; names of the language have no case."""
    return F.lower(F.concat_ws("|", module, callable_, F.lit(role), F.lit("") if name is None else name))


def _parsed(modules: DataFrame) -> DataFrame:
    """(module, callable, what, seq, event, variable, value, args) of one pass over modules.

    what is "callable", with its parameters as args; "told", an assignment or a returned expression, in order; or "site", a
    call of method ``value`` of module ``variable``, its own if that is empty.
    """

    def rows(text):
        for c in code.parse_module(text)[0]:
            yield c.name, "callable", 0, "", "", "", [p.name for p in c.params]
            told = [e for e in code.events(c) if e[0] != "access"] + [("return", "", x) for x in code.returned(c)]
            for seq, e in enumerate(told):
                yield c.name, "told", seq, *e, None
            for module, method, _, _, args in code.calls(c):
                yield c.name, "site", 0, "", module, method, args

    return _mapped(modules, rows, "module string, callable string, what string, seq int, event string, variable string, value string, args array<string>")


def _side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A side of a join, sent to all tasks if its rows are few.  Files of names are small and many times as large in
    memory, so Spark, which goes by files, would gather at the driver what has no room there; rows are counted instead."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= FEW else df.hint("merge")


def flows(modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seeds, edges) of modules (module, text): seeds (owner, node, kind, sure) and edges (owner, src, dst, loss).

    The last assignment to a variable counts; a parameter that is never assigned is a variable with its own type.  A call
    without a module resolves to its own module, one with a module to that one; calls of unknown callables pass nothing.
    """
    parsed = materialized(_parsed(modules), "parsed")
    known = parsed.filter("what = 'callable'").select("module", F.col("callable").alias("name"), F.col("args").alias("params"))
    told = parsed.filter("what = 'told'").select("module", "callable", "seq", "event", "variable", "value")
    last = told.filter("event <> 'return'").groupBy("module", "callable", F.lower("variable").alias("variable")).agg(F.max_by(F.struct("event", "value"), "seq").alias("x"))
    last = last.select("module", "callable", "variable", "x.*")
    given = last.unionByName(told.filter("event = 'return'").select("module", "callable", F.lit("").alias("variable"), F.lit("return").alias("event"), "value"))
    here = lambda role, name=None: node(F.col("module"), F.col("callable"), role, name)
    target = F.when(F.col("event") == "return", here("return")).otherwise(here("var", F.col("variable")))
    given = given.withColumn("node", target)
    new = rf"(?iu)^(?:{'|'.join(code.NEW)})\s+([\p{{L}}_][\p{{L}}\p{{N}}_]*)"
    built = F.when(F.col("event") == "new", F.col("value")).when(F.col("event") == "return", F.nullif(F.regexp_extract("value", new, 1), F.lit("")))
    seeds = given.select(F.col("module").alias("owner"), "node", F.when(F.col("event") == "manager", F.col("value")).otherwise(built).alias("kind"), F.when(F.col("event") == "manager", MANAGED).otherwise(CONSTRUCTED).alias("sure"))
    copied = given.filter(F.col("event").isin("copy", "return") & F.col("value").rlike(IDENTIFIER))
    edges = copied.select(F.col("module").alias("owner"), here("var", F.col("value")).alias("src"), F.col("node").alias("dst"), F.lit(COPIED).alias("loss"))
    callee = _side(known).select(F.lower("module").alias("to"), F.lower("name").alias("name"), F.col("module").alias("to_module"), F.col("name").alias("to_name"), "params")
    said = F.when(F.col("event") == "call", F.col("value")).otherwise(F.regexp_extract("value", r"^([\p{L}\p{N}_]+(?:\.[\p{L}\p{N}_]+)?)\s*\(", 1))
    called = given.filter("event IN ('call', 'return')").withColumn("said", F.lower(said)).filter("said <> ''")
    called = called.withColumn("to", F.when(F.col("said").contains("."), F.split_part("said", F.lit("."), F.lit(1))).otherwise(F.lower("module"))).withColumn("name", F.split_part("said", F.lit("."), F.lit(-1)))
    called = called.join(callee, ["to", "name"])
    edges = edges.unionByName(called.select(F.col("module").alias("owner"), node(F.col("to_module"), F.col("to_name"), "return").alias("src"), F.col("node").alias("dst"), F.lit(COPIED).alias("loss")))
    own = known.select("module", F.col("name").alias("callable"), F.explode("params").alias("param")).withColumn("variable", F.lower("param")).join(last.select("module", "callable", "variable").hint("merge"), ["module", "callable", "variable"], "left_anti")
    edges = edges.unionByName(own.select(F.col("module").alias("owner"), here("param", F.col("variable")).alias("src"), here("var", F.col("variable")).alias("dst"), F.lit(0).alias("loss")))
    sites = parsed.filter("what = 'site'").select("module", "callable", F.lower(F.when(F.col("variable") == "", F.col("module")).otherwise(F.col("variable"))).alias("to"), F.lower("value").alias("name"), F.posexplode("args").alias("position", "arg"))
    sites = sites.join(callee, ["to", "name"]).filter(F.col("position") < F.size("params"))
    sites = sites.withColumn("node", node(F.col("to_module"), F.col("to_name"), "param", F.get("params", F.col("position")))).withColumn("arg", F.trim("arg"))
    literal = F.when(F.col("arg").rlike(r"^\d+(\.\d+)?$"), "Number").when(F.col("arg").startswith('"'), "String").when(F.col("arg").startswith("'"), "Date").when(F.lower("arg").isin("истина", "ложь", "true", "false"), "Boolean")
    seeds = seeds.unionByName(sites.select(F.col("module").alias("owner"), "node", literal.alias("kind"), F.lit(LITERAL).alias("sure")))
    passed = sites.filter(literal.isNull() & F.col("arg").rlike(IDENTIFIER))
    edges = edges.unionByName(passed.select(F.col("module").alias("owner"), here("var", F.col("arg")).alias("src"), F.col("node").alias("dst"), F.lit(PASSED).alias("loss")))
    return materialized(seeds.filter("kind IS NOT NULL").distinct(), "seeds"), materialized(edges.distinct(), "flows")


def joined(facts: DataFrame) -> DataFrame:
    """(node, kind, sure): the least upper bound of the facts of each node; AMBIGUOUS has no confidence."""
    by = facts.groupBy("node").agg(F.min("kind").alias("a"), F.max("kind").alias("b"), F.max("sure").alias("c"))
    kind = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(AMBIGUOUS)
    return by.select("node", kind.alias("kind"), F.when(kind != AMBIGUOUS, F.col("c")).alias("sure"))


def _passed(edges: DataFrame, facts: DataFrame, rows: int | None = None) -> DataFrame:
    """What flows pass on of facts."""
    return edges.select("src", "dst", "loss").join(_side(facts.withColumnRenamed("node", "src"), rows), "src").select(F.col("dst").alias("node"), "kind", F.greatest(F.col("sure") - F.col("loss"), F.lit(0)).alias("sure"))


def _raised(kind: np.ndarray, sure: np.ndarray, at: np.ndarray, kinds: np.ndarray, sures: np.ndarray) -> np.ndarray:
    """Joins facts of nodes ``at`` into the arrays of all nodes; the nodes that this changes."""
    if not len(at):
        return at
    order = np.argsort(at, kind="stable")
    at, kinds, sures = at[order], kinds[order], sures[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    node, low, high, top = at[first], np.minimum.reduceat(kinds, first), np.maximum.reduceat(kinds, first), np.maximum.reduceat(sures, first)
    was, had = kind[node] != NONE, (kind[node], sure[node])
    low, high, top = np.where(was, np.minimum(low, had[0]), low), np.where(was, np.maximum(high, had[0]), high), np.where(was, np.maximum(top, had[1]), top)
    now = np.where(low == high, low, BOTH)
    top = np.where(now == BOTH, 0, top)
    changed = (now != had[0]) | (top != had[1])
    kind[node], sure[node] = now, top
    return node[changed]


def _out_of(starts: np.ndarray, front: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the flows that leave some nodes, and their nodes."""
    n = starts[front + 1] - starts[front]
    return np.repeat(starts[front] - np.cumsum(n) + n, n) + np.arange(n.sum()), np.repeat(front, n)


def _packed(rows: pd.DataFrame) -> pd.DataFrame:
    """The rows of a part: its flows by source, its facts, and what it is told first."""
    part, of = int(rows["part"].iloc[0]), {what: x for what, x in rows.groupby("what")}
    n, none = int(of["size"]["a"].iloc[0]), rows.iloc[:0]
    ints = lambda x, c, kind=np.int64: x[c].to_numpy(kind)
    edges = of.get("edges", none).sort_values("a", kind="stable")
    starts = np.r_[0, np.cumsum(np.bincount(ints(edges, "a"), minlength=n))].astype(np.int64)
    out = [(part, "edges", starts.tobytes(), ints(edges, "b", np.int32).tobytes(), ints(edges, "c").tobytes(), ints(edges, "d").tobytes())]
    kind, sure = np.zeros(n, np.int64), np.zeros(n, np.int64)
    known, told = of.get("state", none), of.get("told", none)
    kind[ints(known, "a")], sure[ints(known, "a")] = ints(known, "b"), ints(known, "d")
    out.append((part, "state", kind.tobytes(), sure.tobytes(), None, None))
    out.append((part, "told", ints(told, "a").tobytes(), ints(told, "b").tobytes(), ints(told, "d").tobytes(), None))
    return pd.DataFrame(out, columns=["part", "what", "a", "b", "c", "d"])


def _stepped(rows: pd.DataFrame) -> pd.DataFrame:
    """The facts of a part when all that it is told has been passed on within it, and what it tells other parts."""
    part, of = int(rows["part"].iloc[0]), {what: x for what, x in rows.groupby("what")}
    ints = lambda x, kind=np.int64: np.frombuffer(x, kind)
    state, edges = of["state"].iloc[0], of["edges"].iloc[0]
    kind, sure, out = ints(state["a"]).copy(), ints(state["b"]).copy(), []
    if "told" in of:
        starts, to_part, to, loss = ints(edges["a"]), ints(edges["b"], np.int32), ints(edges["c"]), ints(edges["d"])
        moved = np.zeros(len(kind), bool)
        front = _raised(kind, sure, *(np.concatenate([ints(x) for x in of["told"][c]]) for c in "abc"))
        while len(front):
            moved[front] = True
            e, src = _out_of(starts, front)
            e, src = e[to_part[e] == part], src[to_part[e] == part]
            front = _raised(kind, sure, to[e], kind[src], np.maximum(sure[src] - loss[e], 0))
        e, src = _out_of(starts, np.flatnonzero(moved))
        e, src = e[to_part[e] != part], src[to_part[e] != part]
        for p in np.unique(to_part[e]):
            mine = to_part[e] == p
            x, y = e[mine], src[mine]
            nodes, place = np.unique(to[x], return_inverse=True)
            kinds, sures = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
            _raised(kinds, sures, place, kind[y], np.maximum(sure[y] - loss[x], 0))
            out.append((int(p), "told", nodes.tobytes(), kinds.tobytes(), sures.tobytes(), None))
    out.append((part, "state", kind.tobytes(), sure.tobytes(), None, None))
    return pd.DataFrame(out, columns=["part", "what", "a", "b", "c", "d"])


def _facts_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The facts in the rows of parts."""
    for rows in batches:
        for part, a, b in zip(rows["part"], rows["a"], rows["b"], strict=True):
            kind, sure = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
            at = np.flatnonzero(kind != NONE)
            for k in range(0, len(at), PART):
                x = at[k : k + PART]
                yield pd.DataFrame({"part": np.full(len(x), part, np.int32), "at": x, "code": kind[x], "sure": sure[x].astype(np.int32)})


def _closed(known: DataFrame | None, more: DataFrame, edges: DataFrame) -> DataFrame:
    """The least facts with those known, which are closed but for ``more``, under the flows."""
    facts = materialized(joined(more), "told").withColumn("what", F.lit("told"))
    facts = facts if known is None else facts.unionByName(known.select("node", "kind", "sure", F.lit("state").alias("what")))
    parts = -(-edges.count() // PART) or 1
    part = F.pmod(F.xxhash64(F.substring_index("node", "|", 2)), F.lit(parts)).cast("int")
    nodes = facts.select("node").union(edges.select("src")).union(edges.select("dst")).distinct().withColumn("part", part)
    nodes = materialized(nodes.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("node")).cast("long") - 1), "nodes")
    n = nodes.count()
    kinds = materialized(facts.select("kind").filter(F.col("kind") != AMBIGUOUS).distinct().withColumn("code", F.monotonically_increasing_id() + 1), "kinds")
    n_kinds = kinds.count()
    end = lambda x: nodes.select(F.col("node").alias(x), F.col("part").alias(f"{x}_part"), F.col("at").alias(f"{x}_at"))
    row = lambda what, *x: [F.col("part"), what.alias("what"), *(F.col(v).cast("long").alias(c) if isinstance(v, str) else F.lit(0).cast("long").alias(c) for c, v in zip("abcd", x, strict=True))]
    ends = edges.select("src", "dst", "loss").join(_side(end("src"), n), "src").join(_side(end("dst"), n), "dst").withColumn("part", F.col("src_part"))
    coded = facts.join(_side(nodes, n), "node").join(_side(kinds, n_kinds), "kind", "left").withColumn("code", F.coalesce("code", F.lit(BOTH))).withColumn("sure", F.coalesce("sure", F.lit(0)))
    rows = nodes.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(*row(F.lit("size"), "n", 0, 0, 0))
    rows = rows.union(ends.select(*row(F.lit("edges"), "src_at", "dst_part", "dst_at", "loss"))).union(coded.select(*row(F.col("what"), "at", "code", 0, "sure")))
    now = packed = materialized(rows.groupBy("part").applyInPandas(_packed, PACKED), "parts")
    told = True
    while told:
        both = packed.filter("what = 'edges'").union(now.filter("what <> 'edges'"))
        now = materialized(both.groupBy("part").applyInPandas(_stepped, PACKED), "round")
        told = not now.filter("what = 'told'").isEmpty()
    found = now.filter("what = 'state'").select("part", "a", "b").mapInPandas(_facts_of, "part int, at long, code long, sure int")
    found = found.join(_side(nodes, n), ["part", "at"]).join(_side(kinds, n_kinds), "code", "left")
    return materialized(found.select("node", F.coalesce("kind", F.lit(AMBIGUOUS)).alias("kind"), F.when(F.col("kind").isNotNull(), F.col("sure")).alias("sure")), "facts")


def _reached(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): start, and all to which flows lead from there."""
    return _closed(None, start.select("node", F.lit("reached").alias("kind"), F.lit(0).alias("sure")), edges.select("src", "dst", F.lit(0).alias("loss"))).select("node")


def inferred_types(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, kind, sure): the least fix-point of seeds and flows."""
    return _closed(None, seeds.select("node", "kind", "sure"), edges)


def maintained(facts: DataFrame, seeds: DataFrame, edges: DataFrame, changed: DataFrame, new_seeds: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(facts, seeds, edges, touched) after the modules in ``changed`` (owner) have other seeds and flows, or none.

    Delete and rederive: facts that a removed row has passed to, and all that flows on from them, are taken back; then what
    is left of the seeds and flows, and the new ones, give those nodes their facts again.  ``touched`` has the nodes that
    were taken back; no other fact is read but where a flow leads from it to one of them.
    """
    changed = _side(changed)
    gone_seeds, gone_edges = seeds.join(changed, "owner", "left_semi"), edges.join(changed, "owner", "left_semi")
    start = gone_seeds.select("node").union(gone_edges.join(_side(facts.select(F.col("node").alias("src"))), "src", "left_semi").select(F.col("dst").alias("node"))).distinct()
    taken = _reached(start, edges)
    total = taken.count()
    seeds = materialized(seeds.join(changed, "owner", "left_anti").unionByName(new_seeds), "seeds")
    edges = materialized(edges.join(changed, "owner", "left_anti").unionByName(new_edges), "flows")
    base = materialized(facts.join(_side(taken, total), "node", "left_anti"), "facts")
    into = edges.join(_side(taken.withColumnRenamed("node", "dst"), total), "dst", "left_semi").select("src", "dst", "loss").unionByName(new_edges.select("src", "dst", "loss"))
    again = seeds.join(_side(taken, total), "node", "left_semi").unionByName(new_seeds).select("node", "kind", "sure")
    return _closed(base, again.unionByName(_passed(into, base)), edges), seeds, edges, taken


def typed_modules(callsites: DataFrame) -> DataFrame:
    """Modules in source form that pass values along the calls of a call-site table, as parameters and as returned values."""
    sites = callsites.filter("callee IS NOT NULL")
    of = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v for v in x))
    i, to, what = F.col("id").cast("string"), F.col("callee"), F.col("reason")
    m = F.col("line") % 12
    line = F.when(m == 0, of("  Р", i, " = ", to, "(А, Б); Возврат Р", i, ";")).when(m == 1, of("  ", to, "(А, Б);")).when(m == 3, of("  Возврат А;"))
    line = line.when(m == 4, of("  К", i, " = Новый ", what, "; ", to, "(К", i, ", А);")).when(m == 5, of("  ", to, "(Б, 17);")).otherwise(of("  // ", to, "(К, 5);"))
    lines = sites.repartition(partitions(sites), "module_id").groupBy("module_id", "caller").agg(F.sort_array(F.collect_list(F.struct("id", line.alias("line")))).alias("x"))
    text = of("Функция ", F.split_part("caller", F.lit("."), F.lit(2)), "(А, Б) Экспорт\n", F.array_join(F.col("x.line"), "\n"), "\nКонецФункции\n")
    return lines.groupBy(F.col("module_id").alias("module")).agg(F.array_join(F.sort_array(F.collect_list(text)), "\n").alias("text"))


#: Flows of typed_modules from its call-site table, and every kind that reaches a node along them.
TYPES_SQL = """WITH RECURSIVE s AS (SELECT *, line % 12 AS m, lower(replace(caller, '.', '|')) AS c, lower(replace(callee, '.', '|')) AS t, callee IN (SELECT caller FROM g_callsites WHERE callee IS NOT NULL) AS known
  FROM g_callsites WHERE callee IS NOT NULL),
f AS (SELECT c || '|param|' || p AS src, c || '|var|' || p AS dst, 0 AS loss FROM (SELECT DISTINCT c FROM s) x, (VALUES ('а'), ('б')) AS v(p)
  UNION ALL SELECT c || '|var|к' || id, t || '|param|а', 10 FROM s WHERE m = 4 AND known
  UNION ALL SELECT c || '|var|а', t || '|param|б', 10 FROM s WHERE m = 4 AND known
  UNION ALL SELECT c || '|var|б', t || '|param|а', 10 FROM s WHERE m = 5 AND known
  UNION ALL SELECT c || '|var|' || p, t || '|param|' || p, 10 FROM s, (VALUES ('а'), ('б')) AS v(p) WHERE m < 2 AND known
  UNION ALL SELECT t || '|return|', c || '|var|р' || id, 5 FROM s WHERE m = 0 AND known
  UNION ALL SELECT c || '|var|р' || id, c || '|return|', 5 FROM s WHERE m = 0
  UNION ALL SELECT c || '|var|а', c || '|return|', 5 FROM s WHERE m = 3),
reached AS (
  SELECT c || '|var|к' || id AS node, reason AS kind, 95 AS sure FROM s WHERE m = 4
  UNION SELECT t || '|param|б', 'Number', 90 FROM s WHERE m = 5 AND known
  UNION SELECT f.dst, r.kind, greatest(r.sure - f.loss, 0) FROM reached r JOIN f ON f.src = r.node)
SELECT node, CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) ELSE 'AMBIGUOUS' END AS kind, CAST(CASE WHEN count(DISTINCT kind) = 1 THEN max(sure) END AS INT) AS sure FROM reached GROUP BY node"""


@query("C08", TYPES_SQL, "g_callsites")
def _(d):
    return inferred_types(*flows(typed_modules(d.g_callsites)))


@query("T14", TYPES_SQL, "g_callsites")
def _(d):
    """A tenth of the modules was other at first, a tenth is new: brought up to date, all facts are those of a rebuild."""
    modules = materialized(typed_modules(d.g_callsites), "modules")
    part = F.pmod(F.xxhash64("module"), F.lit(10))
    before = modules.filter(part != 1).withColumn("text", F.when(part == 0, F.replace("text", F.lit("(А, Б);"), F.lit("(Б, А);"))).otherwise(F.col("text")))
    # Flows lead to callables of other modules, so the rows of a module are those it has beside all modules.
    seeds, edges = flows(before)
    new_seeds, new_edges = flows(modules)
    differs = lambda a, b: a.exceptAll(b).unionByName(b.exceptAll(a)).select("owner")
    changed = materialized(differs(seeds, new_seeds).union(differs(edges, new_edges)).distinct(), "changed-modules")
    facts = inferred_types(seeds, edges)
    few = _side(changed)
    return maintained(facts, seeds, edges, changed, new_seeds.join(few, "owner", "left_semi"), new_edges.join(few, "owner", "left_semi"))[0]
