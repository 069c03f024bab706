"""The query-language front end over tables of query texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.functions.tables import partitions, yielded
from metaloom.operators.registry import query
from metaloom.plans import querylang as ql


def _mapped(texts: DataFrame, rows_of, schema: str) -> DataFrame:
    """Rows that a function of each text yields; ids and texts are small beside the work, so they are dealt out by number."""
    return yielded(texts.select("id", "text").repartition(partitions(texts), "id"), rows_of, schema)


def checked(texts: DataFrame, catalog: ql.Catalog) -> DataFrame:
    """(id, valid, n_errors, n_warnings, tables, fields, statements) of texts (id, text)."""

    def rows(text):
        r = ql.check(text, catalog)
        yield r["valid"], len(r["errors"]), len(r["warnings"]), r["tables_checked"], r["fields_checked"], r["statements"]

    return _mapped(texts, rows, "id long, valid boolean, n_errors long, n_warnings long, tables long, fields long, statements long")


def advised(texts: DataFrame) -> DataFrame:
    return _mapped(texts, ql.advise, "id long, priority string, rule string")


def tokens(texts: DataFrame) -> DataFrame:
    return _mapped(texts, lambda text: ((t.kind, t.text, t.line) for t in ql.tokenize(text)), "id long, kind string, token string, line int")


def sources(texts: DataFrame) -> DataFrame:
    """(id, source, alias, joined) of all sources of all parts."""

    def rows(text):
        return ((s.text, s.alias, s.join) for st in ql.parse(text).statements for p in st.parts for s in p.sources)

    return _mapped(texts, rows, "id long, source string, alias string, joined string")


def temp_columns(texts: DataFrame) -> DataFrame:
    """(id, name, columns) of the temporary tables that a text makes; null columns can't be told."""

    def rows(text):
        return ((st.into, None if (c := st.columns()) is None else ",".join(c)) for st in ql.parse(text).statements if st.into)

    return _mapped(texts, rows, "id long, name string, columns string")


def catalog_of(attributes: DataFrame) -> ql.Catalog:
    """A catalogue from attribute rows; it holds object definitions, of which there are as many as tables."""
    entries: dict[str, ql.Entry] = {}
    for r in attributes.orderBy("parent", "pos").collect():
        e = entries.setdefault(r["parent"], ql.Entry("Справочник", r["parent"]))
        f = (r["name"], r["role"], [f"Справочник.{r['target']}"] if r["target"] else [])
        (e.sections.setdefault(r["section"], []) if r["section"] else e.fields).append(f)
    return ql.Catalog(list(entries.values()))


def sample_texts(orders: DataFrame) -> DataFrame:
    """Query texts made of orders: every seventh names a wrong field, every eleventh a wrong table, every fifth sorts."""
    key = F.col("o_orderkey")
    name = F.when(key % 7 == 0, "o_custky").otherwise("o_custkey")
    table = F.when(key % 11 == 0, "ordrs").otherwise("orders")
    tail = F.when(key % 5 == 0, " УПОРЯДОЧИТЬ ПО Т.o_totalprice").otherwise("")
    text = F.concat(F.lit("// "), key.cast("string"), F.lit("\nВЫБРАТЬ Т."), name, F.lit(' КАК К, "ИЗ ""x""" КАК С, Т.o_custkey.c_name ПОМЕСТИТЬ Вт ИЗ Справочник.'), table, F.lit(" КАК Т ЛЕВОЕ СОЕДИНЕНИЕ Справочник.customer КАК Ц ПО Т.o_custkey = Ц.Ссылка ГДЕ Т.o_totalprice > "), key.cast("string"), tail, F.lit("; SELECT К FROM Вт"))
    return orders.select(key.alias("id"), text.alias("text"))


@query("Q08", """SELECT o_orderkey AS id, o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AS valid, CAST(CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_errors,
CAST(0 AS BIGINT) AS n_warnings, CAST(3 AS BIGINT) AS tables, CAST(CASE WHEN o_orderkey % 11 = 0 THEN 2 WHEN o_orderkey % 5 = 0 THEN 8 ELSE 7 END AS BIGINT) AS fields, CAST(2 AS BIGINT) AS statements FROM orders""")
def _(d):
    return checked(sample_texts(d.orders), catalog_of(d.g_attributes))


@query("Q11", """SELECT o_orderkey AS id, 'LOW' AS priority, 'order' AS rule FROM orders WHERE o_orderkey % 5 = 0""")
def _(d):
    return advised(sample_texts(d.orders)).filter("rule = 'order'")


@query("Q01", """SELECT kind, CAST(n AS BIGINT) * (SELECT count(*) FROM orders) AS n FROM (VALUES ('string', 1), ('number', 1)) AS t(kind, n)""")
def _(d):
    return tokens(sample_texts(d.orders)).filter("kind IN ('string', 'number')").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("Q02", """SELECT o_orderkey AS id, CASE WHEN alias = 'Т' AND o_orderkey % 11 = 0 THEN 'Справочник.ordrs' ELSE named END AS source, alias, joined FROM orders, (VALUES ('Справочник.orders', 'Т', ''), ('Справочник.customer', 'Ц', 'left'), ('Вт', '', '')) AS t(named, alias, joined)""")
def _(d):
    return sources(sample_texts(d.orders))


@query("Q04", "SELECT o_orderkey AS id, 'Вт' AS name, 'К,С,c_name' AS columns FROM orders")
def _(d):
    return temp_columns(sample_texts(d.orders))
