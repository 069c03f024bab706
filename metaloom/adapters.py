"""Views of the standard tables as the operators' schemas.

Each view is one SQL text that Spark and DuckDB both run: Spark makes DataFrames of it, and the oracle inlines it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "g_objects": """
SELECT id, kind, name, synonym, kind || '.' || name AS full_name_eng,
  CASE kind WHEN 'Subsystem' THEN 'Подсистемы.' WHEN 'Catalog' THEN 'Справочники.' WHEN 'Enum' THEN 'Перечисления.' ELSE 'Документы.' END || name AS full_name_ru,
  CASE kind WHEN 'Subsystem' THEN 'Подсистема' WHEN 'Catalog' THEN 'Справочник' WHEN 'Enum' THEN 'Перечисление' ELSE 'Документ' END AS kind_ru
FROM (
  SELECT 'Subsystem.R' || r_regionkey AS id, 'Subsystem' AS kind, 'R' || r_regionkey AS name, r_name AS synonym FROM region
  UNION ALL SELECT 'Subsystem.N' || n_nationkey, 'Subsystem', 'N' || n_nationkey, n_name FROM nation
  UNION ALL SELECT 'Catalog.C' || c_custkey, 'Catalog', 'C' || c_custkey, c_mktsegment FROM customer
  UNION ALL SELECT 'Catalog.S' || s_suppkey, 'Catalog', 'S' || s_suppkey, s_name FROM supplier
  UNION ALL SELECT 'Enum.P' || p_partkey, 'Enum', 'P' || p_partkey, p_brand FROM part
  UNION ALL SELECT 'Document.O' || o_orderkey, 'Document', 'O' || o_orderkey, o_orderpriority FROM orders) o""",
    "g_edges": """
SELECT 'PARENT_OF' AS rel, 'Subsystem.R' || n_regionkey AS src, 'Subsystem.N' || n_nationkey AS dst FROM nation
UNION ALL SELECT 'CONTAINS', 'Subsystem.N' || c_nationkey, 'Catalog.C' || c_custkey FROM customer
UNION ALL SELECT 'CONTAINS', 'Subsystem.N' || s_nationkey, 'Catalog.S' || s_suppkey FROM supplier
UNION ALL SELECT 'OWNED_BY', 'Document.O' || o_orderkey, 'Catalog.C' || o_custkey FROM orders
UNION ALL SELECT DISTINCT 'REGISTERS', 'Document.O' || l_orderkey, 'Enum.P' || l_partkey FROM lineitem
UNION ALL SELECT DISTINCT 'BASED_ON', 'Document.O' || l_orderkey, 'Catalog.S' || l_suppkey FROM lineitem""",
    "g_attributes": """
SELECT parent || '.Attr.' || name AS id, parent, section, name, role, type_kind, target, pos FROM (VALUES
  ('region', NULL, 'r_name', 'attribute', 'String', NULL, 1),
  ('nation', NULL, 'n_name', 'attribute', 'String', NULL, 1), ('nation', NULL, 'n_regionkey', 'dimension', 'CatalogRef', 'region', 2),
  ('customer', NULL, 'c_name', 'attribute', 'String', NULL, 1), ('customer', NULL, 'c_nationkey', 'dimension', 'CatalogRef', 'nation', 2),
  ('customer', NULL, 'c_acctbal', 'resource', 'Number', NULL, 3), ('customer', NULL, 'c_mktsegment', 'attribute', 'String', NULL, 4),
  ('supplier', NULL, 's_name', 'attribute', 'String', NULL, 1), ('supplier', NULL, 's_nationkey', 'dimension', 'CatalogRef', 'nation', 2),
  ('supplier', NULL, 's_acctbal', 'resource', 'Number', NULL, 3),
  ('part', NULL, 'p_name', 'attribute', 'String', NULL, 1), ('part', NULL, 'p_brand', 'attribute', 'String', NULL, 2),
  ('part', NULL, 'p_type', 'attribute', 'String', NULL, 3), ('part', NULL, 'p_size', 'resource', 'Number', NULL, 4),
  ('part', NULL, 'p_retailprice', 'resource', 'Number', NULL, 5),
  ('orders', NULL, 'o_custkey', 'dimension', 'CatalogRef', 'customer', 1), ('orders', NULL, 'o_orderstatus', 'attribute', 'String', NULL, 2),
  ('orders', NULL, 'o_totalprice', 'resource', 'Number', NULL, 3), ('orders', NULL, 'o_orderdate', 'attribute', 'Date', NULL, 4),
  ('orders', 'lineitem', 'l_partkey', 'dimension', 'CatalogRef', 'part', 1), ('orders', 'lineitem', 'l_suppkey', 'dimension', 'CatalogRef', 'supplier', 2),
  ('orders', 'lineitem', 'l_quantity', 'resource', 'Number', NULL, 3), ('orders', 'lineitem', 'l_shipdate', 'attribute', 'Date', NULL, 4))
  AS t(parent, section, name, role, type_kind, target, pos)""",
    "g_callsites": """
SELECT event_id AS id, caller, lead(caller) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS callee, module_id,
  CAST(event_id % 97 AS INT) AS line, event_type <> 'error' AS resolved, event_type AS reason
FROM (SELECT *, 'U' || user_id || '.D' || day(ts) AS caller, 'U' || user_id AS module_id FROM events) e""",
    "g_calls": """
SELECT DISTINCT caller AS src, callee AS dst FROM g_callsites WHERE resolved AND callee IS NOT NULL AND caller <> callee""",
    "g_callables": """
SELECT id, id AS full_name, split_part(id, '.', 2) AS name, split_part(id, '.', 1) AS module_id,
  CAST(substr(split_part(id, '.', 2), 2) AS INT) % 3 = 0 AS is_export
FROM (SELECT caller AS id FROM g_callsites UNION SELECT callee FROM g_callsites WHERE callee IS NOT NULL) c""",
    "g_operates": """
SELECT DISTINCT 'U' || user_id || '.D' || day(ts) AS src, 'Catalog.C' || (user_id + 1) AS dst, event_type AS via,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'write' ELSE 'read' END AS access FROM events""",
    "g_facts": """
SELECT 'U' || user_id || '.' || day(ts) || '.' || CAST(floor(value / 40) AS INT) AS key, event_type AS kind, event_id AS seq,
  CAST(20 - event_id % 10 AS INT) AS confidence FROM events""",
    "tool_calls": """
SELECT event_id AS id, 'srv' || CAST(user_id % 5 AS INT) AS server_name, event_type AS tool_name, ts, value AS duration_ms,
  event_type <> 'error' AS success FROM events""",
    "marks": """
SELECT ts, 'mark-' || event_id AS name, event_id FROM events WHERE event_type = 'signup' AND user_id % 10 = 3""",
    "eval_results": """
SELECT event_id AS id, event_type AS dataset, event_type <> 'error' AS ok, event_id % 7 <> 0 AS hard_passed, event_id % 5 <> 0 AS soft_passed,
  CASE WHEN event_id % 12 = 0 THEN NULL ELSE CAST(event_id % 12 AS INT) END AS mrr_rank, value AS duration_ms,
  CASE WHEN event_id % 4 = 0 THEN 'dense' ELSE 'hybrid' END AS mode, ts FROM events""",
    "docs": """
SELECT doc_id AS page, source AS container, lang AS parent, text, n_chars FROM documents""",
    "fs_events": """
SELECT event_id, CAST(user_id AS VARCHAR(20)) AS path, ts,
  CASE event_type WHEN 'error' THEN 'deleted' WHEN 'signup' THEN 'moved' WHEN 'view' THEN 'created' ELSE 'modified' END AS kind FROM events""",
    "line_digests": """
SELECT l_orderkey AS owner, l_linenumber || chr(9) || l_partkey || chr(9) || l_suppkey AS line, l_linenumber AS n FROM lineitem""",
}
#: Which views a view is made of.
USES = {"g_calls": ["g_callsites"], "g_callables": ["g_callsites"]}


def with_views(sql: str, *names: str) -> str:
    """sql for the oracle, with the views that it uses put before it."""
    need: list[str] = []
    for n in names:
        need += [x for x in (*USES.get(n, []), n) if x not in need]
    sql = sql.strip()
    recursive = sql[:14].upper() == "WITH RECURSIVE"
    if sql[:5].upper() == "WITH ":
        sql = ", " + sql[14 if recursive else 5 :].strip()
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(f"{n} AS ({VIEWS[n]})" for n in need) + " " + sql


class Data:
    """DataFrames of the tables in a folder, and of the views over them, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def table(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in VIEWS:
                self._made[name] = self._sql(with_views(f"SELECT * FROM {name}", name))
            else:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._made[name]

    def repeated(self, name: str) -> DataFrame:
        """A view before its repeated rows are made one."""
        return self._sql(with_views(f"SELECT * FROM {name}", name).replace("SELECT DISTINCT", "SELECT"))

    def _sql(self, sql: str) -> DataFrame:
        used = {t: self.table(t) for t in TABLES if f" {t}" in sql}
        for t, df in used.items():
            df.createOrReplaceTempView(t)
        return self.spark.sql(sql)

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS or name in TABLES:
            return self.table(name)
        raise AttributeError(name)


