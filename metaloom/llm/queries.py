"""The queries over the standard tables, with production parameters, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from metaloom.llm.fingerprint import fingerprinted

    return fingerprinted(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from metaloom.llm.decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from metaloom.llm.toxicity import scored, train

    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from metaloom.llm.linededup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from metaloom.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from metaloom.llm.fmindex import deduplicated

    return deduplicated(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from metaloom.llm.warc import archived

    return archived(table(spark, sf_dir, "pages"))


def op8_lpf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from metaloom.llm.lpf import deduplicated

    return deduplicated(table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from metaloom.llm.htmlcrf import extracted

    return extracted(table(spark, sf_dir, "pages"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from metaloom.llm.bpe import encoded

    return encoded(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from metaloom.llm.trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from metaloom.llm.fim import restored, transformed

    digest = lambda text: F.sha2(text.cast("binary"), 256)  # noqa: E731
    got = transformed(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), digest(F.col("output")).alias("output_sha256"), digest(restored()).alias("restored_sha256"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from metaloom.llm.tokenfiles import token_files

    return token_files(table(spark, sf_dir, "documents"))


#: Keys of at least 40 characters in at least 5 documents lose their lines in all documents but the last.
LINE_DEDUP_SQL = r"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT doc_id, lines[i] AS line, i,
    translate(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM parts)),
common AS (
  SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT l.doc_id, l.line, l.i, coalesce(l.doc_id < c.last, false) AS gone
  FROM lines l LEFT JOIN common c ON l.key = c.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

#: Shingles of five words; an item leaks into a document that holds 0.8 of its shingles.
DECONTAMINATION_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark),
ds AS (
  SELECT DISTINCT doc_id, list_aggregate(w[i:i + least(5, len(w)) - 1], 'string_agg', ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
bs AS (
  SELECT DISTINCT item_id, list_aggregate(w[i:i + least(5, len(w)) - 1], 'string_agg', ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id)
SELECT ds.doc_id, bs.item_id, CAST(n.n AS BIGINT) AS n_shingles, CAST(count(*) AS DOUBLE) / n.n AS containment
FROM ds JOIN bs ON ds.s = bs.s JOIN n ON n.item_id = bs.item_id
GROUP BY ds.doc_id, bs.item_id, n.n HAVING CAST(count(*) AS DOUBLE) / n.n >= 0.8 - 1e-9
"""


#: SHA-1 digests in base32, made of the hex digits in groups of five bits.
WARC_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
bits AS (
  SELECT page_id, n, h,
    array_to_string(list_transform(range(1, 41), lambda i: right('000' || bin(strpos('0123456789abcdef', h[i]) - 1), 4)), '') AS bits
  FROM d),
named AS (
  SELECT page_id, n, array_to_string(list_transform(range(0, 32),
    lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST(list_sum(list_transform(range(0, 5), lambda j: CASE WHEN bits[5 * i + j + 1] = '1' THEN 1 << (4 - j) ELSE 0 END)) AS INT) + 1, 1)), '') AS digest
  FROM bits)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = max(page_id) OVER (PARTITION BY digest) THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id < max(page_id) OVER (PARTITION BY digest) THEN max(page_id) OVER (PARTITION BY digest) END AS refers_to
FROM named
"""


#: Each text is cut at two hashed places and put together in one of three forms.
FILL_IN_MIDDLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS x FROM documents),
h AS (
  SELECT doc_id, t, n, CAST('0x' || substr(x, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(x, 9, 8) AS BIGINT) % (n + 1) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(x, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || substr(x, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
c AS (SELECT doc_id, t, n, form, least(a, b) AS i, greatest(a, b) AS j FROM h)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(i AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(j - i AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || substr(t, 1, i) || '<S>' || substr(t, j + 1) || '<M>' || substr(t, i + 1, j - i)
    ELSE '<S>' || substr(t, j + 1) || '<P>' || substr(t, 1, i) || '<M>' || substr(t, i + 1, j - i) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM c
"""

#: Prefixes are told apart by the digest of their turns; a node's figures go to all prefixes of its smallest member's path.
PREFIX_TRIE_SQL = r"""
WITH own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
convs AS (
  SELECT c, xor(4294967295, list_reduce(
      list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
      lambda x, y: list_reduce(list_concat([xor(x, y)], [CAST(0 AS BIGINT) for k in range(8)]),
        lambda a, z: xor(a >> 1, CASE WHEN a & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END)))) & 3 AS h
  FROM (SELECT DISTINCT c FROM own)),
turns AS (
  SELECT v.c, o.i, 0 AS part, o.role, o.text FROM convs v JOIN own o ON o.c = v.c - v.c % 20 AND o.i <= v.h
  UNION ALL SELECT v.c, o.i, 1, o.role, o.text FROM convs v JOIN own o ON o.c = v.c AND o.i > v.h),
ranked AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, i) AS d, role, text FROM turns),
keyed AS (
  SELECT c, d, sha256(string_agg(sha256(role) || sha256(text), ',') OVER (PARTITION BY c ORDER BY d)) AS k,
    len(regexp_extract_all(text, '[^ 	-]+')) AS words FROM ranked),
paths AS (
  SELECT c, 0 AS d, '' AS k, 0 AS words, NULL AS up FROM convs
  UNION ALL SELECT c, d, k, words, coalesce(lag(k) OVER (PARTITION BY c ORDER BY d), '') FROM keyed),
ended AS (SELECT *, d = max(d) OVER (PARTITION BY c) AS ends FROM paths),
nodes AS (
  SELECT d, k, min(c) AS c, count(*) AS n_convs, max(words) AS words, min(up) AS up,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM ended GROUP BY d, k),
kids AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT n.*, coalesce(x.n, 0) AS n_children FROM nodes n LEFT JOIN kids x ON x.d = n.d AND x.k = n.k),
below AS (
  SELECT p.d, p.k, sum((n.n_convs - 1) * n.words) AS saved_tokens, count(*) FILTER (WHERE n.n_children = 0) AS n_leaves
  FROM full_nodes n JOIN paths p ON p.c = n.c AND p.d <= n.d GROUP BY p.d, p.k)
SELECT CAST(n.c AS BIGINT) AS conv_id, CAST(n.d AS BIGINT) AS depth, CAST(u.c AS BIGINT) AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs,
  CAST(n.n_children AS BIGINT) AS n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN below b ON b.d = n.d AND b.k = n.k LEFT JOIN nodes u ON u.d = n.d - 1 AND u.k = n.up
"""


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": DECONTAMINATION_SQL, "op4_line_dedup": LINE_DEDUP_SQL, "op7_warc": WARC_SQL, "op11_prefix_trie": PREFIX_TRIE_SQL, "op12_fill_in_middle": FILL_IN_MIDDLE_SQL}
