"""Analytics over tool-call logs, journals, and retrieval evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metaloom.operators.registry import query


def summary(calls: DataFrame, since=None) -> DataFrame:
    """One row of totals; the error rate of an empty log is 100, as one less zero of at least one."""
    calls = calls if since is None else calls.filter(F.col("ts") >= F.lit(since))
    one = calls.agg(F.count(F.lit(1)).alias("total"), F.count_if("success").alias("ok"), F.avg("duration_ms").alias("avg_ms"), F.max("duration_ms").alias("max_ms"))
    return one.withColumn("error_rate", F.round((1 - F.col("ok") / F.greatest("total", F.lit(1))) * 100, 2))


def by(calls: DataFrame, key: str) -> DataFrame:
    out = calls.groupBy(key).agg(F.count(F.lit(1)).alias("calls"), F.round(F.avg("duration_ms"), 4).alias("avg_ms"), F.max("duration_ms").alias("max_ms"), F.count_if(~F.col("success")).alias("errors"))
    return out.orderBy(F.desc("calls"), key)


def rate(condition: Column) -> Column:
    return F.round(F.avg(F.when(condition, 1.0).otherwise(0.0)), 4)


def retrieval_metrics(results: DataFrame, *keys: str) -> DataFrame:
    """Pass rates, recall, mean reciprocal rank (a miss is 0), latency over good rows, and errors."""
    rank, ms = F.col("mrr_rank"), F.when(F.col("ok"), F.col("duration_ms"))
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        rate(F.col("hard_passed")).alias("hard_rate"),
        rate(F.col("soft_passed")).alias("soft_rate"),
        *[rate(F.coalesce(rank <= k, F.lit(False))).alias(f"recall_{k}") for k in (1, 5, 10)],
        F.round(F.avg(F.when(rank.isNull(), 0.0).otherwise(1.0 / rank)), 4).alias("mrr"),
        F.min(ms).alias("min_ms"),
        F.percentile(ms, 0.5).alias("p50_ms"),
        F.percentile(ms, 0.95).alias("p95_ms"),
        F.max(ms).alias("max_ms"),
        F.count_if(F.col("mode") == "hybrid").alias("n_hybrid"),
        F.count_if(~F.col("ok")).alias("n_errors"),
    )


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key; the maximum is taken before the shuffle, and nothing is sorted."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(key, "x.*")


def assigned(calls: DataFrame, marks: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """calls with the name of the last mark at or before each (as-of join); null before the first mark.

    Both sides are bucketed by spans of time, so short that a bucket has about so many rows.  Within a bucket a window
    carries marks forward; the last mark of earlier buckets comes from a table with a row a bucket.  No bucket but one
    span meets in one task, and no pairs are tried.
    """
    marks = marks.groupBy("ts").agg(F.max_by("name", "event_id").alias("name"))
    least, most, n = calls.select("ts").union(marks.select("ts")).agg(F.min(F.unix_micros(F.to_timestamp("ts"))), F.max(F.unix_micros(F.to_timestamp("ts"))), F.count(F.lit(1))).first()
    width = max(1, ((most or 0) - (least or 0) + 1) * rows // max(1, n))
    bucket = F.floor(F.unix_micros(F.to_timestamp("ts")) / F.lit(width)).cast("long").alias("bucket")
    last = marks.groupBy(bucket).agg(F.max_by("name", "ts").alias("name"))
    buckets = calls.select(bucket).union(marks.select(bucket)).distinct().join(last, "bucket", "left")
    earlier = buckets.select("bucket", F.last("name", ignorenulls=True).over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    columns = [c for c in calls.columns if c != "ts"]
    both = calls.select("ts", bucket, F.lit(1).alias("side"), F.struct(*columns).alias("call"), F.lit(None).cast("string").alias("mark"))
    both = both.unionByName(marks.select("ts", bucket, F.lit(0).alias("side"), F.lit(None).cast(both.schema["call"].dataType).alias("call"), F.col("name").alias("mark")))
    seen = F.last("mark", ignorenulls=True).over(W.partitionBy("bucket").orderBy("ts", "side").rowsBetween(W.unboundedPreceding, 0))
    out = both.withColumn("mark", seen).filter("side = 1").join(earlier, "bucket", "left")
    return out.select("ts", "call.*", F.coalesce("mark", "before").alias("mark"))


def soft_misses(reports: DataFrame) -> DataFrame:
    """(id, predicate) of each failed soft predicate; soft is an array of struct(name, passed)."""
    return reports.select("id", F.explode("soft").alias("p")).filter(~F.col("p.passed")).select("id", F.col("p.name").alias("predicate"))


def server_of(tool: Column, servers: dict[str, str], other: str = "other") -> Column:
    """The server whose prefix a tool's name has; longer prefixes come first."""
    out = F.lit(other)
    for prefix in sorted(servers, key=len):
        out = F.when(tool.startswith(prefix), servers[prefix]).otherwise(out)
    return out


def latest_slot(now: Column, hour: int, weekday: int | None = None) -> Column:
    """The last time at or before now that a daily or weekly schedule names; weekday is 1 for Sunday to 7."""
    slot = F.make_timestamp(F.year(now), F.month(now), F.dayofmonth(now), F.lit(hour), F.lit(0), F.lit(0))
    if weekday is None:
        back = F.when(slot > now, 1).otherwise(0)
    else:
        back = F.pmod(F.dayofweek(now) - weekday, F.lit(7))
        back = F.when((back == 0) & (slot > now), 7).otherwise(back)
    return slot - F.make_interval(days=back)


def is_due(now: Column, last_run: Column, hour: int, grace_hours: int = 12) -> Column:
    """Whether a daily slot has passed since the last run, and not so long ago that it is left out."""
    slot = latest_slot(now, hour)
    return (F.coalesce(last_run < slot, F.lit(True))) & (now <= slot + F.make_interval(hours=F.lit(grace_hours)))


# Evaluation predicates over JSON responses.


def dug(response: Column, path: Column) -> Column:
    """The value at a dotted path, as text; null if it is absent or null."""
    json_path = F.concat(F.lit("$."), F.regexp_replace(path, r"\.(\d+)(?=\.|$)", "[$1]"))
    return F.call_function("get_json_object", response, json_path)


def norm(text: Column) -> Column:
    return F.lower(F.trim(text))


def passes(kind: Column, response: Column, path: Column, value: Column, k: Column) -> Column:
    """Whether a predicate holds; an unknown kind fails, and path_lacks holds on a missing path.

    Hits are the objects in the response's results.
    """
    hits = F.coalesce(F.from_json(F.get_json_object(response, "$.results"), "array<map<string,string>>"), F.array().cast("array<map<string,string>>"))
    top = F.slice(hits, 1, F.greatest(k, F.lit(1)))
    found, want = norm(dug(response, path)), norm(value)
    field = lambda h, name: norm(F.try_element_at(h, name))
    number = F.when(~F.lower(dug(response, path)).isin("true", "false"), F.try_to_number(dug(response, path), F.lit("S999999999.999999")).cast("double"))
    return F.coalesce(
        F.when(kind == "non_empty", F.size(hits) > 0)
        .when(kind == "results_count_at_least", F.size(hits) >= k)
        .when(kind == "name_in_top_k", F.exists(top, lambda h: field(h, F.lit("name")) == want))
        .when(kind == "any_hit_kind", F.exists(hits, lambda h: field(h, F.lit("kind")) == want))
        .when(kind == "full_name_contains", F.exists(hits, lambda h: F.contains(field(h, F.lit("full_name")), want)))
        .when(kind == "hit_field_in_top_k", F.exists(top, lambda h: field(h, path) == want))
        .when(kind == "field_equals", found == want)
        .when(kind == "path_non_empty", ~F.coalesce(found, F.lit("")).isin("", "[]", "{}"))
        .when(kind == "path_contains", F.contains(found, want))
        .when(kind == "path_lacks", ~F.coalesce(F.contains(found, want), F.lit(False)))
        .when(kind == "field_at_least", number >= want.cast("double")),
        F.lit(False),
    )


def judged(responses: DataFrame, predicates: DataFrame) -> DataFrame:
    """(id, kind, passed): each predicate (tool, kind, path, value, k) held against each response (id, tool, response)."""
    both = responses.join(predicates, "tool")
    return both.select("id", "kind", passes(F.col("kind"), F.col("response"), F.col("path"), F.col("value"), F.col("k")).alias("passed"))


@query("A06", """SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE success) AS BIGINT) AS ok, avg(duration_ms) AS avg_ms, max(duration_ms) AS max_ms,
round((1 - CAST(count(*) FILTER (WHERE success) AS DOUBLE) / greatest(count(*), 1)) * 100, 2) AS error_rate FROM tool_calls WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'""", "tool_calls")
def _(d):
    import datetime

    return summary(d.tool_calls, datetime.datetime(2024, 1, 15))


_BY = """SELECT {k}, CAST(count(*) AS BIGINT) AS calls, round(avg(duration_ms), 4) AS avg_ms, max(duration_ms) AS max_ms, CAST(count(*) FILTER (WHERE NOT success) AS BIGINT) AS errors FROM tool_calls GROUP BY {k}"""


@query("A07", _BY.format(k="tool_name"), "tool_calls")
def _(d):
    return by(d.tool_calls, "tool_name")


@query("A07_server", _BY.format(k="server_name"), "tool_calls")
def _(d):
    return by(d.tool_calls, "server_name")


@query("A08", """SELECT dataset, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN hard_passed THEN 1.0 ELSE 0.0 END), 4) AS hard_rate, round(avg(CASE WHEN soft_passed THEN 1.0 ELSE 0.0 END), 4) AS soft_rate,
round(avg(CASE WHEN mrr_rank <= 1 THEN 1.0 ELSE 0.0 END), 4) AS recall_1, round(avg(CASE WHEN mrr_rank <= 5 THEN 1.0 ELSE 0.0 END), 4) AS recall_5, round(avg(CASE WHEN mrr_rank <= 10 THEN 1.0 ELSE 0.0 END), 4) AS recall_10,
round(avg(CASE WHEN mrr_rank IS NULL THEN 0.0 ELSE CAST(1 AS DOUBLE) / mrr_rank END), 4) AS mrr, min(duration_ms) FILTER (WHERE ok) AS min_ms, quantile_cont(duration_ms, 0.5) FILTER (WHERE ok) AS p50_ms,
quantile_cont(duration_ms, 0.95) FILTER (WHERE ok) AS p95_ms, max(duration_ms) FILTER (WHERE ok) AS max_ms, CAST(count(*) FILTER (WHERE mode = 'hybrid') AS BIGINT) AS n_hybrid, CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS n_errors
FROM eval_results GROUP BY dataset""", "eval_results")
def _(d):
    return retrieval_metrics(d.eval_results, "dataset")


@query("A21", """SELECT dataset, id, duration_ms, CASE WHEN ts >= TIMESTAMP '2024-01-29 00:00:00' THEN 'fresh' ELSE 'stale' END AS state
FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY ts DESC, id DESC) AS rn FROM eval_results) x WHERE rn = 1""", "eval_results")
def _(d):
    last = latest(d.eval_results, "dataset", "ts", "id")
    return last.select("dataset", "id", "duration_ms", F.when(F.col("ts") >= F.lit("2024-01-29").cast("timestamp"), "fresh").otherwise("stale").alias("state"))


@query("W07", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) x WHERE rn = 1")
def _(d):
    return latest(d.events.select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("A22", """SELECT id, unnest(CASE WHEN soft_passed THEN [] ELSE ['soft'] END || CASE WHEN coalesce(mrr_rank, 99) > 5 THEN ['rank'] ELSE [] END) AS predicate FROM eval_results""", "eval_results")
def _(d):
    soft = F.array(F.struct(F.lit("soft").alias("name"), F.col("soft_passed").alias("passed")), F.struct(F.lit("rank").alias("name"), (F.coalesce("mrr_rank", F.lit(99)) <= 5).alias("passed")))
    return soft_misses(d.eval_results.select("id", soft.alias("soft")))


@query("P06", "SELECT id, tool_name, ts FROM tool_calls WHERE NOT success ORDER BY ts DESC, id DESC LIMIT 20", "tool_calls")
def _(d):
    return d.tool_calls.filter(~F.col("success")).select("id", "tool_name", "ts").orderBy(F.desc("ts"), F.desc("id")).limit(20)


@query("P06_slow", "SELECT id, tool_name, duration_ms FROM tool_calls ORDER BY duration_ms DESC, id LIMIT 10", "tool_calls")
def _(d):
    return d.tool_calls.select("id", "tool_name", "duration_ms").orderBy(F.desc("duration_ms"), "id").limit(10)


@query("J17", """SELECT e.event_id, e.ts, m.name AS mark FROM events e ASOF LEFT JOIN (SELECT ts, max_by(name, event_id) AS name FROM marks GROUP BY ts) m ON e.ts >= m.ts""", "marks")
def _(d):
    return assigned(d.events.select("event_id", "ts"), d.marks)


@query("X24", "SELECT CASE WHEN starts_with(event_type, 'cl') THEN 'ui' WHEN starts_with(event_type, 'c') THEN 'core' WHEN starts_with(event_type, 'p') THEN 'shop' ELSE 'other' END AS server, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def _(d):
    return d.events.groupBy(server_of(F.col("event_type"), {"c": "core", "cl": "ui", "p": "shop"}).alias("server")).agg(F.count(F.lit(1)).alias("n"))


@query("W06", """SELECT event_id, CASE WHEN slot > ts THEN slot - INTERVAL 1 DAY ELSE slot END AS slot FROM (SELECT event_id, ts, date_trunc('day', ts) + INTERVAL 3 HOUR AS slot FROM events) x""")
def _(d):
    return d.events.select("event_id", latest_slot(F.col("ts"), 3).alias("slot"))


@query("F11", """SELECT event_id AS id, k AS kind, CASE k WHEN 'field_at_least' THEN v >= 50 WHEN 'path_non_empty' THEN true WHEN 'path_lacks' THEN true WHEN 'field_equals' THEN v = 7 WHEN 'non_empty' THEN false ELSE false END AS passed
FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS v, unnest(['field_at_least', 'path_non_empty', 'path_lacks', 'field_equals', 'non_empty', 'no_such']) AS k FROM events) x""")
def _(d):
    rules = [("field_at_least", "k", "50", 0), ("path_non_empty", "k", "", 0), ("path_lacks", "gone.0.x", "7", 0), ("field_equals", "k", "7", 0), ("non_empty", "k", "", 0), ("no_such", "k", "", 0)]
    rules_ = d.spark.createDataFrame([("t", *r) for r in rules], "tool string, kind string, path string, value string, k int")
    return judged(d.events.select(F.col("event_id").alias("id"), F.lit("t").alias("tool"), F.col("props").alias("response")), rules_)


@query("F12", "SELECT event_id, json_extract_string(props, '$.k') AS v, json_extract_string(props, '$.gone') AS gone FROM events")
def _(d):
    return d.events.select("event_id", dug(F.col("props"), F.lit("k")).alias("v"), dug(F.col("props"), F.lit("gone")).alias("gone"))
