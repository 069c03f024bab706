"""File events: debouncing in event-time sessions, and a single-writer sink that tells what it has done.

The same functions take streams and tables.  A session fires once the watermark passes its end, so on a stream the
last session waits for newer events.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.operators.registry import query


def mapped(events: DataFrame) -> DataFrame:
    """(path, ts, event_id, action): created and modified are upserts, deleted is a removal, moved is both."""
    remove = F.struct(F.col("path").alias("path"), F.lit("remove").alias("action"))
    target = F.concat("path", F.lit(".new")) if "target" not in events.columns else F.col("target")
    upsert = lambda p: F.struct(p.alias("path"), F.lit("upsert").alias("action"))
    what = F.when(F.col("kind") == "deleted", F.array(remove)).when(F.col("kind") == "moved", F.array(remove, upsert(target))).otherwise(F.array(upsert(F.col("path"))))
    return events.select("ts", "event_id", F.explode(what).alias("x")).select("x.path", "ts", "event_id", "x.action")


def debounced(actions: DataFrame, gap: str = "3 seconds", delay: str | None = None) -> DataFrame:
    """(path, start, stop, action, n): of each run of events on a path with gaps under gap, the last action."""
    actions = actions if delay is None else actions.withWatermark("ts", delay)
    by = actions.groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.max_by("action", F.struct("ts", "event_id")).alias("action"), F.count(F.lit(1)).alias("n"))
    return by.select("path", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "action", "n")


class Lease:
    """One row of state that a single writer holds for a while; compare-and-set on the driver that owns it."""

    def __init__(self, clock=time.time):
        self.owner, self.until, self.clock = None, 0.0, clock

    def acquire(self, owner: str, seconds: float) -> bool:
        """True for the holder, who may ask again, and for anyone after the lease has run out."""
        now = self.clock()
        if self.owner not in (None, owner) and now < self.until:
            return False
        self.owner, self.until = owner, now + seconds
        return True

    def release(self, owner: str) -> bool:
        if self.owner != owner:
            return False
        self.owner, self.until = None, 0.0
        return True


def run_available(actions: DataFrame, path: str, checkpoint: str, lease: Lease | None = None, owner: str = "main", gap: str = "3 seconds", delay: str = "0 seconds"):
    """Debounces what a stream has now and writes it under path, a folder for each batch, so a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if lease is not None and not lease.acquire(owner, 60):
            raise RuntimeError("another writer holds the lease")
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    q = debounced(actions, gap, delay).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


_ACTIONS = """SELECT path, ts, event_id, CASE WHEN kind = 'deleted' THEN 'remove' ELSE 'upsert' END AS action FROM fs_events WHERE kind <> 'moved'
UNION ALL SELECT path, ts, event_id, 'remove' FROM fs_events WHERE kind = 'moved' UNION ALL SELECT path || '.new', ts, event_id, 'upsert' FROM fs_events WHERE kind = 'moved'"""


@query("T02", f"SELECT path, action, CAST(count(*) AS BIGINT) AS n FROM ({_ACTIONS}) a GROUP BY path, action", "fs_events")
def _(d):
    return mapped(d.fs_events).groupBy("path", "action").agg(F.count(F.lit(1)).alias("n"))


@query("T01", f"""WITH a AS ({_ACTIONS}), g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY path ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM a),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT path, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS stop, arg_max(action, {{'t': ts, 'e': event_id}}) AS action, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY path, k""", "fs_events")
def _(d):
    return debounced(mapped(d.fs_events), "2 hours")
