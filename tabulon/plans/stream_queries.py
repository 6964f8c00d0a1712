"""Queries of incremental indexing and of the event-time extension."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..registry import load, query
from ..streaming import gate, incremental


def _snapshots(s, d):
    o = load(s, d, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("mtime"), F.col("o_custkey").alias("size"))
    return o.where("path % 10 <> 0"), o.where("path % 7 <> 0").withColumn("size", F.when(F.col("path") % 3 == 0, F.col("size") + 1).otherwise(F.col("size")))


_CHANGE = "CASE WHEN o_orderkey % 10 = 0 AND o_orderkey % 7 <> 0 THEN 'added' WHEN o_orderkey % 10 <> 0 AND o_orderkey % 7 = 0 THEN 'removed' WHEN o_orderkey % 10 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 3 = 0 THEN 'changed' END"


@query("t01_snapshot_changes", f"SELECT o_orderkey AS path, {_CHANGE} AS change FROM orders WHERE {_CHANGE} IS NOT NULL")
def _(s, d):
    return incremental.snapshot_changes(*_snapshots(s, d))


@query("t02_incomplete_snapshot", f"SELECT o_orderkey AS path, {_CHANGE} AS change FROM orders WHERE {_CHANGE} IN ('added', 'changed')")
def _(s, d):
    return incremental.snapshot_changes(*_snapshots(s, d), complete=False)


@query("t03_paged_intake", "SELECT o_orderkey FROM orders WHERE o_orderkey > 1000 ORDER BY 1 LIMIT 100")
def _(s, d):
    return incremental.page_after(load(s, d, "orders").select("o_orderkey"), "o_orderkey", 1000, 100)


@query("t_ext_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(s, d):
    return incremental.windowed(load(s, d, "events"), "ts", "1 hour").withColumn("total", F.round("total", 4))


@query("t_ext_sessions", "WITH e AS (SELECT user_id, ts, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= INTERVAL 30 MINUTE AS cut FROM events), g AS (SELECT user_id, ts, sum(coalesce(cut, true)::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM g GROUP BY user_id, k")
def _(s, d):
    return incremental.sessions(load(s, d, "events"), "ts", "user_id", "30 minutes")


def gate_events(s, d):
    """Events as arrivals, urgent reads and ends of documents in 40 lanes."""
    e = load(s, d, "events")
    kind = F.when(F.col("event_id") % 7 == 3, "read").when(F.col("event_id") % 11 == 5, "forget").when(F.col("event_id") % 5 < 2, "done").otherwise("arrive")
    return e.select((F.col("user_id") % 40).cast("string").alias("lane"), F.col("event_id").alias("at"), (F.col("event_id") * 7 % 61).alias("doc"), kind.alias("kind"))


@query("t05_bounded_line")
def _(s, d):
    """Every event through a line of eight documents a lane; the rest waits. Written by a stream whose state is kept between batches, then read back."""
    from ..lineage import shared_dir

    at = f"{shared_dir(s).rstrip('/')}/gate-{uuid.uuid4().hex}"
    gate_events(s, d).repartition(1).sortWithinPartitions("at").write.parquet(f"{at}/in")
    gate.run_stream(s.readStream.schema(gate.EVENTS).parquet(f"{at}/in"), f"{at}/out", f"{at}/state")
    return s.read.schema(gate.ACTIONS).parquet(f"{at}/out")
