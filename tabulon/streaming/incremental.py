"""Incremental indexing: snapshot differences, idempotent upserts in micro-batches, event-time windows as an extension."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def snapshot_changes(old: DataFrame, new: DataFrame, key: str = "path", complete: bool = True) -> DataFrame:
    """(key, change): added, changed (time or size differ) or removed; an incomplete new snapshot proves no removal."""
    a, b = (d.select(key, F.col("mtime").alias(f"{p}_t"), F.col("size").alias(f"{p}_s"), F.lit(True).alias(p)) for d, p in ((old, "a"), (new, "b")))
    both = a.join(b, key, "full_outer")
    change = (F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed" if complete else None)
              .when(~F.col("a_t").eqNullSafe(F.col("b_t")) | ~F.col("a_s").eqNullSafe(F.col("b_s")), "changed"))
    return both.select(key, change.alias("change")).where("change IS NOT NULL")


def page_after(df: DataFrame, key: str, after: object, size: int) -> DataFrame:
    """The next page of an intake; the last key of a page is where the next one resumes."""
    return (df if after is None else df.where(F.col(key) > F.lit(after))).orderBy(key).limit(size)


def stream_table(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream; the limit for each trigger is the backpressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def upsert_stream(stream: DataFrame, target: str, key: str, order: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Latest row of each key into versions under `target`; a batch that runs twice writes the same version again.

    Each micro-batch reads the version before it and writes its own, so a crash leaves the older one whole. Rows of a failed
    preparation (null key) leave the old body in place.
    """
    def write(batch: DataFrame, number: int) -> None:
        new = (prepare(batch) if prepare else batch).where(F.col(key).isNotNull())
        if number:
            new = batch.sparkSession.read.parquet(f"{target}/batch_version={number - 1}").select(new.columns).unionByName(new)
        cols = [c for c in new.columns if c != key]
        latest = new.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_row")).select(key, "_row.*")
        latest.select(new.columns).write.mode("overwrite").parquet(f"{target}/batch_version={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_version(spark: SparkSession, target: str) -> DataFrame:
    """Rows of the newest complete version."""
    rows = spark.read.option("basePath", target).parquet(target)
    last = rows.agg(F.max("batch_version")).first()[0]
    return rows.where(F.col("batch_version") == last).drop("batch_version")


def in_lane(spark: SparkSession, pool: str) -> None:
    """Jobs started from this thread go to a fair-scheduler pool, so that lanes share the cluster."""
    spark.sparkContext.setLocalProperty("spark.scheduler.pool", pool)


def latest_wins(spark: SparkSession, group: str) -> None:
    """Cancels the running jobs of a group before a newer query of it starts."""
    spark.sparkContext.cancelJobGroup(group)
    spark.sparkContext.setJobGroup(group, "latest query", interruptOnCancel=True)


def windowed(events: DataFrame, at: str, length: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums by event-time window (an extension); with `late`, a watermark bounds the state of a stream."""
    e = events.withWatermark(at, late) if late else events
    w = F.window(at, length, slide) if slide else F.window(at, length)
    return e.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, at: str, user: str, gap: str) -> DataFrame:
    """Sessions of a user, cut by a gap (an extension)."""
    return events.groupBy(F.session_window(at, gap).alias("w"), user).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
