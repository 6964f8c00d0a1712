"""Joins, set operations, upserts, garbage collection and version moves over keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def missing(df: DataFrame, other: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows without a partner; unlike NOT IN, null keys are simply without one."""
    return df.join(other, on, "left_anti")


def having(df: DataFrame, other: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(other, on, "left_semi")


def counted(df: DataFrame, other: DataFrame, on: str, name: str = "n") -> DataFrame:
    """A correlated count as one aggregation and a left join."""
    return df.join(other.groupBy(on).agg(F.count(F.lit(1)).alias(name)), on, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def in_ranges(df: DataFrame, at: str, ranges: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """Rows with low <= at < high: ranges are cut into cells of `width`, so that the join has an equality to shuffle on.

    Rows meet the different ranges first, and then all that have those by equality. So a range that many have is compared once, rows without a
    range aren't shuffled with them, and the result comes out range by range, which a file stores in little room.
    """
    cell = lambda c: F.floor(c.cast("double") / width).cast("long")
    keys = ranges.select(F.col(low).alias("_low"), F.col(high).alias("_high")).distinct().withColumn("_cell", F.explode(F.sequence(cell(F.col("_low")), cell(F.col("_high")))))
    met = df.withColumn("_cell", cell(F.col(at))).join(keys, "_cell").where((F.col(at) >= F.col("_low")) & (F.col(at) < F.col("_high"))).drop("_cell")
    each = ranges.select(F.struct(*ranges.columns).alias("_range"), F.col(low).alias("_low"), F.col(high).alias("_high"))
    return met.hint("shuffle_merge").join(each, ["_low", "_high"]).select(*df.columns, "_range.*")


def merge_ranked(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Two ranked lists merged by key, with both ranks."""
    a, b = left.select(key, F.col("rank").alias("left_rank")), right.select(key, F.col("rank").alias("right_rank"))
    return a.join(b, key, "full_outer")


def lookup(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, order: str, default: object = None) -> DataFrame:
    """XLOOKUP: the value of the first row with the key. The first is an aggregate, so repeated keys make no more rows."""
    first = table.where(F.col(table_key).isNotNull()).groupBy(F.col(table_key).alias(key)).agg(F.min_by(value, order).alias("found"))
    return df.join(first, key, "left").withColumn("found", F.coalesce("found", F.lit(default)) if default is not None else F.col("found"))


def match_position(table: DataFrame, column: str, order: str, value: object) -> DataFrame:
    """XMATCH: 1-based place of the first row with a value, as a count of what lies before."""
    first = table.where(F.col(column) == F.lit(value)).agg(F.min(order)).first()[0]
    return table.where(F.col(order) <= F.lit(first)).agg(F.when(F.count(F.lit(1)) > 0, F.count(F.lit(1))).alias("position"))


def _prefixes(path: Column, sep: str) -> Column:
    parts = F.split(path, sep)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), sep))


def longest_prefix(df: DataFrame, path: str, roots: DataFrame, root: str, id_col: str, sep: str = "/") -> DataFrame:
    """The most specific root of each path: its own prefixes are joined by equality, and the longest that is a root stays."""
    each = df.select(id_col, F.explode(_prefixes(F.col(path), sep)).alias(root))
    owner = each.join(roots.select(root).distinct(), root).groupBy(id_col).agg(F.max_by(root, F.length(root)).alias("owner"))
    return df.join(owner, id_col, "left")


def nearest_parent(folders: DataFrame, path: str, sep: str = "/") -> DataFrame:
    """(path, parent): the nearest registered folder above each one."""
    parts = _prefixes(F.col(path), sep)
    each = folders.select(F.col(path).alias("child"), F.explode(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).alias(path))
    found = each.join(folders.select(path).distinct(), path).groupBy("child").agg(F.max_by(path, F.length(path)).alias("parent"))
    return folders.select(F.col(path).alias("child")).join(found, "child", "left").withColumnRenamed("child", path)


def dedupe(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """First row of each key by `order`: text without case, non-finite numbers as blank, blanks equal.

    The first is a minimum joined back, not a window, so a key with many rows isn't gathered in one task.
    """
    folded = []
    for k in keys:
        kind = df.schema[k].dataType.typeName()
        c = F.col(k)
        folded.append(F.lower(c) if kind == "string" else F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c) if kind in ("float", "double") else c)
    first = df.groupBy(*(f.alias(f"_k{i}") for i, f in enumerate(folded))).agg(F.min(order).alias(order)).select(order)
    return df.join(first, order, "left_semi")


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Changes win; the columns of `base` are kept, and a change without one of them leaves the old value."""
    new = changes.select(F.col(key), *(F.col(c).alias(f"_new_{c}") for c in base.columns if c != key and c in changes.columns), F.lit(True).alias("_changed"))
    both = base.withColumn("_held", F.lit(True)).join(new, key, "full_outer")
    pick = [F.col(key) if c == key else F.when(F.col("_changed"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in changes.columns else F.col(c) for c in base.columns]
    return both.select(*pick)


def collect_garbage(documents: DataFrame, sets: DataFrame, chunks: DataFrame, vectors: DataFrame) -> dict[str, DataFrame]:
    """Surviving tables: sets of living documents that aren't retired, their chunks, the chunks' vectors, and fresh counts."""
    sets = having(sets.where(F.col("state") != "retired"), documents.select(F.col("id").alias("document_id")), "document_id")
    chunks = having(chunks, sets.select(F.col("id").alias("chunk_set_id")), "chunk_set_id")
    vectors = having(vectors, chunks.select(F.col("id").alias("chunk_id")), "chunk_id")
    counts = vectors.join(chunks.select(F.col("id").alias("chunk_id"), "document_id"), "chunk_id").groupBy("document_id", "space_id").agg(F.count(F.lit(1)).alias("completed_chunks"))
    return {"sets": sets, "chunks": chunks, "vectors": vectors, "counts": counts}


def activate(sets: DataFrame, chosen: DataFrame) -> DataFrame:
    """Makes one set of each chosen document (document_id, id) the active one and retires its others."""
    c = chosen.select("document_id", F.col("id").alias("_chosen"))
    return sets.join(c, "document_id", "left").withColumn("state", F.when(F.col("_chosen").isNull(), F.col("state")).when(F.col("id") == F.col("_chosen"), "active").otherwise("retired")).drop("_chosen")


def merge_groups(instant: DataFrame, engine: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Instant hits in their order, then the engine's others in theirs; the engine's data wins."""
    i = instant.select(key, F.col("rank").alias("_i"), *(F.col(c).alias(f"_i_{c}") for c in columns))
    e = engine.select(key, F.col("rank").alias("_e"), *(F.col(c).alias(f"_e_{c}") for c in columns))
    both = i.join(e, key, "full_outer")
    return both.select(key, *(F.coalesce(f"_e_{c}", f"_i_{c}").alias(c) for c in columns), F.col("_i").isNull().cast("int").alias("appended"), F.coalesce("_i", "_e").alias("rank"))


def marker_diff(before: DataFrame, after: DataFrame, marker: str) -> DataFrame:
    """(marker, missing, unknown): how often a placeholder was lost, or came up without having been there."""
    a, b = (x.groupBy(marker).agg(F.count(F.lit(1)).alias(n)) for x, n in ((before, "_a"), (after, "_b")))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return a.join(b, marker, "full_outer").select(marker, F.greatest(n("_a") - n("_b"), F.lit(0)).alias("missing"), F.greatest(n("_b") - n("_a"), F.lit(0)).alias("unknown")).where("missing > 0 OR unknown > 0")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Last value at or before each left row's time (an extension): a union and one window a key."""
    a = left.select(key, at, F.lit(None).cast(right.schema[value].dataType).alias(value), F.lit(1).alias("_left"), F.struct(*left.columns).alias("_row"))
    b = right.select(key, at, value, F.lit(0).alias("_left"), F.lit(None).cast(left.schema).alias("_row"))
    w = Window.partitionBy(key).orderBy(at, "_left").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("as_of", F.last(value, ignorenulls=True).over(w)).where("_left = 1").select("_row.*", "as_of")
