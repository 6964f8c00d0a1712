"""Mixing sources to target weights: hash-random order in each source, cut at exact word budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, spaced, words_in

#: Weights by the place of a source in code-point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) -> (source, source_size, target).

    Targets share `share` times the total by weight, none above `most` times its source; the excess
    is dealt to the others by weight. That fixed point is a water level L with target = min(cap, L * weight):
    in order of cap/weight, the first source whose own candidate level stays below its cap sets L.
    One row per source, so the windows without partitions hold no more than that.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = sizes.select("source", "source_size", order.alias("place")).select(
        "source", "source_size",
        F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")).alias("weight"),
        (F.col("source_size") * F.lit(float(most))).alias("cap"), "place",
    )
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = weighed.select(
        "*",
        ((F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)).alias("level"),
        F.row_number().over(by_ratio).alias("nth"),
    )
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    level = level.select("*", F.min_by(F.when(fits, F.col("level")), F.when(fits, F.col("nth"))).over(whole).alias("final"))
    return level.select(
        "source", F.col("source_size").cast("long").alias("source_size"),
        F.round(F.coalesce(F.least(F.col("cap"), F.col("final") * F.col("weight")), F.col("cap")), 6).alias("target"),
    )


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS,
        size: Column | None = None, buckets: int = 4096, seed: str = "mix-1") -> DataFrame:
    """Words that a mix takes of each document: doc_id, size, source, source_size, target, taken.

    A source whose target is t and whose size is s gives every document t // s whole times (epochs); the
    last, partial epoch takes documents in hash-random order up to the exact budget, the document at
    the cut giving a part of its words. So a source's taken words sum to floor(t), and reruns agree, as the
    order depends on doc_id and seed only.

    The order is a range sort of each source into `buckets` ranges of a uniform hash, and prefix sums are
    those of bucket totals plus those inside a bucket: no task holds a whole source. For 1e11 documents
    a third of which have one source, a bucket holds about 8 million narrow rows, which sort and spill.

    Null text: size 0. Null source: a source of its own, the last in order. Null doc_id: sorts as the empty
    string. Equal doc_ids tie, and the larger size goes first; rows that are equal in all are taken alike
    in sum. Empty table: no rows.
    """
    key = F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), (F.col("text") if size is None else size).alias("size"))
    if size is None:
        rows = spaced(rows, "size", "size").withColumn("size", words_in("size"))
    rows = rows.select("*", key.alias("key")).select("*", (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / F.lit(2**32)).cast("int").alias("bucket"))
    rows = settle(rows)
    parts = rows.groupBy("source", "bucket").agg(F.sum("size").alias("held"))
    wanted = targets(parts.groupBy("source").agg(F.sum("held").alias("source_size")), share, most, weights)
    inside = Window.partitionBy("source").orderBy("bucket")
    parts = parts.select("source", "bucket", (F.sum("held").over(inside) - F.col("held")).alias("before"))
    parts = parts.alias("p").join(wanted.alias("w"), F.col("p.source").eqNullSafe(F.col("w.source"))).select("p.source", "p.bucket", "before", "source_size", "target")
    rows = rows.alias("r").join(parts.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.bucket") == F.col("p.bucket"))).select("r.*", "before", "source_size", "target")
    order = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    start = F.col("before") + F.sum("size").over(order) - F.col("size")
    left = F.floor(F.col("target")).cast("long") - epochs * F.col("source_size") - start
    return rows.select(
        "doc_id", "source", "size", "source_size", "target",
        (epochs * F.col("size") + F.greatest(F.lit(0), F.least(left, F.col("size")))).cast("long").alias("taken"),
    )
