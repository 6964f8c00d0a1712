"""Sharding by fixed virtual slots: records hash into slots, and a versioned map gives each slot a shard."""

from __future__ import annotations

import heapq
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import exists, settle

SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """The shard of each virtual slot. An edit gives the next version; records never change their slot."""

    version: int
    shards: int
    owner: tuple[int, ...]

    @staticmethod
    def even(shards: int, slots: int = SLOTS) -> SlotMap:
        """Version 0: slots dealt in turn."""
        return SlotMap(0, shards, tuple(i % shards for i in range(slots)))

    def loads(self, weight: Sequence[int]) -> list[int]:
        out = [0] * self.shards
        for slot, shard in enumerate(self.owner):
            out[shard] += weight[slot]
        return out

    def rebalanced(self, weight: Sequence[int], slack: float = 0.001) -> SlotMap:
        """Move slots from full shards to empty ones until each is within `slack` of the mean, or none helps.

        The fullest shard gives the slot that leaves the pair most even to the emptiest; each step
        lowers the sum of squares, so it ends. Then pairs of slots are swapped, which evens out what single slots can't.
        """
        owner, load = list(self.owner), self.loads(weight)
        held: list[list[int]] = [[] for _ in range(self.shards)]
        for slot, shard in enumerate(owner):
            held[shard].append(slot)
        mean = sum(load) / self.shards
        for _ in range(4 * len(owner)):
            full, low = max(range(self.shards), key=load.__getitem__), min(range(self.shards), key=load.__getitem__)
            gap = load[full] - load[low]
            if load[full] - mean <= slack * mean and mean - load[low] <= slack * mean:
                break
            best = min(((abs(gap - 2 * weight[s]), s, None) for s in held[full] if 0 < weight[s] < gap), default=None)
            swap = self._swap(held[full], held[low], weight, gap)
            if swap and (not best or swap[0] < best[0]):
                best = swap
            if not best or best[0] >= gap:
                break
            _, give, take = best
            for slot, here, there in ((give, full, low), (take, low, full)):
                if slot is not None:
                    held[here].remove(slot)
                    held[there].append(slot)
                    owner[slot] = there
                    load[here] -= weight[slot]
                    load[there] += weight[slot]
        return SlotMap(self.version + 1, self.shards, tuple(owner))

    @staticmethod
    def _swap(ours: list[int], theirs: list[int], weight: Sequence[int], gap: int) -> tuple[int, int, int] | None:
        """The pair of slots whose swap leaves the smallest gap, by a walk over both in order of weight."""
        a, b = sorted(ours, key=weight.__getitem__), sorted(theirs, key=weight.__getitem__)
        best, i, j = None, 0, 0
        while i < len(a) and j < len(b):
            d = weight[a[i]] - weight[b[j]]
            if d > 0 and (best is None or abs(gap - 2 * d) < best[0]):
                best = (abs(gap - 2 * d), a[i], b[j])
            if 2 * d < gap:
                i += 1
            else:
                j += 1
        return best

    def grown(self, weight: Sequence[int]) -> SlotMap:
        """One more shard, which takes slots from the fullest shards only, up to its fair share."""
        owner, load = list(self.owner), self.loads(weight)
        fair, took = sum(weight) / (self.shards + 1), 0
        heaps = [[(-weight[s], s) for s, o in enumerate(owner) if o == k] for k in range(self.shards)]
        for h in heaps:
            heapq.heapify(h)
        while True:
            full = max((k for k in range(self.shards) if heaps[k]), key=load.__getitem__, default=None)
            if full is None:
                break
            w, slot = heapq.heappop(heaps[full])
            if took - w > fair:
                continue
            owner[slot] = self.shards
            took -= w
            load[full] += w
            if took >= fair:
                break
        return SlotMap(self.version + 1, self.shards + 1, tuple(owner))

    def shard_of(self, slot: Column) -> Column:
        """An array literal's element: no join, whatever the number of rows."""
        return F.element_at(F.from_json(F.lit(json.dumps(self.owner)), "array<int>"), (slot + 1).cast("int"))

    def save(self, spark: SparkSession, path: str) -> None:
        """A row per version, appended; the largest version holds."""
        spark.sql("SELECT CAST({v} AS INT) AS version, CAST({n} AS INT) AS shards, {o} AS owner", v=self.version, n=self.shards, o=json.dumps(self.owner)).write.mode("append").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        rows = spark.read.parquet(path)
        row = (rows if version is None else rows.where(F.col("version") == version)).orderBy(F.desc("version")).first()
        return SlotMap(row.version, row.shards, tuple(json.loads(row.owner)))


def slot_of(*key: Column, slots: int = SLOTS) -> Column:
    """The fixed virtual slot of a record, by a hash of its key; nulls in it are like any value."""
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, copy): a row for each of `docs`; rows that agree in the first three are numbered from 0.

    They are counted, which is combined before the shuffle, and dealt out again by runs of 65,536 numbers, so that no task makes all
    rows of a frequent one.
    """
    text = F.col("text")
    d = docs.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    d = d.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    d = d.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n - 1) DIV 65536"))).alias("run")).repartition("doc_id", "text_crc32", "run")
    first = F.col("run") * 65536
    return d.select("doc_id", "size", "text_crc32", F.explode(F.sequence(first, F.least(F.col("n"), first + 65536) - 1)).alias("copy"))


def slot_weights(rows: DataFrame, size: str = "size", slot: str = "vslot", slots: int = SLOTS) -> list[int]:
    """Bytes of each slot: at most `slots` rows come to the driver, whatever the input."""
    found = {r[0]: r[1] for r in rows.groupBy(slot).agg(F.sum(size)).collect()}
    return [int(found.get(i) or 0) for i in range(slots)]


def shard_documents(docs: DataFrame, shards: int = 40, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Deal rows into shards of near equal bytes: doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, version.

    The law is `bytes`. A record's virtual slot is a hash of doc_id, crc and its number among equal rows, and never changes; the
    map from slots to shards starts even (version 0) and is edited by the measured bytes of slots (version 1). With
    `path`, versions are stored there and the newest stored one is what gets edited.
    `slot` is a row's place in its shard, without gaps from 0, by (vslot, doc_id, crc); `vslot` the virtual slot.
    Places come from counts of each virtual slot, so no task holds a shard.

    Null text counts no bytes and has a null crc. Repeated and null doc_ids and repeated rows are spread over the slots like
    others. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = settle(numbered(docs).select("doc_id", "size", "text_crc32", slot_of(F.col("doc_id"), F.col("text_crc32"), F.col("copy"), slots=slots).alias("vslot")))
    held = rows.groupBy("vslot").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    weight, count = [0] * slots, [0] * slots
    for r in held:
        weight[r.vslot], count[r.vslot] = int(r["size"]), r.n
    old = SlotMap.load(spark, path) if path and exists(spark, path) else SlotMap.even(shards, slots)
    if path and not old.version:
        old.save(spark, path)
    new = old.rebalanced(weight)
    if path:
        new.save(spark, path)
    first, seen = [0] * slots, [0] * new.shards
    for i in range(slots):
        first[i] = seen[new.owner[i]]
        seen[new.owner[i]] += count[i]
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), new.shard_of(F.col("vslot")).alias("shard"),
        (F.element_at(F.from_json(F.lit(json.dumps(first)), "array<bigint>"), F.col("vslot") + 1) + place - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "vslot", F.lit(new.version).alias("map_version"),
    )
