"""N-gram Jaccard join: rare-first prefixes with length, positional and suffix filters, one verification a pair."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, settle, written
from .components import components, joined

#: Counters of shingle frequencies (a power of two) and their pieces; 8 MB in all, whatever the input.
COUNTERS, PIECES = 1 << 21, 32
_GROUP = 16
#: Parts of the hash space whose set sizes the suffix filter compares.
PARTS = 64
#: Ids of up to so many documents (4 MB) may be broadcast to pick texts; more are joined by a shuffle.
FEW_IDS = 1 << 18
#: Bytes up to which a word's hash is a sum of byte hashes times powers; sums of longer words can be made to agree, so these are hashed by blake2.
PLAIN = 64
_FIRST_ID = -(2**63)


def _mix(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """The set of each text as sorted distinct 64-bit hashes of its `width`-word shingles, A-Z lower-cased.

    Works on the bytes of the whole batch: words end at ASCII white space, a word's hash comes from running sums
    of byte hashes times powers of an odd number (words over PLAIN bytes are hashed one by one), and a shingle's from the hashes of its words. Texts with fewer words
    give one shingle of all, texts without any an empty set.
    """
    column = column.cast(pa.large_binary())
    if column.offset or column.null_count:
        column = pa.concat_arrays([column.fill_null(b"")])
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    n_docs = len(column)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]] if n_docs else np.empty(0, np.uint8)
    offsets = offsets - offsets[:1]
    data = np.where((data >= 65) & (data <= 90), data | 32, data)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    inside = ~gap
    first = inside.copy()
    first[1:] &= gap[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    if not len(starts):
        return [np.empty(0, np.uint64)] * n_docs
    # a word ends at the first gap, or where the next text begins
    stop = gap.copy()
    stop[edges] = True
    ends_at = np.flatnonzero(np.append(stop, True))
    ends = ends_at[np.searchsorted(ends_at, starts, "right")]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _powers(_ODD, len(data)), dtype=np.uint64)])
    words = _mix((sums[ends] - sums[starts]) * _powers(_BACK, len(data))[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > PLAIN).tolist():
        words[i] = int.from_bytes(hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest(), "little")
    bound = np.searchsorted(starts, offsets)
    key = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for i in range(width):
        key = (key + words[i:len(words) - width + 1 + i]) * _ODD if len(key) else key
        key = key ^ (key >> np.uint64(29))
    key, out = _mix(key), []
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(key[a:b - width + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            for w in words[a:b]:
                whole = _mix(np.array([whole * _ODD + w], np.uint64))[0]
            out.append(np.array([whole]))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Stretches of about 4 MB of text, which bounds the work arrays."""
    with np.errstate(over="ignore"):
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, a + int(np.searchsorted(np.cumsum(sizes[a:]), 4 << 20)))
                part = batch.slice(a, b - a)
                yield part, shingle_sets(part.column(1), width)
                a = b


def frequencies(texts: DataFrame, width: int) -> np.ndarray:
    """Counts of all shingles of all texts by the top bits of their hash: COUNTERS numbers, the sum of what tasks count.

    They only order shingles, rare first; any order gives exact results. Common shingles, which would make long
    candidate lists, stand out of the even noise of the others that share their counter. Tasks give compressed pieces, which
    are added in groups of tasks and then together, so no group grows with the input faster than its square root.
    """
    shift, piece = np.uint64(64 - (COUNTERS.bit_length() - 1)), COUNTERS // PIECES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.uint32)
        for _, sets in _slices(batches, width):
            every = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            total += np.bincount((every >> shift).astype(np.int64), minlength=COUNTERS).astype(np.uint32)
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([
            pa.array(np.arange(PIECES, dtype=np.int32)), pa.array(np.full(PIECES, task % _GROUP, np.int32)),
            pa.array([zlib.compress(total[i * piece:(i + 1) * piece].tobytes(), 1) for i in range(PIECES)], pa.binary()),
        ], ["piece", "grp", "n"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(piece, np.uint64)
        for chunk in table["n"].chunks:
            for x in chunk:
                raw = zlib.decompress(x.as_py())
                total += np.frombuffer(raw, np.uint32 if len(raw) == 4 * piece else np.uint64)
        return pa.table({"piece": table["piece"][:1], "grp": pa.array([0], pa.int32()), "n": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    schema = "piece int, grp int, n binary"
    parts = texts.select("id", "text").mapInArrow(count, schema)
    rows = parts.groupBy("piece", "grp").applyInArrow(add, schema).groupBy("piece").applyInArrow(add, schema).collect()
    out = np.zeros(COUNTERS, np.uint64)
    for r in rows:
        out[r.piece * piece:(r.piece + 1) * piece] = np.frombuffer(zlib.decompress(bytes(r.n)), np.uint64)
    return np.minimum(out, 2**32 - 1).astype(np.uint32)


def _digest(x: np.ndarray) -> int:
    """64 bits of a set. Among a thousand million different sets, two agree with a probability of 3 %."""
    return int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True)


def _parts(x: np.ndarray) -> list[int]:
    return np.minimum(np.bincount((x >> np.uint64(58)).astype(np.int64), minlength=PARTS), 32767).tolist()


def prefixes(texts: DataFrame, width: int, percent: int, common: np.ndarray) -> DataFrame:
    """(id, x, node, n, parts, prefix): the set's digest and size, sizes of its hash parts, and its rarest shingles in order.

    Two sets of sizes x, y with 100 * overlap >= percent * union have an overlap of percent% of x at least, so their
    first x - ceil(percent * x / 100) + 1 shingles in the common order share one.
    """
    shared, shift = texts.sparkSession.sparkContext.broadcast(common), np.uint64(64 - (COUNTERS.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = shared.value
        for batch, sets in _slices(batches, width):
            first = []
            for s in sets:
                take = len(s) - (percent * len(s) + 99) // 100 + 1 if len(s) else 0
                c = count[(s >> shift).astype(np.int64)]
                first.append(s[np.lexsort((s, c))[:take]].view(np.int64))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array([_digest(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()),
                pa.array([_parts(s) for s in sets], pa.list_(pa.int16())), pa.array(first, pa.list_(pa.int64())),
            ], ["id", "x", "node", "n", "parts", "prefix"])

    return texts.select("id", "text", "x").mapInArrow(run, "id long, x long, node long, n int, parts array<short>, prefix array<long>")


def _least_overlap(n: Column, m: Column, percent: int) -> Column:
    """Smallest overlap of sets of n and m that link: ceil(percent * (n + m) / (100 + percent))."""
    return F.floor((F.lit(percent) * (n + m) + F.lit(99 + percent)) / F.lit(100 + percent))


def _may(percent: int, n: str, at: str, m: str, bt: str) -> Column:
    """Length and positional filters on a shared prefix shingle. A pair that links passes them at its first one."""
    a, b = F.col(n), F.col(m)
    long_enough = (F.least(a, b) * 100 >= F.greatest(a, b) * percent)
    return long_enough & (F.least(a - F.col(at), b - F.col(bt)) >= _least_overlap(a, b, percent))


def _parts_fit(a_parts: str, b_parts: str, a: Column, b: Column, percent: int) -> Column:
    """Suffix filter: the overlap is at most the sum of the smaller counts over the parts of the hash space."""
    most = F.aggregate(F.zip_with(a_parts, b_parts, lambda x, y: F.least(x, y)), F.lit(0), lambda acc, x: acc + x)
    full = F.exists(a_parts, lambda x: x == 32767) & F.exists(b_parts, lambda x: x == 32767)  # counts that were cut bound nothing
    return (most >= _least_overlap(a, b, percent)) | full


def row_id(docs: DataFrame) -> Column:
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(_FIRST_ID))


def row_hash(docs: DataFrame) -> Column:
    return F.xxhash64(docs["text"].cast("string"))


def near_sets(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The sets of all documents and the label of each set that links with another.

    Returns members (id, x: hash of the text, node, n) and labels (node, label); sets without links have no label.
    """
    texts = docs.select(row_id(docs).alias("id"), F.col("text").cast("string").alias("text"), row_hash(docs).alias("x"))
    rows = written(prefixes(texts, width, percent, frequencies(texts, width)), "prefixes")
    # Copies: equal sets are one node from here on, whatever their number.
    nodes = rows.where("n > 0").groupBy("node").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min_by("parts", "id").alias("parts"), F.min_by("prefix", "id").alias("prefix"))
    entries = nodes.select("node", "n", F.posexplode("prefix").alias("at", "token")).select("token", "node", (F.shiftleft(F.col("n").cast("long"), 32) + F.col("at")).alias("na"))
    # A shingle of one node makes no candidate; its smallest node is the pivot of the others.
    pivot = settle(entries.groupBy("token").agg(F.min("node").alias("pivot"), F.max("node").alias("other")).where("pivot != other").select("token", "pivot"))
    shared = written(entries.join(pivot, "token").select("token", "node", *_place("na"), "pivot"), "shared")
    # No positional filter here: a pair may pass it at another shingle, and every pair that is connected now spares its group many pairs below.
    star = shared.where("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    links, tried = verified(star, texts, nodes, width, percent)
    labels = components(links)
    # What is left: pairs that share a shingle and aren't connected yet. A shingle's largest component is `main`;
    # the pairs have one side outside of it, so a group of near copies is never paired with itself.
    placed = shared.select("token", "node", "n", "at").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    main = placed.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count(F.lit(1)).alias("k")).where("k > 1").select("token", "main")
    placed = written(placed.join(main, "token").join(nodes.select("node", "parts"), "node"), "placed")
    outer = placed.where("label != main").select("token", *(F.col(c).alias(f"a_{c}") for c in ("node", "n", "at", "label", "parts")))
    may = (F.col("label") != F.col("a_label")) & ((F.col("label") == F.col("main")) | (F.col("node") < F.col("a_node"))) & _may(percent, "n", "at", "a_n", "a_at")
    pairs = outer.alias("o").join(placed.alias("p"), (F.col("o.token") == F.col("p.token")) & may & _parts_fit("parts", "a_parts", F.col("n"), F.col("a_n"), percent))
    rest = pairs.select(F.col("a_node").alias("a"), F.col("node").alias("b"))
    more, _ = verified(rest, texts, nodes, width, percent, tried)
    members = settle(rows.select("id", "x", "node", "n"))
    discard(rows, shared, placed)
    return members, joined(labels, more)


def _place(na: str) -> list[Column]:
    """Size and place, taken apart."""
    return [F.shiftright(na, 32).cast("int").alias("n"), F.col(na).bitwiseAND(0xFFFFFFFF).cast("int").alias("at")]


def verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, width: int, percent: int, tried: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) that link, and all distinct pairs that were tried.

    Each pair is met once. The suffix filter bounds the overlap by the sizes of the sets' parts, hash range by hash range.
    Only sets that are still needed are made again from their texts, and the overlap is counted on whole sets.
    """
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if tried is not None:
        pairs = pairs.join(tried, ["a", "b"], "left_anti")
    small = nodes.select("node", "id", "n", "parts")
    one, two = (small.toDF(c, f"{c}_id", f"{c}_n", f"{c}_parts") for c in "ab")
    a, b = F.col("a_n"), F.col("b_n")
    sized = F.least(a, b) * 100 >= F.greatest(a, b) * percent
    pairs = settle(pairs.join(one, "a").join(two, "b").select("a", "b", "a_id", "b_id", "a_n", "b_n", (sized & _parts_fit("a_parts", "b_parts", a, b, percent)).alias("fit")))
    fit = pairs.where("fit")
    needed = fit.select(F.col("a").alias("node"), F.col("a_id").alias("id")).union(fit.select("b", "b_id")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _slices(batches, width):
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "s"])

    ids = settle(needed.select("id").distinct())
    if ids.count() <= FEW_IDS:
        ids = F.broadcast(ids)
    sets = texts.join(ids, "id", "left_semi").select("id", "text").mapInArrow(run, "node long, s array<long>")
    sets = written(sets.join(needed.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")
    got = fit.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    overlap = F.size(F.array_intersect("sa", "sb"))
    links = got.where(overlap * 100 >= (F.col("a_n") + F.col("b_n") - overlap) * percent).select("a", "b")
    links = settle(links)
    discard(sets)
    return links, pairs.select("a", "b")


def linked(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: components of documents whose shingle sets link.

    Words are runs without ASCII white space, A-Z lower-cased; a document's set is its distinct `width`-word shingles, or its
    whole sequence of words if that is shorter. Two documents link if 100 * intersection >= percent * union.
    component_id is the smallest doc_id reachable by links, its own included.

    Candidate pairs share one of their rarest shingles. First, each is tried against the pivot of its shingle, which
    connects groups of near copies by as many trials as they have members; then the pairs across what isn't connected
    yet. So every link between different sets is either found or lies within a component already, and copies cost nothing.

    Null or empty texts, and texts of white space, have an empty set and link with nothing: component_id is their doc_id. A null
    doc_id links like others, and its component_id is null unless a doc_id is reachable. Rows of equal doc_id are told apart
    by their sets. An empty table gives no rows.
    """
    placed = _placed(docs, width, percent)
    real = F.when(F.col("id") != _FIRST_ID, F.col("id"))
    # settled, so that the join below is a plain one, whose large groups adaptive execution may split
    least = settle(placed.where("n > 0").groupBy("label").agg(F.min(real).alias("component_id")))
    out = placed.join(least, "label", "left")
    return out.select(real.alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(real).alias("component_id"))


def _placed(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, x, node, n, label) of every row; a set without links is its own label."""
    members, labels = near_sets(docs, width, percent)
    return settle(members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))


def representatives(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, with all their columns, of which one stays for each component of `linked`: that of the least doc_id (null
    first), then the least text hash. Rows without shingles link with nothing and stay. Of rows that repeat both doc_id
    and text one stays, with the other columns of any of them. An empty table gives no rows.
    """
    placed = _placed(docs, width, percent)
    first = placed.where("n > 0").groupBy("label").agg(F.min(F.struct("id", "x")).alias("k")).select("k.id", "k.x")
    stay = settle(first.union(placed.where("n = 0").select("id", "x")).distinct())
    again = settle(placed.groupBy("id", "x").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("id", "x"))
    names = {c.lower() for c in docs.columns}
    key, x = (c + "_" * (max(map(len, names)) + 1) for c in ("id", "x"))
    keyed = docs.withColumns({key: row_id(docs), x: row_hash(docs)}).join(stay.toDF(key, x), [key, x], "left_semi")
    if not again.isEmpty():
        again = again.toDF(key, x)
        keyed = keyed.join(again, [key, x], "left_anti").union(keyed.join(again, [key, x], "left_semi").dropDuplicates([key, x]))
    return keyed.select(*docs.columns)
