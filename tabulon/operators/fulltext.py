"""A stored inverted index: postings in blocks of documents, laid out by term, with the most a block can score."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import words
from ..lineage import shared_dir
from ..sources.versions import Versions

#: Folders of terms; documents and words that a block has at most (a document of more words is a block by itself), and postings handed on at once.
BUCKETS, BLOCK_DOCS, BLOCK_WORDS, _POSTINGS = 64, 4096, 1 << 22, 1 << 18
#: Blocks from which on a query joins them instead of naming them in a filter.
MANY_BLOCKS = 1 << 16
K1, B = 1.2, 0.75


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _blocks(block_docs: int, block_words: int, average: float):
    """Of batches (id, w: words): each block's postings, one row a term, its documents in their order as lists side by side."""
    def postings(block: int, ids: pa.Array, w: pa.ListArray) -> Iterator[pa.RecordBatch]:
        n = len(ids)
        length = np.diff(w.offsets.to_numpy()).astype(np.int32)
        coded = w.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        if not len(code):
            return
        doc = np.repeat(np.arange(n, dtype=np.int32), length)
        place = np.arange(len(code)) - np.repeat(np.cumsum(length, dtype=np.int64) - length, length)
        order = np.argsort(code, kind="stable")  # words stand by document and place, and so they do within each term
        code, doc, place = code[order], doc[order], place[order].astype(np.int32)
        new = np.append(True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1]))
        start = np.flatnonzero(new)
        tf, doc, code = np.diff(np.append(start, len(new))).astype(np.int32), doc[start], code[start]
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / average))
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        ends, most = np.append(first[1:], len(code)), np.maximum.reduceat(part, first)
        at = 0
        while at < len(first):  # terms of about _POSTINGS postings at once
            to = max(at + 1, int(np.searchsorted(ends, first[at] + _POSTINGS, "right")))
            a, z = first[at], ends[to - 1]
            lists = lambda values: pa.ListArray.from_arrays(pa.array(np.append(first[at:to], z) - a, pa.int32()), values)  # noqa: B023, E731
            p, q = start[a], start[z] if z < len(start) else len(place)
            marks = np.append(start[first[at:to]], q) - p
            yield pa.RecordBatch.from_arrays([
                coded.dictionary.take(pa.array(code[first[at:to]])), pa.array(np.full(to - at, block)), pa.array(ends[at:to] - first[at:to]), pa.array(most[at:to]),
                lists(pa.array(doc[a:z])), lists(ids.take(pa.array(doc[a:z]))), lists(pa.array(tf[a:z])), lists(pa.array(length[doc[a:z]])),
                lists(pa.array((start[a:z] - np.repeat(start[first[at:to]], ends[at:to] - first[at:to])).astype(np.int32))), pa.ListArray.from_arrays(pa.array(marks, pa.int32()), pa.array(place[p:q])),
            ], ["term", "block", "n", "most", "docs", "ids", "tfs", "lens", "starts", "places"])
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, docs, size = TaskContext.get().partitionId() << 31, [], 0, 0

        def whole() -> Iterator[pa.RecordBatch]:
            return postings(block, pa.concat_arrays([b.column(0) for b in held]), pa.concat_arrays([b.column(1) for b in held]))

        for batch in batches:
            ends, at = batch.column(1).offsets.to_numpy(), 0
            while at < len(batch):
                fits = int(np.searchsorted(ends, ends[at] + block_words - size, "right")) - 1 - at
                take = min(len(batch) - at, block_docs - docs, max(fits, not held))
                if take:
                    held.append(batch.slice(at, take))
                    docs, size, at = docs + take, size + int(ends[at + take] - ends[at]), at + take
                if docs >= block_docs or at < len(batch):
                    yield from whole()
                    block, held, docs, size = block + 1, [], 0, 0
        if held:
            yield from whole()
        pa.default_memory_pool().release_unused()

    return run


class FullText:
    """Postings of a text column, built once and read by term.

    One row holds a term's postings in one block of documents: (bucket, term, block, n, most, docs, ids, tfs, lens, starts, places), where lists have an entry for each
    document (its number in the block, its id, number of occurrences, words of the document, where its places start), `places` are those of one document after another, and
    `most` is the largest BM25 part without the term's weight. Documents are dealt to blocks as they are read, so that no word is shuffled: a task
    turns block after block into postings in Arrow. A block bounds a row whatever the term, and a term of all documents is as many rows as
    there are blocks. Rows are written to a folder for each bucket of terms, sorted by term: a query reads the
    folders of its terms, in them the row groups that may hold the terms, and of those only the columns it needs.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.versions = Versions(spark, path)

    def build(self, df: DataFrame, id_col: str, text: str, block_docs: int = BLOCK_DOCS, block_words: int = BLOCK_WORDS) -> FullText:
        """A new version over all rows: null ids are left out, a null text has no words, rows of one id count as documents of their own."""
        tasks = df.sparkSession.sparkContext.defaultParallelism
        few = df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where("id IS NOT NULL")
        few = few.repartition(tasks) if few.rdd.getNumPartitions() < tasks else few
        docs = few.select("id", words(F.coalesce(F.col("text"), F.lit(""))).alias("w"))
        total = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.size("w")), F.lit(0.0)).alias("avg")).first()
        kind = docs.schema["id"].dataType.simpleString()
        rows = docs.mapInArrow(_blocks(block_docs, block_words, float(total.avg or 1)), f"term string, block long, n long, most double, docs array<int>, ids array<{kind}>, tfs array<int>, lens array<int>, starts array<int>, places array<int>")
        rows = rows.withColumn("bucket", bucket_of(F.col("term")))

        def write(path: str) -> None:
            rows.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").option("parquet.block.size", 8 << 20).option("compression", "zstd").parquet(path)

        self.versions.write({"postings": write}, {"docs": total.n, "words": float(total.avg), "schema": rows.schema.jsonValue()})
        return self

    def postings(self) -> DataFrame:
        return self.versions.table("postings", schema=StructType.fromJson(self.versions.notes()["schema"]))

    def rows(self, terms: Sequence[str], columns: Sequence[str] = ("term", "block", "n", "most", "docs", "ids", "tfs", "lens", "starts", "places")) -> DataFrame:
        """Rows of some terms: buckets as a partition filter, terms as a pushed one."""
        spark, t = self.versions.spark, sorted(set(terms))
        table = self.postings()
        if not t:
            return table.select(*columns).limit(0)
        buckets = [r.b for r in spark.createDataFrame([(x,) for x in t], "term string").select(bucket_of(F.col("term")).alias("b")).distinct().collect()]
        return table.where(F.col("bucket").isin(*buckets) & F.col("term").isin(*t)).select(*columns)

    def hits(self, terms: Sequence[str], columns: Sequence[str] = ("doc", "id", "tf", "len"), rows: DataFrame | None = None) -> DataFrame:
        """(term, block, and of doc, id, tf, len, places the named ones) of every document that has one of the terms, in all their rows or in some."""
        rows = self.rows(terms) if rows is None else rows
        lists = [c if c == "places" else f"{c}s" for c in columns]
        if "places" in columns:  # those of each document
            rows = rows.withColumn("places", F.zip_with("starts", "tfs", lambda start, n: F.slice("places", start + 1, n)))
        each = rows.select("term", "block", F.inline(F.arrays_zip(*lists)))
        return each.select("term", "block", *(F.col(a).alias(c) for a, c in zip(lists, columns, strict=True)))

    def boolean(self, include: Sequence[str], exclude: Sequence[str] = (), join: str = "and") -> DataFrame:
        """Ids of documents with all (or any) of the words and none of the excluded; no words to include: nothing."""
        want, bad = sorted(set(include)), sorted(set(exclude))
        got = self.hits([*want, *bad], ("doc", "id")).groupBy("block", "doc", "id").agg(F.count_distinct(F.when(F.col("term").isin(*want), F.col("term"))).alias("n"), F.max(F.col("term").isin(*bad) if bad else F.lit(False)).alias("bad"))
        return got.where(~F.col("bad") & (F.col("n") >= (len(want) if join == "and" else 1))).select("id")

    def staged(self, tokens: Sequence[str], variants: Sequence[Sequence[str]] | None = None) -> DataFrame:
        """(id, stage): 0 the tokens as a phrase, 1 all of them, 2 any; each in any of its variants but in the phrase."""
        forms = [list(v) for v in variants or [[t] for t in tokens]]
        asked = sorted({x for v in forms for x in v} | set(tokens))
        by = self.hits(asked, ("doc", "id", "places")).groupBy("block", "doc", "id").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("at"))
        has = [F.arrays_overlap(F.map_keys("at"), F.array(*map(F.lit, v))) for v in forms]
        every, some = has[0], has[0]
        for h in has[1:]:
            every, some = every & h, some | h
        places = [F.coalesce(F.element_at("at", F.lit(t)), F.array().cast("array<int>")) for t in tokens]

        def follows(p: Column) -> Column:
            out = F.lit(True)
            for k, later in enumerate(places[1:], 1):
                out = out & F.array_contains(later, p + k)
            return out

        phrase = F.exists(places[0], follows)
        return by.select("id", F.when(phrase, 0).when(every, 1).when(some, 2).alias("stage")).where("stage IS NOT NULL")

    def _weights(self, terms: Sequence[str]) -> dict[str, float]:
        notes = self.versions.notes()
        df = {r.term: r.n for r in self.rows(terms, ("term", "n")).groupBy("term").agg(F.sum("n").alias("n")).collect()}
        return {t: math.log(1 + (notes["docs"] - n + 0.5) / (n + 0.5)) for t, n in df.items()}

    def _scored(self, hits: DataFrame, weights: dict[str, float]) -> DataFrame:
        average = self.versions.notes()["words"] or 1.0
        weight = F.element_at(F.create_map(*(F.lit(x) for t, w in weights.items() for x in (t, float(w)))), F.col("term"))
        part = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(average)))
        return hits.withColumn("part", part).groupBy("block", "doc", "id").agg(F.sum("part").alias("score"), F.count(F.lit(1)).cast("int").alias("matched")).drop("block", "doc")

    def bm25(self, terms: Sequence[str]) -> DataFrame:
        """(id, score, matched) of every document with a term, by the published formula."""
        weights = self._weights(terms)
        if not weights:
            return self.hits(terms).select("id", F.lit(0.0).alias("score"), F.lit(0).alias("matched"))
        return self._scored(self.hits(list(weights)), weights)

    def top(self, terms: Sequence[str], k: int, seeds: int = 4) -> DataFrame:
        """The k best by BM25, ties to the smaller id; exact, with blocks that can't reach the k-th score left unread.

        A block's bound is the sum over terms of weight times `most`. The documents of the `seeds` blocks of the highest bounds give a
        threshold; hits are read of blocks whose bound reaches it. Of these at most MANY_BLOCKS come to the driver: if there are more, the threshold filters a join instead.
        """
        weights = self._weights(terms)
        if not weights or k < 1:
            return self.hits([]).select("id", F.lit(0.0).alias("score"), F.lit(0).alias("matched"))
        weight = F.element_at(F.create_map(*(F.lit(x) for t, w in weights.items() for x in (t, float(w)))), F.col("term"))
        bounds = self.rows(list(weights), ("term", "block", "most")).groupBy("block").agg(F.sum(weight * F.col("most")).alias("bound"))
        first = [r.block for r in bounds.orderBy(F.desc("bound"), "block").limit(seeds).collect()]
        all_rows = self.rows(list(weights))
        seen = self._scored(self.hits([], rows=all_rows.where(F.col("block").isin(*first))), weights).orderBy(F.desc("score"), "id").limit(k).collect()
        threshold = seen[-1].score if len(seen) == k else 0.0
        open_ = bounds.where(F.col("bound") >= threshold * (1 - 1e-9)).select("block")
        near = [r.block for r in open_.limit(MANY_BLOCKS).collect()]
        if len(near) < MANY_BLOCKS:
            all_rows = all_rows.where(F.col("block").isin(*near))
        else:
            all_rows = all_rows.join(open_, "block", "left_semi")
        return self._scored(self.hits([], rows=all_rows), weights).orderBy(F.desc("score"), "id").limit(k)

    def joined(self, docs: DataFrame, id_col: str, terms: Sequence[str]) -> DataFrame:
        """The documents of a table that have all of the words, with `score`: the index is read first, its ids then join the table."""
        want = sorted(set(terms))
        found = self.bm25(want).where(F.col("matched") == len(want))
        return docs.join(found.select(F.col("id").alias(id_col), "score"), id_col)


_STORED: dict[tuple[str, str], FullText] = {}


def stored(spark: SparkSession, df: DataFrame, id_col: str, text: str, name: str) -> FullText:
    """The index of a table in the shared folder, built when it is first asked for in an application."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _STORED:
        safe = f"{abs(hash(name)):x}"
        _STORED[key] = FullText(spark, f"{shared_dir(spark).rstrip('/')}/fulltext-{spark.sparkContext.applicationId}-{safe}").build(df, id_col, text)
    return _STORED[key]
