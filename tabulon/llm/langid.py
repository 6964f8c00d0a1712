"""Language ID by prediction by partial matching: code lengths under byte context trees of each language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import RowTable

#: Bytes of context, the bounds of the training sample of each language, and of the samples of all languages together.
ORDER, TRAIN_DOCS, TRAIN_BYTES, ALL_BYTES = 3, 1000, 1 << 20, 64 << 20
#: Values of lang from which on `fit` refuses the table; none is ever left out.
MOST_LANGS = 4096
#: A text of at least LEAST_BYTES is in no learned language if it needs FOREIGN times the bits a byte that its best language's texts need.
LEAST_BYTES, FOREIGN = 200, 2.5
#: Bytes scored at once; a bound of memory that changes no result.
SLICE = 1 << 18
_PAD = b"\n"


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    """The k bytes that end at each place from k - 1 on, as whole numbers."""
    out = np.zeros(max(0, len(data) - k + 1), np.uint64)
    for i in range(k):
        out = out << np.uint64(8) | data[i:len(data) - k + 1 + i]
    return out


class ContextTrees:
    """Frozen statistics of each language, as exact code lengths in bits.

    In a context seen n times with d different next bytes, a byte seen c times there costs -log2(c / (n + d)), and
    escape to the next shorter context costs -log2(d / (n + d)); unseen contexts are left without cost. Behind the
    empty context every byte costs 8 bits. For each order the lengths of all byte strings seen in any language
    are worked out through the whole chain, so that scoring looks up one row where the longest string is known.
    """

    def __init__(self, texts: dict[str, list[bytes]], order: int = ORDER):
        self.order, self.langs = order, sorted(texts)
        joined = {l: np.frombuffer(b"".join(_PAD * order + t for t in texts[l]), np.uint8).astype(np.uint64) for l in self.langs}
        self.short: list[np.ndarray] = []  # orders 0 and 1, dense
        self.grams: dict[int, RowTable] = {}
        self.cost: dict[int, np.ndarray] = {}
        self.contexts: dict[int, RowTable] = {}
        self.escape: dict[int, np.ndarray] = {}
        self.usual = np.full(len(self.langs), 8.0)
        if not self.langs:
            return
        base = np.full((1, len(self.langs)), 8.0, np.float32)
        for k in range(order + 1):
            seen = [np.unique(_grams(joined[l], k + 1), return_counts=True) for l in self.langs]
            every = np.arange(1 << 8 * (k + 1), dtype=np.uint64) if k < 2 else np.unique(np.concatenate([g for g, _ in seen]))
            cost = np.zeros((len(every), len(self.langs)), np.float32)
            ctx_all = np.unique(every >> np.uint64(8))
            escape = np.zeros((len(ctx_all), len(self.langs)), np.float32)
            lower = (base[np.zeros(len(every), np.int64)] if k == 0 else self.short[0][(every & np.uint64(255)).astype(np.int64)] if k == 1
                     else self.short[1][(every & np.uint64(65535)).astype(np.int64)] if k == 2 else self.cost[k - 1][self.grams[k - 1].find(every & np.uint64((1 << 8 * k) - 1))])
            for j, (grams, counts) in enumerate(seen):
                if not len(grams):
                    cost[:, j] = lower[:, j]
                    continue
                ctx, inverse = np.unique(grams >> np.uint64(8), return_inverse=True)
                n, d = np.bincount(inverse, counts), np.bincount(inverse)
                escape[np.searchsorted(ctx_all, ctx), j] = -np.log2(d / (n + d))
                cost[:, j] = lower[:, j] + escape[np.searchsorted(ctx_all, every >> np.uint64(8)), j]
                cost[np.searchsorted(every, grams), j] = -np.log2(counts / (n + d)[inverse])
            if k < 2:
                self.short.append(cost)
            else:
                self.grams[k], self.cost[k], self.contexts[k], self.escape[k] = RowTable(every), cost, RowTable(ctx_all), escape
        for j, l in enumerate(self.langs):  # the median text of each language: junk in the sample doesn't move it
            each = [t for t in texts[l] if len(t) >= LEAST_BYTES] or [t for t in texts[l] if t]
            if each:
                self.usual[j] = np.median(self.score(each)[:, j] / [len(t) for t in each])

    def lengths(self, data: np.ndarray) -> np.ndarray:
        """Bits of each byte from place `order` on, a column for each language."""
        n, k = len(data) - self.order, self.order
        if k < 2:
            return self.short[k][_grams(data, k + 1).astype(np.int64)]
        row = self.grams[k].find(_grams(data, k + 1))
        out = self.cost[k][row]
        left, total = np.flatnonzero(row < 0), None
        while len(left):
            # escape from the context of k bytes, if it's known, and try one byte less
            whole = np.zeros(len(left), np.uint64)
            for i in range(k, -1, -1):
                whole = whole << np.uint64(8) | data[left + self.order - i]
            ctx = self.contexts[k].find(whole >> np.uint64(8))
            more = np.where((ctx >= 0)[:, None], self.escape[k][ctx], np.float32(0))
            total = more if total is None else total + more
            k -= 1
            small = whole & np.uint64((1 << 8 * (k + 1)) - 1)
            if k == 1:
                out[left] = total + self.short[1][small.astype(np.int64)]
                break
            row = self.grams[k].find(small)
            known = row >= 0
            out[left[known]] = total[known] + self.cost[k][row[known]]
            left, total = left[~known], total[~known]
        assert len(out) == n
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text under each language, in bits."""
        out, pad = np.zeros((len(texts), len(self.langs))), _PAD * self.order
        group: list[int] = []
        held = 0
        for i, t in enumerate([*texts, None]):
            if group and (t is None or held + len(t) > SLICE):
                data = np.frombuffer(b"".join(pad + texts[j] for j in group), np.uint8).astype(np.uint64)
                bits = self.lengths(data)
                ends = np.cumsum([len(texts[j]) + self.order for j in group])
                starts = np.concatenate([[0], ends[:-1]])
                for s in ends[:-1]:  # places of the pads between texts cost nothing
                    bits[s - self.order:s] = 0
                out[group] = np.add.reduceat(bits, starts, axis=0, dtype=np.float64)
                group, held = [], 0
            if t is None or not t:
                continue
            if len(t) > SLICE:
                whole = pad + t
                out[i] = sum(self.lengths(np.frombuffer(whole[a:a + SLICE + self.order], np.uint8).astype(np.uint64)).sum(0, dtype=np.float64) for a in range(0, len(t), SLICE))
            else:
                group.append(i)
                held += len(t) + self.order
        return out


def _bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; null ids are not held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, order: int = ORDER, most_docs: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES) -> ContextTrees:
    """Fit on at most `most_docs` whole texts and `most_bytes` bytes of each lang, in hash order, from rows not held out.

    The first pass counts the rows of each lang; if there are more than ALL_BYTES / `most_bytes`, each one's bounds shrink so that the sample of all stays
    within ALL_BYTES, and every lang is learned from one text at least. The second brings ids, sizes and hashes of about twice the wanted number
    to the driver, which cuts them at the bounds; the third brings those texts. Of texts of more than a quarter of the
    byte bound the sample has the first part. So the driver holds a bounded sample, whatever the input. Rows of null doc_id take no part.
    """
    rows = docs.select(F.col("doc_id"), F.col("text"), F.col("lang").cast("string").alias("lang")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    rows = rows.where(~held_out(F.col("doc_id")) & (F.octet_length("text") > 0)).withColumn("h", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)))
    count = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MOST_LANGS + 1).collect()}
    if len(count) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} values of lang: this is no column of languages")
    if not count:
        return ContextTrees({}, order)
    shrunk = min(1.0, ALL_BYTES / (most_bytes * len(count)))
    most_bytes, most_docs = max(64, int(most_bytes * shrunk)), max(1, int(most_docs * shrunk))
    part = F.when(F.octet_length("text") <= most_bytes // 4, F.col("text")).otherwise(F.substring("text", 1, most_bytes // 16))
    rows = rows.select("lang", part.alias("text"), F.octet_length(part).alias("size"), "h")
    cut = {lang: min(1 << 40, int((1 << 40) * (2 * most_docs + 50) / n)) for lang, n in count.items()}

    def below(cut: dict[str, int]) -> Column:
        return F.col("h") < F.element_at(F.create_map(*(x for lang, c in cut.items() for x in (F.lit(lang), F.lit(c).cast("long")))), F.col("lang"))

    sizes: dict[str, list] = {}
    for r in sorted(rows.where(below(cut)).select("lang", "h", "size").collect(), key=lambda r: (r.lang, r.h, r["size"])):
        sizes.setdefault(r.lang, []).append(r)
    for lang, each in sizes.items():
        total, n = 0, 0
        while n < min(len(each), most_docs) and total + each[n]["size"] <= most_bytes:
            total += each[n]["size"]
            n += 1
        cut[lang] = each[n].h if n < len(each) else each[-1].h + 1
    texts: dict[str, list[bytes]] = {}
    for r in sorted(rows.where(below(cut)).select("lang", "h", "text").collect(), key=lambda r: (r.lang, r.h, r.text)):
        texts.setdefault(r.lang, []).append(_bytes(r.text))
    return ContextTrees(texts, order)


def identify(docs: DataFrame, trees: ContextTrees) -> DataFrame:
    """doc_id, lang_pred, score, bits_per_byte of every row; only the text decides.

    lang_pred is the language of the shortest code. The score is its share of 2 ** -(excess bits a byte, times at most
    24 bytes), so 1 / number of languages where all fit alike. `und` with score 0 if the text is null, has no letter, or
    nothing was learned; ties go to the smaller name. Null doc_ids and repeated rows are scored like others. Texts are
    scored whole, in slices of bounded memory. The trees are bounded by the training sample and broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = part.column(1).to_pylist()
                fine = np.array([has_letter(t) for t in texts], bool) & bool(model.langs)
                raw = [_bytes(t) if f else b"" for t, f in zip(texts, fine, strict=True)]
                sizes = np.maximum(1, np.array([len(t) for t in raw]))
                if model.langs:
                    bits = model.score(raw) / sizes[:, None]
                    best = bits.argmin(1)
                    least = bits[np.arange(len(bits)), best]
                    share = 1 / np.exp2((least[:, None] - bits) * np.minimum(sizes, 24)[:, None]).sum(1)
                else:
                    best, least, share = np.zeros(len(raw), int), np.zeros(len(raw)), np.zeros(len(raw))
                pred = [model.langs[b] if f else "und" for b, f in zip(best, fine, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(pred, pa.string()), pa.array(np.where(fine, share, 0.0)), pa.array([float(x) if f else None for x, f in zip(least, fine, strict=True)], pa.float64()),
                ], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, bits_per_byte double")


def accepted(docs: DataFrame, trees: ContextTrees, foreign: float = FOREIGN) -> DataFrame:
    """The rows of `docs` in a language that was learned, with all their columns and without a shuffle.

    Rejected are texts that are null or have no letter, and those no language of the trees fits: of at least LEAST_BYTES
    bytes, for which the best language needs more than `foreign` times the bits a byte that it needs for its own median text, or
    shorter ones, if it needs no fewer than plain bytes (8 a byte). If nothing was learned, only texts without letters go.
    A null `lang` becomes the predicted language; other columns stay as they are. Null doc_ids and repeated rows are judged by
    their texts like others.
    """
    shared, place = docs.sparkSession.sparkContext.broadcast(trees), docs.columns.index("text")
    lang = docs.columns.index("lang") if "lang" in docs.columns and docs.schema["lang"].dataType.simpleString() == "string" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = part.column(place).to_pylist()
                fine = np.array([has_letter(t) for t in texts], bool)
                if model.langs:
                    raw = [_bytes(t) if f else b"" for t, f in zip(texts, fine, strict=True)]
                    size = np.array([len(t) for t in raw])
                    bits = model.score(raw) / np.maximum(1, size)[:, None]
                    best = bits.argmin(1)
                    fine &= bits.min(1) < np.where(size >= LEAST_BYTES, np.minimum(8.0, foreign * model.usual[best]), 8.0)
                    if lang is not None and part.column(lang).null_count:
                        told = pc.fill_null(part.column(lang), pa.array([model.langs[b] for b in best], part.column(lang).type))
                        part = part.set_column(lang, part.schema.field(lang), pc.if_else(pa.array(fine), told, part.column(lang)))
                yield part.filter(pa.array(fine))
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, docs.schema)
