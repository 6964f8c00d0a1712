"""Token ids in files: canonical length-limited Huffman codes, independent blocks, bit offsets inside them."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle
from .texts import LATIN, SIGNS, cut, flat, gather, slices

#: Longest code, tokens after which a block ends with its document, tokens between two bit offsets.
LIMIT, BLOCK, STEP = 18, 1 << 17, 128
#: Bytes of text whose distinct strings the tokenizer is asked for at once; a bound of memory that changes no result.
STRETCH = 16 << 20
#: The split pattern (a fixed value) of tokenizers whose texts may be cut at white space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BLOCKS = "part int, block int, first long, n long, doc_id array<long>, sizes binary, offsets binary, bits binary"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits (package-merge); 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(len(used) - 1).bit_length())
    leaf = used[np.argsort(counts[used], kind="stable")]
    weight, row, levels = counts[leaf].astype(np.float64), np.empty(0), []
    for _ in range(limit):
        both = np.concatenate([weight, row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)])
        order = np.argsort(both, kind="stable")
        levels.append(order < len(leaf))
        row = both[order]
    take, depth = 2 * len(leaf) - 2, np.zeros(len(leaf), np.int64)
    for is_leaf in reversed(levels):
        k = int(is_leaf[:take].sum())
        depth[:k] += 1
        take = 2 * (take - k)
    lengths[leaf] = depth
    return lengths


class Codebook:
    """Canonical codes from lengths alone: ids in order of (length, id) get consecutive codes."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        used = np.flatnonzero(lengths)
        self.order = used[np.lexsort((used, lengths[used]))]
        self.top = int(self.lengths.max(initial=1))
        spread = 1 << (self.top - self.lengths[self.order])
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[self.order] = ((np.cumsum(spread) - spread) >> (self.top - self.lengths[self.order])).astype(np.uint64)
        table = np.repeat(self.order << 6 | self.lengths[self.order], spread)
        self.table = np.concatenate([table, np.zeros((1 << self.top) - len(table), np.int64)])

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits, and the bit offset of every STEP-th token."""
        if not len(ids):
            return b"", np.empty(0, np.uint64)
        size = self.lengths[ids]
        at = np.cumsum(size) - size
        word, off, code = at >> 6, at & 63, self.codes[ids]
        over = off + size - 64
        spill = over > 0
        head = np.where(spill, code >> np.maximum(over, 0).astype(np.uint64), code << np.maximum(-over, 0).astype(np.uint64))
        out = np.zeros(int((at[-1] + size[-1] + 63) >> 6) + 1, np.uint64)
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[starts]] = np.bitwise_or.reduceat(head, starts)
        rest = np.flatnonzero(spill)
        out[word[rest] + 1] |= code[rest] << (64 - over[rest]).astype(np.uint64)
        return out.astype(">u8").tobytes()[: int(at[-1] + size[-1] + 7) >> 3], at[::STEP].astype(np.uint64)

    def decode(self, bits: bytes, offsets: np.ndarray, n: int) -> np.ndarray:
        """All stretches between offsets at once, a table look-up for each step."""
        if not n:
            return np.empty(0, np.int64)
        raw = np.frombuffer(bits + bytes(8), np.uint8).astype(np.uint32)
        four = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        at, out = offsets.astype(np.int64), np.empty((STEP, len(offsets)), np.int64)
        shift, mask, last = 32 - self.top, (1 << self.top) - 1, len(four) - 1
        for i in range(STEP):
            got = self.table[(four[np.minimum(at >> 3, last)] >> (shift - (at & 7)).astype(np.uint32)) & mask]
            out[i] = got
            at += got & 63
        return (out.T.reshape(-1)[:n]) >> 6


@lru_cache(4)
def _book(lengths: bytes) -> Codebook:
    return Codebook(np.frombuffer(lengths, np.uint8))


class WordEncoder:
    """Ids of texts by a tokenizer of the tokenizers library, which is asked for each distinct string of a stretch of texts.

    Texts are cut at ASCII white space if the tokenizer's own configuration says that it drops white space, lower-cases
    and splits letters from signs (`_cuts`); any other tokenizer is given whole texts. Then strings of Latin letters are lower-cased
    and put together from the letters and the signs behind them, so that fewer strings are asked for. With marks for the end of
    a word in the vocabulary, many letter strings are asked for as one text and told apart by these marks.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values(), default=0) + 1
        with open(path, encoding="utf-8") as f:
            self.cuts = _cuts(config := json.load(f))
        suffix = config["model"].get("end_of_word_suffix") if self.cuts else None
        self.ends = np.zeros(self.size, bool)
        if suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

    def asked(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of each text's, as the library gives them."""
        each = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(each), np.int32), np.array([len(x) for x in each], np.int64)

    def single(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As `asked`, for strings that are one match of the splitting pattern each (or empty)."""
        size = pc.binary_length(words).to_numpy(zero_copy_only=False)
        some = np.flatnonzero(size)
        count = np.zeros(len(words), np.int64)
        groups = pa.ListArray.from_arrays(pa.array(np.append(np.arange(0, len(some), 256), len(some)), pa.int32()), words.take(pa.array(some)).cast(pa.string()))
        ids, sizes = self.asked(pc.binary_join(groups, " "))
        at = np.flatnonzero(self.ends[ids])
        first = np.searchsorted(at, np.cumsum(sizes) - sizes)
        told = np.diff(np.append(first, len(at)))
        if not (told == np.diff(groups.offsets.to_numpy())).all() or (len(ids) and at[-1:] != len(ids) - 1):
            return self.asked(words)
        count[some] = np.diff(at, prepend=-1)
        return ids, count

    def encoded(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column one after another, and the end of each."""
        if not self.cuts:
            ids, n = self.asked(column.fill_null(""))
            return ids, np.cumsum(n)
        data, starts = flat(column)
        chunks, first = cut(data, starts, np.flatnonzero((data == 32) | ((data >= 9) & (data <= 13))))
        distinct = pc.ascii_ltrim_whitespace(chunks.dictionary)
        part = pc.extract_regex(distinct, f"^(?P<a>[{LATIN}]+)(?P<b>[{SIGNS}]*)$")
        fits = part.is_valid().to_numpy(zero_copy_only=False)
        plain, odd = np.flatnonzero(fits), np.flatnonzero(~fits)
        letters, signs = (pc.struct_field(part, k).filter(pa.array(fits)) for k in range(2))
        one = pa.concat_arrays([pc.utf8_lower(letters), signs]).dictionary_encode()
        pieces = len(one.dictionary)
        (ids, n), (more, m) = (self.single if self.ends.any() else self.asked)(one.dictionary), self.asked(distinct.filter(pa.array(~fits)))
        ids, ends = np.concatenate([ids, more]), np.cumsum(np.concatenate([n, m]))
        # each chunk is two strings: letters and signs, or all of it and nothing
        nothing = len(ends)
        which = np.full((len(distinct), 2), nothing, np.int64)
        which[plain] = one.indices.to_numpy(zero_copy_only=False).reshape(2, -1).T
        which[odd, 0] = pieces + np.arange(len(odd))
        per_piece, done = gather(ids, np.append(ends, len(ids)), which.reshape(-1))
        out, done = gather(per_piece, done[1::2], chunks.indices.to_numpy(zero_copy_only=False).astype(np.int64))
        return out, np.concatenate([[0], done])[first[1:]]


def _cuts(config: dict) -> bool:
    """Whether ids of a text are those of its strings between ASCII white space, whose case and signs may be taken apart."""
    def steps(x: dict | None, key: str) -> list[dict]:
        return [] if x is None else x.get(key, [x])

    norm, pre = steps(config.get("normalizer"), "normalizers"), steps(config.get("pre_tokenizer"), "pretokenizers")
    return (
        [n["type"] for n in norm] == ["NFC", "Replace", "Lowercase"] and norm[1]["pattern"] == {"Regex": r"\s+"} and norm[1]["content"] == " "
        and [p["type"] for p in pre] == ["Split", "ByteLevel"] and pre[0]["pattern"] == {"Regex": SPLIT} and pre[0]["behavior"] == "Removed" and pre[0]["invert"]
        and not pre[1]["add_prefix_space"] and not pre[1]["use_regex"] and config.get("post_processor") is None and config.get("truncation") is None and config.get("padding") is None
        and all(t["special"] and not t["single_word"] and not t["lstrip"] and not t["rstrip"] and t["content"].startswith("<|") and not any(map(str.isspace, t["content"])) for t in config["added_tokens"])
    )


@lru_cache(1)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _width(size: int) -> str:
    """Ids on their way: 16 bits if all fit, else 32."""
    return "<u2" if size <= 1 << 16 else "<u4"


def tokenize(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, ids): ids of each text and the end id, as `write_ids` takes them.

    Each row is packed by itself for the way through a shuffle: a byte with the bytes of an id, the number of ids, and the
    compressed ids. `path` must name the tokenizer on every executor.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, codec = _encoder(path), pa.Codec("zstd", 1)
        kind = _width(max(encoder.size, end_id + 1))
        wide, end = int(kind[-1]), np.asarray([end_id], kind).tobytes()
        for batch in batches:
            for part in slices(batch, most=STRETCH):
                ids, ends = encoder.encoded(part.column(1))
                raw, a, packed = ids.astype(kind).tobytes(), 0, []
                for b in (ends * wide).tolist():
                    row = raw[a:b] + end
                    packed.append(wide.to_bytes(1, "little") + (len(row) // wide).to_bytes(8, "little") + codec.compress(row, asbytes=True))
                    a = b
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], ["doc_id", "ids"])
        pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def _unpack(packed: bytes, codec: pa.Codec) -> np.ndarray:
    wide, n = packed[0], int.from_bytes(packed[1:9], "little")
    return np.frombuffer(codec.decompress(packed[9:], n * wide, asbytes=True), f"<u{wide}")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, codec = np.zeros(0, np.int64), pa.Codec("zstd", 1)
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            more = np.bincount(np.concatenate([_unpack(x, codec) for x in batch.column(0).slice(k, 256).to_pylist()]), minlength=len(total))
            more[: len(total)] += total
            total = more
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(total[some])], ["id", "n"])


def write_ids(tokens: DataFrame, path: str) -> None:
    """Write (doc_id, ids) rows of `tokenize` in ascending order of doc_id, as files under `path`.

    `path`/codes holds (id, bits), from which the canonical codes follow; `path`/blocks a row for each block: its file
    (part) and place, the number of tokens before it in its part, the doc_ids and their token counts, a bit offset
    for every STEP tokens, and the bits. A block starts with its own offsets, so it's read without any other.
    Null doc_ids come first; rows of equal doc_id are ordered by their ids, so reruns agree.
    """
    spark = tokens.sparkSession
    # a row for each id of the vocabulary at most, whatever the input
    found = tokens.select("ids").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in found), default=0) + 1, np.int64)
    for r in found:
        counts[r.id] = r.n
    lengths = code_lengths(counts)
    spark.sql("SELECT {bits} AS bits", bits=lengths.tobytes().hex()).selectExpr("unhex(bits) AS bits").write.parquet(f"{path}/codes")
    raw = lengths.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, codec, part = _book(raw), pa.Codec("zstd", 1), TaskContext.get().partitionId()
        ids: list[np.ndarray] = []
        docs: list[int | None] = []
        state = {"block": 0, "first": 0}

        def block() -> pa.RecordBatch:
            sizes = np.array([len(x) for x in ids], "<u4")
            bits, offsets = book.encode(np.concatenate(ids))
            n = int(sizes.sum())
            row = [part, state["block"], state["first"], n, list(docs), sizes.tobytes(), offsets.astype("<u8").tobytes(), bits]
            state["block"] += 1
            state["first"] += n
            ids.clear()
            docs.clear()
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["part", "block", "first", "n", "doc_id", "sizes", "offsets", "bits"])

        held = 0
        for batch in batches:
            for doc_id, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs.append(doc_id)
                ids.append(_unpack(packed.as_py(), codec))
                held += len(ids[-1])
                if held >= BLOCK:
                    yield block()
                    held = 0
        if ids:
            yield block()

    tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids").mapInArrow(run, _BLOCKS).write.parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids: little-endian 32-bit, as binary) of every document under `path`.

    `start` is the number of ids of all documents before: those in earlier parts, of which there is a row for each file,
    and those before it in its own part.
    """
    raw = bytes(spark.read.parquet(f"{path}/codes").first()["bits"])
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = _book(raw)
        for batch in batches:
            for i in range(batch.num_rows):
                part, first, n, docs, sizes, offsets, bits = (batch.column(j)[i].as_py() for j in range(7))
                size = np.frombuffer(sizes, "<u4").astype(np.int64)
                ids = book.decode(bits, np.frombuffer(offsets, "<u8"), n).astype("<u4").tobytes()
                end = np.cumsum(size)
                each = [ids[4 * a:4 * b] for a, b in zip((end - size).tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([part] * len(size), pa.int32()), pa.array(docs, pa.int64()), pa.array(first + end - size, pa.int64()), pa.array(size),
                    pa.array([zlib.crc32(x) for x in each], pa.int64()), pa.array(each if with_ids else [None] * len(size), pa.binary()),
                ], ["part", "doc_id", "at", "n_tokens", "ids_crc32", "ids"])

    got = blocks.select("part", "first", "n", "doc_id", "sizes", "offsets", "bits").mapInArrow(run, "part int, doc_id long, at long, n_tokens long, ids_crc32 long, ids binary")
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    out = got.join(before, "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "ids")
    return out if with_ids else out.drop("ids")


def round_trip(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1) -> DataFrame:
    """Encode all `docs`, write the ids under `path` and return what is read from there.

    Null text: empty, so only the end id. Repeated rows are all written. An empty table gives no rows.
    """
    write_ids(settle(tokenize(docs, tokenizer, end_id)), path)
    return read_ids(docs.sparkSession, path)
