"""Byte-level BPE by prefix dynamic programming: each byte prefix has one valid last token."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import LATIN, SIGNS, RowTable, cut, flat, gather, slices, strings

#: The split pattern (a fixed value) whose texts may be cut at single white space; texts of any other are split whole.
WORDS_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Checked pairs of tokens that a `PrefixBPE` remembers, strings whose tables are filled at once, and the longest of them in
#: bytes (longer ones are filled one by one): bounds of memory, which change no result.
PAIRS, BLOCK, LONGEST = 1 << 16, 1 << 15, 64
#: Bytes of text encoded at once: work arrays take some 25 bytes for each of them. A bound of memory that changes no result.
STRETCH = 2 << 20


@lru_cache(2)
def vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Prefixes:
    """The last token of every byte prefix of one piece. It can be appended to, and edited near any place.

    `last[i]` is the id of the token that ends the encoding of the first i bytes. A token may follow another
    if the merges of their joined bytes give just these two; and a sequence is an encoding if each token is its own
    encoding and may follow the one before it. So the token ending at i is the one that may follow `last` at its start,
    and it is unique, as the merges give one result.
    """

    def __init__(self, bpe: PrefixBPE, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> Prefixes:
        self.data += more
        self._fill(len(self.data))
        return self

    def _fill(self, end: int) -> None:
        data, last, bpe = self.data, self.last, self.bpe
        ranks, fine, known, longest = bpe.ranks, bpe._fine, bpe._follows, bpe.longest
        for i in range(len(last), end + 1):
            for j in range(i - longest if i > longest else 0, i):
                token = ranks.get(data[j:i])
                if token is None or (token not in fine and not bpe.sound(token)):
                    continue
                if j:
                    ok = known.get(last[j] << 32 | token)
                    if ok is None:
                        ok = bpe.follows(last[j], token)
                    if not ok:
                        continue
                last.append(token)
                break
            else:
                raise ValueError(f"no token for byte {data[i - 1]}")

    def edit(self, at: int, removed: int, inserted: bytes) -> Prefixes:
        """Replace data[at:at + removed]. What lies before `at` stays; behind the edit, work ends once a
        longest token's length of prefixes agrees with the old ones, as later ones depend on no others."""
        old, tail = self.last, self.data[at + removed:]
        self.data, self.last = self.data[:at] + inserted + tail, self.last[: at + 1]
        shift, agreed = len(inserted) - removed, 0
        for i in range(at + 1, len(self.data) + 1):
            self._fill(i)
            before = i - shift
            agreed = agreed + 1 if before > at + removed and old[before] == self.last[i] else 0
            if agreed >= self.bpe.longest:
                self.last += old[before + 1:]
                break
        return self

    def ids(self) -> list[int]:
        out, i = [], len(self.data)
        while i:
            out.append(self.last[i])
            i -= len(self.bpe.tokens[self.last[i]])
        return out[::-1]


class PrefixBPE:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.longest = max(map(len, ranks), default=0)
        self._fine: set[int] = set()
        self._unsound: set[int] = set()
        self._follows: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}

    def merged(self, data: bytes) -> list[int]:
        """Plain merges by rank, for the short strings of one or two tokens."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            at = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[at] + parts[at + 1] not in self.ranks:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def sound(self, token: int) -> bool:
        """Whether the merges of a token's bytes give that token."""
        if token not in self._fine and token not in self._unsound:
            (self._fine if self.merged(self.tokens[token]) == [token] else self._unsound).add(token)
        return token in self._fine

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that a token's last merge joins; None for a byte."""
        got = self._halves.get(token, 0)
        if got == 0:
            data = self.tokens[token]
            parts = [data[i:i + 1] for i in range(len(data))]
            while len(parts) > 2:
                at = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            got = self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return got

    def follows(self, first: int, second: int) -> bool:
        """Whether `second` may stand behind `first`: no merge of both bytes crosses the border between them.

        Merges are undone from the last one back, on the side whose token has the higher rank; what then meets at the
        border is what met there at that time. If these two join at a rank below all that was undone, that merge would have
        come first. Of equal ranks the left merge comes first, so on the right side the bound is one higher.
        """
        key = first << 32 | second
        got = self._follows.get(key)
        if got is None:
            if len(self._follows) >= PAIRS:
                self._follows.clear()
            a, b, bound, tokens, ranks = first, second, 1 << 60, self.tokens, self.ranks
            while True:
                if ranks.get(tokens[a] + tokens[b], bound) < bound:
                    got = False
                    break
                ours, theirs = self.halves(a), self.halves(b)
                if not ours and not theirs:
                    got = True
                    break
                if ours and (a > b or not theirs):
                    bound, a = a, ours[1]
                else:
                    bound, b = b + 1, theirs[0]
            self._follows[key] = got
        return got

    def piece(self, data: bytes) -> list[int]:
        """The encoding of one match of the split pattern; a match that is a token is that token."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else Prefixes(self, data).ids()


class PrefixTables:
    """The same tables of last tokens, filled for many strings at once: the arrays of a vocabulary that this takes.

    `limbs` are the tokens' bytes as big-endian 64-bit numbers, found by a hash and compared whole; `sound`, `left` and
    `right` are what `PrefixBPE.sound` and `halves` give; `joined` has the rank of each pair of tokens that make a token.
    All are bounded by the vocabulary, so they may be broadcast.
    """

    def __init__(self, path: str):
        bpe = PrefixBPE(vocabulary(path))
        self.ranks, n = bpe.ranks, len(bpe.tokens)
        self.size = np.array([len(t) for t in bpe.tokens], np.int64)
        self.data, self.ends = np.frombuffer(b"".join(bpe.tokens), np.uint8), np.cumsum(self.size)
        self.wide = max(1, -(-bpe.longest // 8))
        self.limbs = _limbs(self.data, self.ends, self.wide)
        self.sound = np.zeros(n, bool)
        self.left, self.right = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        pairs: dict[int, int] = {}
        for data, token in bpe.ranks.items():
            self.sound[token] = bpe.sound(token)
            if self.sound[token] and len(data) > 1:
                self.left[token], self.right[token] = bpe.halves(token)
            for i in range(1, len(data)):
                a, b = bpe.ranks.get(data[:i]), bpe.ranks.get(data[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = token
        self.joined, self.joined_rank = RowTable(np.array([*pairs], np.uint64)), np.array([*pairs.values(), 1 << 60], np.int64)
        self.used = np.array([*bpe.ranks.values()], np.int64)
        keys = self._key(self.limbs[self.used].T, self.size[self.used])
        assert len(np.unique(keys)) == len(keys), "two tokens of one hash"
        self.found = RowTable(keys)

    @staticmethod
    def _key(limbs: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        key = np.uint64(0) + np.asarray(size, np.uint64)
        for limb in limbs:
            key = (key ^ limb) * np.uint64(0xD6E8FEB86659FD93)
            key = key ^ (key >> np.uint64(32))
        return key

    def tokens(self, limbs: list[np.ndarray], size: int) -> np.ndarray:
        """The token that each string of `size` bytes is, -1 if none."""
        limbs = limbs + [np.zeros_like(limbs[0])] * (self.wide - len(limbs))
        row = self.found.find(self._key(limbs, size))
        out = np.where(row >= 0, self.used[row], -1)
        same = (row >= 0) & (self.size[out] == size)
        for k, limb in enumerate(limbs):
            same &= self.limbs[out, k] == limb
        return np.where(same, out, -1)

    def follows(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """`PrefixBPE.follows` of arrays of pairs of tokens."""
        fine, at = np.ones(len(first), bool), np.arange(len(first))
        a, b, bound = first.astype(np.int64), second.astype(np.int64), np.full(len(first), 1 << 60)
        while len(at):
            crossed = self.joined_rank[self.joined.find((a << 32 | b).astype(np.uint64))] < bound
            fine[at[crossed]] = False
            ours, theirs = self.right[a], self.left[b]
            more = ~crossed & ((ours >= 0) | (theirs >= 0))
            mine = (ours >= 0) & ((a > b) | (theirs < 0))
            bound = np.where(mine, a, b + 1)[more]
            a, b, at = np.where(mine, ours, a)[more], np.where(mine, b, theirs)[more], at[more]
        return fine

    def encode(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all strings one after another, and the end of each; a string that is a token is that token."""
        data, offsets = flat(pieces)
        size = np.diff(offsets)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        order = np.argsort(-size, kind="stable")
        long = int((size > LONGEST).sum())
        if long:
            bpe = PrefixBPE(self.ranks)
            each = [bpe.piece(data[offsets[i]:offsets[i + 1]].tobytes()) for i in order[:long]]
            found.append((order[:long], np.array([len(x) for x in each]), np.concatenate(each)))
        for k in range(long, len(order), BLOCK):
            rows = order[k:k + BLOCK]
            found.append((rows, *self._fill(*gather(data, offsets[1:], rows))))
        count = np.zeros(len(size), np.int64)
        for rows, n, _ in found:
            count[rows] = n
        ends = np.cumsum(count)
        out = np.zeros(ends[-1] if len(ends) else 0, np.int32)
        for rows, n, ids in found:
            out[np.repeat(ends[rows] - np.cumsum(n), n) + np.arange(len(ids))] = ids
        return out, ends

    def _fill(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each string and all ids; strings come longest first, so those with i bytes are the first ones."""
        size = np.diff(ends, prepend=0)
        most = int(size[0])
        limbs = _limbs(data, ends, -(-most // 8))
        limbs = np.concatenate([limbs, np.zeros((len(size), self.wide + 1), np.uint64)], axis=1)
        last = np.full((len(size), most + 1), -1, np.int32)
        for i in range(1, most + 1):
            todo = np.arange(np.searchsorted(-size, -i, "right"))
            for length in range(min(i, 8 * self.wide), 0, -1):
                if not len(todo):
                    break
                j = i - length
                token = self.tokens(_window(limbs, todo, j, length), length)
                ok = (token >= 0) & (self.sound[token] | (size[todo] == length))
                if j:
                    some = np.flatnonzero(ok)
                    ok[some] = self.sound[token[some]] & self.follows(last[todo[some], j], token[some])
                last[todo[ok], i] = token[ok]
                todo = todo[~ok]
            if len(todo):
                raise ValueError("no token for a byte")
        # from the ends back to the starts
        at, row = size.copy(), np.flatnonzero(size)
        steps = [(row[:0], last[row[:0], 0])]
        while len(row):
            token = last[row, at[row]]
            steps.append((row, token))
            at[row] -= self.size[token]
            row = row[at[row] > 0]
        row, token = (np.concatenate(x[::-1]) for x in zip(*steps, strict=True))
        order = np.argsort(row, kind="stable")
        return np.bincount(row, minlength=len(size)), token[order]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all tokens one after another, and their ends."""
        return gather(self.data, self.ends, ids)


def _limbs(data: np.ndarray, ends: np.ndarray, wide: int) -> np.ndarray:
    """Each string as `wide` big-endian 64-bit numbers, filled up with zeros."""
    size = np.diff(ends, prepend=0)
    out = np.zeros((len(ends), 8 * wide), np.uint8)
    out[np.repeat(np.arange(len(ends)), size), np.arange(len(data)) - np.repeat(ends - size, size)] = data
    return out.view(">u8").astype(np.uint64)


def _window(limbs: np.ndarray, rows: np.ndarray, j: int, length: int) -> list[np.ndarray]:
    """Bytes j to j + length of each row, as big-endian 64-bit numbers."""
    out, shift = [], np.uint64(8 * (j % 8))
    for k in range(-(-length // 8)):
        x = limbs[rows, j // 8 + k]
        if shift:
            x = x << shift | limbs[rows, j // 8 + k + 1] >> (np.uint64(64) - shift)
        rest = length - 8 * k
        out.append(x if rest >= 8 else x & np.uint64((1 << 64) - (1 << (64 - 8 * rest))))
    return out


@lru_cache(2)
def tables(path: str) -> PrefixTables:
    return PrefixTables(path)


def _single_spaces(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places of single spaces and line feeds between two other characters: there a match of WORDS_PATTERN starts, whatever
    stands around. Characters that might be white space beyond ASCII are taken for it, as a missing cut does no harm."""
    at = np.flatnonzero((data == 32) | (data == 10))
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = edge[starts - 1] = True  # a text's first and last byte aren't between two characters
    at = at[~edge[at]]
    before, after = data[at - 1], data[at + 1]
    wide = (before >= 128) & ((data[at - 2] == 0xC2) | ((data[np.maximum(at - 3, 0)] >= 0xE1) & (data[np.maximum(at - 3, 0)] <= 0xE3)))
    return at[(before > 32) & ~wide & (after > 32) & (after != 0xC2) & ((after < 0xE1) | (after > 0xE3))]


def encoded(column: pa.Array, vocabulary: PrefixTables, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a column one after another, and the end of each. Distinct pieces are encoded once."""
    data, starts = flat(column)
    places = _single_spaces(data, starts) if pattern == WORDS_PATTERN else np.empty(0, np.int64)
    chunks, first = cut(data, starts, places)
    distinct = chunks.dictionary
    if pattern == WORDS_PATTERN:
        part = pc.extract_regex(distinct, f"^(?P<a>\n?)(?P<b> ?[{LATIN}]+)(?P<c>[{SIGNS}]*)$")
        fits = part.is_valid().to_numpy(zero_copy_only=False)
        parts = [pc.struct_field(part, k).filter(pa.array(fits)) for k in range(3)]
    else:
        fits, parts = np.zeros(len(distinct), bool), []
    plain, odd = np.flatnonzero(fits), np.flatnonzero(~fits)
    split = regex.compile(pattern)
    rest = [split.findall(t) for t in distinct.take(pa.array(odd)).to_pylist()]
    pieces = pa.chunked_array([*parts, pa.array([m for r in rest for m in r], pa.large_string())], pa.large_string()).combine_chunks()
    pieces = (pieces.combine_chunks() if isinstance(pieces, pa.ChunkedArray) else pieces).dictionary_encode()
    ids, ends = vocabulary.encode(pieces.dictionary)
    # chunk -> pieces: three columns of parts, or as many as the pattern found
    number = pieces.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.full(len(distinct), 3, np.int64)
    sizes[odd] = [len(r) for r in rest]
    chunk_ends, n = np.cumsum(sizes), len(plain)
    order = np.zeros(chunk_ends[-1] if len(sizes) else 0, np.int64)
    for k in range(len(parts)):
        order[chunk_ends[plain] - 3 + k] = number[k * n:(k + 1) * n]
    in_odd = sizes[odd]
    order[np.repeat(chunk_ends[odd] - np.cumsum(in_odd), in_odd) + np.arange(in_odd.sum())] = number[len(parts) * n:]
    per_piece, piece_ends = gather(ids, ends, order)
    ends_of_chunk = np.concatenate([[0], piece_ends])[chunk_ends]
    out, done = gather(per_piece, ends_of_chunk, chunks.indices.to_numpy(zero_copy_only=False).astype(np.int64))
    return out, np.concatenate([[0], done])[first[1:]]


def digests(part: pa.RecordBatch, v: PrefixTables, pattern: str, with_ids: bool) -> pa.RecordBatch:
    """What `encode_texts` gives of one stretch of doc_id and text. Its work arrays go when it ends."""
    sha = hashlib.sha256
    ids, ends = encoded(part.column(1), v, pattern)
    back, token_ends = v.decode(ids)
    n, raw, text = len(part), memoryview(ids.astype("<u4")).cast("B"), memoryview(back)
    bounds = np.concatenate([[0], ends])
    told = np.concatenate([[0], token_ends])[bounds].tolist()
    a = bounds.tolist()
    columns = [
        part.column(0), pa.array(np.diff(bounds)), pa.array([sha(raw[4 * a[i]:4 * a[i + 1]]).hexdigest() for i in range(n)], pa.string()),
        pa.array([sha(text[told[i]:told[i + 1]]).hexdigest() for i in range(n)], pa.string()),
    ]
    if with_ids:
        columns.append(strings(np.frombuffer(raw, np.uint8), 4 * bounds, pa.binary()))
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])


def encode_texts(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids: little-endian 32-bit, as binary) of every text.

    Texts are encoded whole, a stretch of an Arrow batch at a time, and nothing is shuffled or kept between stretches. Null text:
    empty, no tokens. Null doc_ids and repeated rows are encoded like others. The driver reads the vocabulary at `path`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tables(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=STRETCH):
                yield digests(part, shared.value, pattern, with_ids)
            batch = part = None  # the next batch comes in the place of this one
            pa.default_memory_pool().release_unused()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """doc_id and text of documents given as `encode_texts` gives them with ids; null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(tables(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            texts = [None if x is None else v.decode(np.frombuffer(x, "<u4").astype(np.int64))[0].tobytes().decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, "doc_id long, text string")
