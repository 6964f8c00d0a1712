"""Fill-in-middle rows: texts cut at units whose offsets a Split pre-tokenizer gives, and put together in another order."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import cut, flat, slices

#: One code point (Oniguruma: with m the dot matches line feeds too). Its matches don't depend on what stands around them.
CODE_POINT = r"(?m:.)"
#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Bytes of a piece that the pre-tokenizer is given at most where texts may be cut; a bound of memory that changes no result.
PIECE = 1 << 16


class Units:
    """Units of all texts of a column by the offsets of isolated matches: how many there are, and where those of given ranks end.

    Texts are cut into pieces at spaces if the units are code points, and the pre-tokenizer is asked for the offsets of each distinct
    piece; a piece's place is the sum of the code points before it. Other patterns get whole texts.
    """

    def __init__(self, column: pa.Array, split, apart: bool):
        data, starts = flat(column)
        pieces, self.first = cut(data, starts, _places(data) if apart else np.empty(0, np.int64))
        each = [[end for _, (_, end) in split.pre_tokenize_str(p)] for p in pieces.dictionary.to_pylist()]
        count = np.array([len(x) for x in each], np.int64)
        self.local, self.at = np.array([e for x in each for e in x], np.int64), np.cumsum(count) - count
        self.piece = pieces.indices.to_numpy(zero_copy_only=False)
        points = np.array([x[-1] for x in each], np.int64)
        self.units, self.points = (np.concatenate([[0], np.cumsum(x[self.piece])]) for x in (count, points))
        self.n = np.diff(self.units[self.first])

    def ends(self, rank: np.ndarray) -> np.ndarray:
        """Code points of each text up to the end of its unit number `rank` (from 1; 0 is the start)."""
        out, some = np.zeros(len(rank), np.int64), np.flatnonzero(rank)
        wanted = self.units[self.first[some]] + rank[some]
        p = np.searchsorted(self.units, wanted) - 1
        inside = self.local[self.at[self.piece[p]] + wanted - self.units[p] - 1]
        out[some] = inside + self.points[p] - self.points[self.first[some]]
        return out


def _places(data: np.ndarray) -> np.ndarray:
    """Spaces, and the first bytes of code points about every PIECE bytes."""
    far = np.arange(PIECE, len(data), PIECE)
    for _ in range(3):
        far = far[far < len(data)]
        far = far + ((data[far] & 0xC0) == 0x80)
    return np.union1d(np.flatnonzero(data == 32), far[far < len(data)])


def drawn(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned numbers of 32 bits: the first digits of the SHA-256 of `seed:doc_id`."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substr(h, F.lit(8 * k + 1), F.lit(8)), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def fill_in_middle(docs: DataFrame, unit: str = CODE_POINT, seed: int = 1, plain: int = 10, spm: int = 20) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every whole text.

    A text of n units (the isolated matches of `unit` and what is left between them) is cut behind two units drawn by doc_id.
    The output has prefix, suffix and middle behind marks; `plain` per cent of the rows stay as they are, and `spm` per cent
    of the others have the suffix first. Lengths are in code points, null for plain rows.

    Null texts are empty; empty texts and texts that hold a mark are plain. A null doc_id draws as an empty one. Rows of one
    doc_id draw alike; repeated rows give repeated rows. No rows: no rows. Nothing is shuffled, and a task holds a stretch of an
    Arrow batch. `restored` takes the output back.
    """
    apart = unit == CODE_POINT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        split = Split(Regex(unit), "isolated")
        p, s, m = MARKS
        for batch in batches:
            for part in slices(batch):
                found = Units(part.column(1), split, apart)
                n = found.n
                h1, h2, h3, h4 = (part.column(k).to_numpy() for k in range(2, 6))
                a, b = h1 % (n + 1), h2 % (n + 1)
                left, right = found.ends(np.minimum(a, b)).tolist(), found.ends(np.maximum(a, b)).tolist()
                forms = np.where((n == 0) | (h3 % 100 >= 100 - plain), "plain", np.where(h4 % 100 < spm, "spm", "psm")).tolist()
                texts = [t or "" for t in part.column(1).to_pylist()]
                for i, t in enumerate(texts):
                    if forms[i] != "plain" and any(mark in t for mark in MARKS):
                        forms[i] = "plain"
                    if forms[i] == "plain":
                        left[i] = right[i] = None
                    else:
                        x, y, z = t[:left[i]], t[left[i]:right[i]], t[right[i]:]
                        texts[i] = f"{p}{x}{s}{z}{m}{y}" if forms[i] == "psm" else f"{s}{z}{p}{x}{m}{y}"
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(n), pa.array(forms, pa.string()), pa.array(left, pa.int64()),
                    pa.array([None if x is None else y - x for x, y in zip(left, right, strict=True)], pa.int64()), pa.array(texts, pa.string()),
                ], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
        pa.default_memory_pool().release_unused()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *drawn(F.col("doc_id").cast("long"), seed))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A text with a mark is never cut, so an output's marks are the three of its form."""
    part = F.split(output, "|".join(re.escape(m) for m in MARKS), -1)
    first, second = (F.when(form == "psm", part[k]).otherwise(part[3 - k]) for k in (1, 2))
    return F.when(form == "plain", output).otherwise(F.concat(first, part[3], second))
