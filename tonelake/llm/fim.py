"""Fill-in-the-middle: cut texts at line ends, kept in a Roaring-style boundary set.

The cuts of a text are code-point offsets: 0 and the end of every line.  They
are held as compressed set: offsets with equal upper 16 bits share a container,
which keeps the lower 16 bits as a sorted array, a bitmap or runs, whichever is
smallest.  Cumulative cardinalities over containers (and inside bitmaps and
runs) find the k-th boundary by a container search and a local select, so both
cuts of a text are two selects.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

MARKS = ("<P>", "<S>", "<M>")
SEED = "7"
#: Of 100 texts so many are transformed, and of those so many as suffix, prefix, middle.
RATE, SPM_RATE = 100, 50
#: Characters of finished texts that a task holds before it hands them on.
BATCH_CHARS = 4 << 20


class Array:
    """Sorted lower halves; the k-th is at place k."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    @staticmethod
    def size(low: np.ndarray) -> int:
        return 2 * len(low)

    def select(self, k: int) -> int:
        return int(self.low[k])


class Bitmap:
    """One bit a value in 1,024 words, with the number of bits up to each word."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(1 << 16, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.upto = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)

    @staticmethod
    def size(low: np.ndarray) -> int:
        return 1 << 13

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.upto, k, side="right"))
        word, left = int(self.words[at]), k - (int(self.upto[at - 1]) if at else 0)
        for _ in range(left):
            word &= word - 1  # the lowest bit goes
        return at * 64 + (word & -word).bit_length() - 1


class Runs:
    """First values of unbroken runs, with the number of values up to each run's end."""

    def __init__(self, low: np.ndarray):
        first = np.r_[True, np.diff(low.astype(np.int64)) != 1]
        self.starts = low[first].astype(np.uint16)
        self.upto = np.append(np.flatnonzero(first)[1:], len(low))

    @staticmethod
    def size(low: np.ndarray) -> int:
        return 2 + 4 * (1 + int(np.count_nonzero(np.diff(low.astype(np.int64)) != 1)))

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.upto, k, side="right"))
        return int(self.starts[at]) + k - (int(self.upto[at - 1]) if at else 0)


class Boundaries:
    """A set of ascending 32-bit offsets, asked by rank."""

    def __init__(self, offsets: np.ndarray):
        high = offsets >> 16
        cuts = np.flatnonzero(np.diff(high)) + 1
        parts = np.split(offsets, cuts) if len(offsets) else []
        self.keys = [int(p[0] >> 16) for p in parts]
        self.upto = np.cumsum([len(p) for p in parts], dtype=np.int64)
        self.containers = []
        for p in parts:
            low = p & 0xFFFF
            kind = min((Array, Bitmap, Runs), key=lambda c: c.size(low))
            self.containers.append(kind(low))

    def __len__(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    def select(self, k: int) -> int:
        """The k-th smallest offset, from 0."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.upto, k, side="right"))
        return (self.keys[at] << 16) + self.containers[at].select(k - (int(self.upto[at - 1]) if at else 0))


def boundaries(text: str) -> Boundaries:
    """0 and the end of each line of ``text``, in code points; the last line may lack its line feed."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.flatnonzero(points == 10) + 1
    if len(points) and (not len(ends) or ends[-1] != len(points)):
        ends = np.append(ends, len(points))
    return Boundaries(np.concatenate([[0], ends]).astype(np.int64))


def draws(doc_id: int | None, seed: str = SEED) -> list[int]:
    """Four 32-bit numbers of the document; a null id counts as no digits."""
    name = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(name[i : i + 8], 16) for i in range(0, 32, 8)]


def cut(doc_id: int | None, text: str, seed: str = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, int | None, int | None]:
    """``(lines, form, prefix end, middle end)``; the ends are null for a plain text."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    cuts = boundaries(text)
    n = len(cuts) - 1
    if not text or h3 % 100 >= rate or any(m in text for m in MARKS):
        return n, "plain", None, None
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, "spm" if h4 % 100 < spm_rate else "psm", cuts.select(low), cuts.select(high)


def render(text: str, form: str, a: int | None, b: int | None) -> str:
    p, s, m = MARKS
    if form == "plain":
        return text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    return f"{p}{prefix}{s}{suffix}{m}{middle}" if form == "psm" else f"{s}{suffix}{p}{prefix}{m}{middle}"


def transform(docs: DataFrame, seed: str = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)``, one row per row of ``docs``.

    ``n`` counts the lines of the whole text, ``output`` is the whole text
    rearranged.  A null text is read as empty; empty texts and those that hold
    a mark stay as they are (``plain``, null lengths).  Repeated rows are cut
    alike, as the cuts depend on id and text alone; rows with null ids draw as
    an id without digits; an empty table gives no rows; other columns,
    whatever their names, are not read.  Ids stay exact 64-bit numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, start = b.column(0), b.column(1), 0
            while start < len(b):
                rows, size, stop = [], 0, start
                while stop < len(b) and (size < BATCH_CHARS or stop == start):
                    text = texts[stop].as_py()
                    n, form, x, y = cut(ids[stop].as_py(), text, seed, rate, spm_rate)
                    rows.append((n, form, x, None if x is None else y - x, render(text, form, x, y)))
                    size += len(text)
                    stop += 1
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([ids.slice(start, stop - start), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
                start = stop

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("_text"))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that :func:`transform` was given, from its output and form alone."""
    p, s, m = MARKS
    at = lambda mark: F.instr(output, mark)
    between = lambda x, y: F.substring(output, x + 3, y - x - 3)
    middle = F.substring(output, at(m) + 3, F.length(output))
    psm = F.concat(between(at(p), at(s)), middle, between(at(s), at(m)))
    spm = F.concat(between(at(p), at(m)), middle, between(at(s), at(p)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
