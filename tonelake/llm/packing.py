"""Harmonic packing of tokenised documents into fixed-length sequences.

With capacity ``C``, class ``j`` takes whole documents of ``C / (j + 1) < n <= C / j``
tokens and its bins hold exactly ``j`` of them, so a bin is done after a fixed
count and every worker fills its bins alone.  A longer document gives whole
sequences first.  A bin that is done leaves less than ``C / (j + 1)`` tokens of
room, which is filled: by a whole document where one fits, by the rests of
long documents and by documents shorter than the last class, and, once a
worker holds ``HELD_ROOM`` tokens or ``HELD_BINS`` bins of room, by cutting the
next document that fits nowhere.  Room of ``CRUMB`` tokens or less is padding.
At a worker's end its open bins fill what room is left; the last of it is laid
end to end and its tail cut into powers of two, which need no padding.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

CAPACITY = 2048
CLASSES = 64
CRUMB = 16
HELD_ROOM = 32 * CAPACITY
HELD_BINS = 256
END_ID = 1


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The printable stand-ins for bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def is_plain(spec: dict) -> bool:
    """Whether a ``tokenizers`` file is byte-level BPE as ``tiktoken`` runs it.

    No normaliser, the byte-level pre-tokeniser with its own pattern, no option
    of the model set, every byte a token, and merges in the order of the ids
    they make, each id made once.  Given that, the two agree if merging each
    token's bytes gives the token, which tests show for the file in use.
    """
    model, before, added = spec["model"], spec.get("pre_tokenizer") or {}, {t["content"] for t in spec.get("added_tokens", [])}
    options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    if spec.get("normalizer") or model.get("type", "BPE") != "BPE" or any(model.get(o) for o in options):
        return False
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return False
    vocab = model["vocab"]
    made = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    singles = [i for w, i in vocab.items() if len(w) == 1]
    return made == sorted(set(made)) and set(_byte_of()) <= set(vocab) and len(made) + len(singles) == len(set(vocab) - added) and (not made or made[0] > max(singles))


class Encoder:
    """Token ids of the byte-level BPE in a ``tokenizers`` file.

    A plain file's vocabulary is run by ``tiktoken``, which gives the same ids
    several times faster; texts that hold a special token's string, and all
    texts of files that are not plain, go to ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.slow, self.fast = Tokenizer.from_file(path), None
        if is_plain(spec):
            back = _byte_of()
            ranks = {bytes(back[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in self.special}
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text).astype(np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker, which Spark uses for many tasks."""
    return Encoder(path)


def _powers(n: int) -> list[int]:
    return [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]


class _Worker:
    """Bins of one worker; sequence ids count up from ``first``.  A piece is ``(document, start, length)``."""

    def __init__(self, first: int, capacity: int, classes: int):
        self.next, self.capacity, self.classes = first, capacity, classes
        self.open: dict[int, list] = {}
        self.rooms: list = []  # (room, number, pieces), ascending
        self.room = self.number = 0

    def _sequence(self, pieces: list) -> list:
        out, offset = [], 0
        for doc, start, length in pieces:
            out.append((doc, start, length, self.next, offset))
            offset += length
        self.next += 1
        return out

    def add(self, doc: int, length: int) -> list:
        whole = length // self.capacity * self.capacity
        out = [row for start in range(0, whole, self.capacity) for row in self._sequence([(doc, start, self.capacity)])]
        rest = length - whole
        if not rest:
            return out
        j = self.capacity // rest
        if self.rooms and self.rooms[-1][0] >= rest:
            return out + self._fill((doc, whole, rest))
        if self.room >= rest and (whole or j > self.classes or self.room > HELD_ROOM or len(self.rooms) > HELD_BINS):
            return out + self._fill((doc, whole, rest))
        bin_ = self.open.setdefault(min(j, self.classes), [])
        bin_.append((doc, whole, rest))
        if len(bin_) == min(j, self.classes):
            out += self._done(self.open.pop(min(j, self.classes)))
        return out

    def _done(self, pieces: list) -> list:
        """A bin that takes no more documents of its class: a sequence, or room for others."""
        room = self.capacity - sum(p[2] for p in pieces)
        if room <= min(CRUMB, self.capacity // 128):
            return self._sequence(pieces)
        self.number += 1
        insort(self.rooms, (room, self.number, pieces))
        self.room += room
        return []

    def _fill(self, piece: tuple) -> list:
        """Put a piece into the least room that holds it; else cut it, least rooms first where too many bins are held."""
        out = []
        doc, start, length = piece
        while length:
            at = bisect_left(self.rooms, (length,))
            if at == len(self.rooms):
                at = 0 if len(self.rooms) > HELD_BINS else at - 1
            room, _, pieces = self.rooms.pop(at)
            self.room -= room
            part = min(room, length)
            out += self._done([*pieces, (doc, start, part)])
            start, length = start + part, length - part
        return out

    def close(self) -> list:
        out, loose = [], [p for j in sorted(self.open) for p in self.open[j]]
        self.open = {}
        while self.rooms:
            if not loose:  # the emptiest bin fills the others
                room, _, loose = self.rooms.pop()
                self.room -= room
                continue
            if self.room < loose[-1][2]:
                break
            out += self._fill(loose.pop())
        for _, _, pieces in self.rooms:
            loose += pieces
        self.rooms, self.room = [], 0
        total, rest = sum(p[2] for p in loose), iter(loose)
        doc, start, length = next(rest, (None, 0, 0))
        for size in [self.capacity] * (total // self.capacity) + _powers(total % self.capacity):
            seq, room = [], size
            while room:
                part = min(room, length)
                seq.append((doc, start, part))
                room, start, length = room - part, start + part, length - part
                if not length:
                    doc, start, length = next(rest, (None, 0, 0))
            out += self._sequence(seq)
        return out


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, classes: int = CLASSES, end_id: int = END_ID) -> DataFrame:
    """One row per piece, with its token ids as little-endian 32-bit ``ids``.

    ``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)``.  Each
    document is its text's ids and ``end_id``; null and empty texts are that
    id alone.  Repeated rows are packed as often as they occur; null ids stay
    null; a very long text spans many sequences; an empty table gives no rows;
    other columns are left out.  Workers are input partitions, so a task that
    runs again gives the same rows.  Ids stay exact 64-bit numbers.
    """
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(path)
        worker = _Worker(TaskContext.get().partitionId() << 40, capacity, classes)
        held: dict[int, list] = {}
        number = 0

        def table(rows: list) -> pa.RecordBatch:
            cols: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
            for n, start, length, seq, offset in rows:
                doc_id, ids, left = held[n]
                cols["doc_id"].append(doc_id)
                cols["start"].append(start)
                cols["length"].append(length)
                cols["ids"].append(ids[start : start + length].tobytes())
                cols["doc_tokens"].append(len(ids))
                cols["sequence_id"].append(seq)
                cols["offset"].append(offset)
                if left == length:
                    del held[n]
                else:
                    held[n][2] = left - length
            return pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in cols.items()], names=list(cols))

        for b in batches:
            rows, size = [], 0
            for doc_id, text in zip(b.column(0), b.column(1)):
                ids = np.append(encode(text.as_py()), np.array([end_id], "<u4")).astype("<u4")
                held[number] = [doc_id.as_py(), ids, len(ids)]
                rows += worker.add(number, len(ids))
                number += 1
                size += len(ids)
                if size > 1 << 20:
                    yield table(rows)
                    rows, size = [], 0
            yield table(rows)
        yield table(worker.close())

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("_text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
