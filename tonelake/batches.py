"""What a task turns into Python objects at a time: bounded by bytes, whatever the number of rows in an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of Arrow data turned into objects at once; objects take some ten to twenty times as much.
PIECE = 1 << 20


def pieces(batches: Iterator[pa.RecordBatch], most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in slices of at most ``most`` bytes or of one row."""
    for b in batches:
        begin = 0
        while begin < len(b):
            stop = begin + 1
            while stop < len(b) and b.slice(begin, stop + 1 - begin).nbytes <= most:
                stop += 1
            yield b.slice(begin, stop - begin)
            begin = stop


def records(batches: Iterator[pa.RecordBatch], most: int = PIECE) -> Iterator[list[dict]]:
    """The same slices as lists of rows."""
    for b in pieces(batches, most):
        yield b.to_pylist()


def table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows of tuples as one batch."""
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
