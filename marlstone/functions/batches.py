"""Arrow batches in small pieces, so that what a task holds as Python objects doesn't grow with its input."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Bytes of a piece.
PIECE = 1 << 20


def pieces(batch, most: int = PIECE) -> Iterator:
    """A record batch or array cut by rows, in order, to pieces of at most so many bytes; a longer row stands alone.
    Nothing is copied."""
    open_ = [batch]
    while open_:
        own = open_.pop()
        if len(own) < 2 or own.nbytes <= most:
            yield own
        else:
            half = len(own) // 2
            open_ += [own.slice(half), own.slice(0, half)]


def give_back() -> None:
    """Memory that Python and Arrow have freed goes back to the system: a process keeps it for itself otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def mapped(values: pa.Array, one: Callable, kind: pa.DataType) -> pa.Array:
    """one of each value."""
    return pa.concat_arrays([pa.array([one(x) for x in own.to_pylist()], kind) for own in pieces(values)])


def rows_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows, none too, as a record batch."""
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
