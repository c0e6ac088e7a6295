"""What the operators share: column passing, bounded batches, hashing."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that one step of a Python operator holds at a time (a single longer text is a step of its own).
STEP_BYTES = 8 << 20


def free_name(taken: Sequence[str], wanted: str) -> str:
    """``wanted``, with underscores added until no column has that name (case is ignored, as Spark does)."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted += "_"
    return wanted


def rows_of(batch: pa.RecordBatch, sized: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose column ``sized`` holds some STEP_BYTES at most."""
    col = batch.column(sized)
    if batch.num_rows <= 1 or col.nbytes <= STEP_BYTES:
        yield batch
        return
    sizes = np.asarray(pc.coalesce(pc.binary_length(col.cast(pa.large_binary())), 0), dtype=np.int64)
    part = np.cumsum(sizes) // STEP_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def give_back() -> None:
    """Return memory that is free in this worker to the machine: workers outlive their tasks, and other stages need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that gives back memory at its end."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def append(df: DataFrame, inputs: Sequence[str], make: Callable[[], Callable[..., list]], fields: Sequence[tuple[str, str]]) -> tuple[DataFrame, list[str]]:
    """All columns of ``df`` and new ones, computed batch by batch in Python; also the names that the new ones got.

    ``make`` runs once a task and gives a function from the input columns (pyarrow arrays) to the new columns (pyarrow arrays or lists).
    The first input is the large one by whose size batches are cut.
    """
    names: list[str] = []
    for name, _ in fields:
        names.append(free_name([*df.columns, *names], name))
    added = T.StructType([T.StructField(n, T._parse_datatype_string(kind)) for n, (_, kind) in zip(names, fields, strict=True)])
    schema = T.StructType([*df.schema.fields, *added.fields])
    at = [df.columns.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in added.fields]
        f = make()
        for batch in batches:
            for part in rows_of(batch, at[0]):
                new = f(*[part.column(i) for i in at])
                cols = [x if isinstance(x, pa.Array) else pa.array(x, type=k) for x, k in zip(new, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=[*part.schema.names, *names])

    return df.mapInArrow(tidy(run), schema), names


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser for 64-bit hashes, in place of nothing: returns a new array."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Total bytes of a text column, to size exchanges by."""
    return df.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0
