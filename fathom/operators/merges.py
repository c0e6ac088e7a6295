"""The merge trace in blocks of vertices, for graphs whose lists are too much to be put on every edge."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Neighbours, in the lists of whole vertices, that a task holds at a time, at most and at least (a longer list is a block of its own).
BLOCK, LEAST_BLOCK = 2_000_000, 50_000
#: Blocks of a graph that is small enough for LEAST_BLOCK; each meets each in a task.
SPREAD = 24
#: Rows that a task makes at a time (one edge's are never cut).
STEP = 1 << 19

Batches = Iterator[pa.RecordBatch]


def flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a column of lists."""
    lists = batch.column(batch.schema.get_field_index(name))
    return np.asarray(lists.flatten()), np.asarray(lists.value_lengths(), dtype=np.int64)


def cuts(sizes: np.ndarray) -> Iterator[slice]:
    """Runs of rows whose sizes have some STEP as their sum."""
    part = np.cumsum(sizes) // STEP
    ends = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    return (slice(a, b) for a, b in zip(ends, ends[1:], strict=False) if b > a)


class Lists:
    """Lists in one array, by ascending id."""

    def __init__(self, ids: np.ndarray, off: np.ndarray, values: np.ndarray, lengths: np.ndarray):
        self.ids, self.off, self.values, self.lengths = ids, off, values, lengths
        self.start = np.cumsum(lengths) - lengths

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Lists:
        return cls(*[np.asarray(batch.column(batch.schema.get_field_index(x))) for x in ("id", "off")], *flat(batch, "nbrs"))

    def packed(self) -> tuple[int, bytes]:
        """Length and compressed bytes of lists whose offsets follow each other."""
        raw = np.concatenate([[len(self.ids), self.off[0]], self.ids, self.lengths, self.values])
        raw = np.diff(raw, prepend=0).tobytes()  # differences, and their sums, wrap around
        return len(raw), pa.Codec("zstd").compress(raw, asbytes=True)

    @classmethod
    def unpacked(cls, size: int, data: bytes) -> Lists:
        raw = np.cumsum(np.frombuffer(pa.Codec("zstd").decompress(data, size), dtype=np.int64))
        n, ids, lengths = raw[0], raw[2 : 2 + raw[0]], raw[2 + raw[0] : 2 + 2 * raw[0]]
        return cls(ids, raw[1] + np.cumsum(lengths) - lengths, raw[2 + 2 * n :], lengths)

    @classmethod
    def joined(cls, parts: Sequence[Lists]) -> Lists:
        return cls(*[np.concatenate([getattr(p, k) for p in parts]) for k in ("ids", "off", "values", "lengths")])


def steps(both: Lists, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """The trace of merging lists ``a[i]`` and ``b[i]``."""
    pair = np.stack([a, b], 1)
    start, length = both.start[pair], both.lengths[pair]
    low, high = both.values[start].max(1), both.values[start + length - 1].min(1)
    which, start, length = pair.ravel(), start.ravel(), length.ravel()
    seg = np.repeat(np.arange(len(which)), length)
    place = np.arange(len(seg)) - np.repeat(np.cumsum(length) - length, length)
    value = both.values[start[seg] + place]
    used = (value <= high[seg >> 1]) & (low <= high)[seg >> 1]
    seg, place, value = seg[used], place[used], value[used]
    # a list's values ascend and the first list stands before the second, so a stable sort leaves it first on ties
    least = value.min(initial=0)
    width = int(value.max(initial=0)) - int(least) + 1
    order = np.argsort((seg >> 1) * width + (value - least), kind="stable") if width * max(len(a), 1) < 1 << 62 else np.lexsort((value, seg >> 1))
    seg, place = seg[order], place[order]
    each = np.bincount(seg >> 1, minlength=len(a))
    step = np.arange(len(seg)) - np.repeat(np.cumsum(each) - each, each)
    cols = [both.ids[a][seg >> 1], both.ids[b][seg >> 1], step, (seg & 1).astype(np.int32), both.off[which[seg]] + place]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["src", "dst", "step", "side", "addr"])


def met(near: Lists, far: Lists) -> Batches:
    """Traces, in both directions, of the edges from a list of ``far`` up to one of ``near``."""
    here = np.flatnonzero((far.values >= near.ids[0]) & (far.values <= near.ids[-1]))
    low = np.searchsorted(far.start, here, "right") - 1
    up = np.searchsorted(near.ids, far.values[here])
    edge = (far.values[here] > far.ids[low]) & (near.ids[up] == far.values[here])
    up, low = up[edge], low[edge]
    both = Lists.joined([near, far])
    for s in cuts(2 * (near.lengths[up] + far.lengths[low])):
        x, y = up[s], low[s] + len(near.ids)
        yield steps(both, np.concatenate([x, y]), np.concatenate([y, x]))


def pack(lists: DataFrame, starts: Sequence[tuple[int, int]]) -> DataFrame:
    """(block, up, size, data), a row a block, from (block, id, off, nbrs) in order inside each partition: its lists, and the blocks of
    their larger neighbours.  ``starts`` are the blocks and their first ids, in order."""
    number, first = np.array(starts, dtype=np.int64).reshape(-1, 2).T

    def row(block: int, parts: list[Lists]) -> pa.RecordBatch:
        own = Lists.joined(parts)
        above = own.values[own.values > np.repeat(own.ids, own.lengths)]
        up = number[np.unique(np.searchsorted(first, above, "right") - 1)]
        size, data = own.packed()
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([up], pa.list_(pa.int32())), pa.array([size]), pa.array([data], pa.binary())], names=["block", "up", "size", "data"])

    def run(batches: Batches) -> Batches:
        block, parts = None, []
        for batch in batches:
            keys = np.asarray(batch.column(0))
            ends = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for i, j in zip(ends, ends[1:], strict=False):
                if j > i and keys[i] != block:
                    if parts:
                        yield row(block, parts)
                    block, parts = int(keys[i]), []
                if j > i:
                    parts.append(Lists.of(batch.slice(i, j - i)))
        if parts:
            yield row(block, parts)

    return lists.select("block", "id", "off", "nbrs").mapInArrow(run, "block int, up array<int>, size long, data binary")


def merge(blocks: DataFrame) -> DataFrame:
    """The trace from the rows of ``pack``: each block meets those of its larger neighbours.  No row of the pairs is shuffled or stored."""
    low = blocks.select(F.col("block").alias("low"), "up", F.col("size").alias("low_size"), F.col("data").alias("low_data"))
    pairs = low.join(blocks.select("block", "size", "data").hint("shuffle_replicate_nl"), F.array_contains("up", F.col("block")))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for same, low_size, low_data, size, data in zip(*batch.columns, strict=True):
                near = Lists.unpacked(size.as_py(), data.as_buffer())
                yield from met(near, near if same.as_py() else Lists.unpacked(low_size.as_py(), low_data.as_buffer()))

    return pairs.select((F.col("low") == F.col("block")).alias("same"), "low_size", "low_data", "size", "data").mapInArrow(run, "src long, dst long, step long, side int, addr long")
