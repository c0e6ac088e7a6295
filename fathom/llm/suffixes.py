"""Exact substring removal by distributed prefix doubling over sampled suffixes.

A byte goes when it lies in a string of LENGTH bytes that also starts earlier: in a document of smaller id, or in the same one further
left.  ``doubled`` below is the plain form, a row for every byte and round: it shuffles 225 bytes for a byte of text.  So
``remove_repeats`` ranks fewer suffixes by the same steps, growing ranks of those that are not yet unique:

1. Rank by the first FIRST bytes, for one suffix out of some thirty: each window of LENGTH bytes names the suffix inside it whose
   FIRST bytes hash lowest, so equal windows name the same place.  Consecutive windows that name one place form a run.  Runs are sorted
   by (rank, rank of all bytes the run covers, document, start); the second is the first one grown to the run's full length.  A
   run whose first rank is unique has no repeated window and is dropped.  A run that equals an earlier run in full is removed.
2. Where one first rank has runs of different content, single windows remain: their ranks are grown to LENGTH and sorted again by
   (rank, document, start).  All but the first of a rank are removed.

Ranks are 64-bit hashes (of powers of an odd base over random byte values, then mixed), so sorting them orders equal strings together;
two different strings of a corpus share one with probability 2**-64.  Runs and windows travel in packed pieces by bucket of their rank.
What repeats inside a step of some megabytes is settled on the spot, so a string that half of the corpus shares sends one row a step.
A line shorter than LENGTH that very many documents have gives one first rank to as many different runs: a step that meets over CROWD of
them knows already that they are not unique, passes them on to the longer ranks that tell them apart, and sends their first rank one run
as a mark, which opens what other steps have of it.

Defined results: null text is empty; a null document id counts as the smallest; rows that share an id are one document as far as
"earlier" goes, so exact copies under one id keep their bytes, and different texts of one id lose what starts further left in another;
texts of any length are worked on whole, a long one in overlapping pieces; an empty table gives an empty one; other columns are not
looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathom.llm.common import mix64, rows_of, text_bytes, tidy
from fathom.plans.staging import Workspace, checkpoint

LENGTH = 100
FIRST = 40
#: Text bytes that a bucket stands for, and buckets that there are at least.  Every task sends a piece to every bucket that it has rows
#: for, so their number follows the text, not the number of tasks.
BUCKET_BYTES, LEAST_BUCKETS = 16 << 20, 128
#: Runs of one first rank that a step sends there.
CROWD = 8
#: Documents with open runs that are named to all tasks, 8 bytes each; beyond, all texts are dealt out again.
BROADCAST_ROWS = 500_000
#: Text bytes that are hashed at a time, and of which repeats are settled at once.
PIECE = 1 << 20
SETTLE = 16 << 20
NULL_ID = -(1 << 63)
#: Where texts share an id, a 32-bit hash from this bit of a start on tells them apart; a text has fewer bytes.
TAG_BIT = 31
_START = (1 << TAG_BIT) - 1
_BASE = 0x9E3779B97F4A7C15
_LOW = (1 << 24) - 1
_LIST = "kind int, bucket long, doc_id long, text string, piece binary"


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Hashes of any substring of a buffer, from one running sum."""

    def __init__(self):
        rng = np.random.Generator(np.random.PCG64(7))
        self.values = rng.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
        self.up, self.down = _powers(1 << 16, _BASE), _powers(1 << 16, pow(_BASE, -1, 1 << 64))

    def load(self, data: np.ndarray) -> None:
        n = len(data)
        if len(self.up) < n + 1:
            self.up, self.down = _powers(n + n // 4 + 1, _BASE), _powers(n + n // 4 + 1, pow(_BASE, -1, 1 << 64))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix64((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))

    def all(self, size: int) -> np.ndarray:
        """Of every substring of one size."""
        n = len(self.sums) - size
        return mix64((self.sums[size:] - self.sums[:n]) * self.down[:n] + np.uint64(size))


def runs(hasher: Hasher, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int, first: int) -> tuple[np.ndarray, ...]:
    """(first rank, full rank, document number, start in the document, windows) of the runs of a buffer of documents."""
    none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    n = len(data) - length + 1
    if n <= 0:
        return none
    hasher.load(data)
    rank = hasher.all(first)
    low = (rank & ~np.uint64(_LOW)) | np.arange(len(rank), dtype=np.uint64)
    width, cover = length - first + 1, 1
    while cover * 2 <= width:
        low = np.minimum(low[:-cover], low[cover:])
        cover *= 2
    if width > cover:
        low = np.minimum(low[: len(low) - (width - cover)], low[width - cover :])
    at = (low & np.uint64(_LOW)).astype(np.int64)
    bad = np.zeros(n + 1, np.int32)  # windows that leave their document
    a, b = np.clip(starts + np.maximum(sizes - length + 1, 0), 0, n), np.clip(starts + sizes, 0, n)
    np.add.at(bad, a, 1)
    np.add.at(bad, b, -1)
    at[np.cumsum(bad[:n]) > 0] = -1
    cut = np.flatnonzero(at[1:] != at[:-1]) + 1
    lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [n]]) - 1
    keep = at[lo] >= 0
    lo, hi = lo[keep], hi[keep]
    if not len(lo):
        return none
    doc = np.searchsorted(starts, lo, "right") - 1
    return rank[at[lo]], hasher.of(lo, hi + length), doc, lo - starts[doc], hi - lo + 1


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length; whole numbers as differences."""
    import zstandard

    parts = [np.array([len(columns[0])], "<i8").tobytes()]
    for c in columns:
        parts.append(c.tobytes() if c.dtype == np.uint64 else np.diff(c, prepend=c.dtype.type(0)).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(piece: bytes, kinds: str) -> list[np.ndarray]:
    """``kinds``: u for hashes, i for whole numbers, s for small ones."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(piece)
    n, at, out = int(np.frombuffer(raw, "<i8", 1)[0]), 8, []
    for k in kinds:
        t = {"u": np.uint64, "i": np.int64, "s": np.int32}[k]
        c = np.frombuffer(raw, t, n, at)
        at += c.nbytes
        out.append(c if k == "u" else np.cumsum(c, dtype=t))
    return out


def first_of_each(keys: list[np.ndarray], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows at the first place of their keys, sorted by keys; rows after it).  Rows alike in everything are in the first part once."""
    place = start & _START
    order = np.lexsort((start, place, doc, *keys[::-1]))
    fresh, again = np.ones(len(order), bool), np.zeros(len(order), bool)
    if len(order) > 1:
        fresh[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
        again[1:] = ~fresh[1:] & (doc[order[1:]] == doc[order[:-1]]) & (start[order[1:]] == start[order[:-1]])
    head = np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if len(order) else np.zeros(0, np.int64)
    after = (doc[order] != doc[order[head]]) | (place[order] != place[order[head]])
    return order[~after & ~again], order[after]


def tag_of(text: str | None, tagged: bool) -> int:
    """What a text's starts begin at: 0, or a hash of the text where texts share ids."""
    import xxhash

    return xxhash.xxh32_intdigest((text or "").encode("utf-8", "surrogatepass")) << TAG_BIT if tagged else 0


def text_bucket(doc: np.ndarray, start: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a text: by its id, and where texts share ids by its own hash, which its starts begin at."""
    return (mix64(doc.view(np.uint64) ^ mix64((start >> TAG_BIT).astype(np.uint64))) % np.uint64(buckets)).astype(np.int64)


def joined(doc: np.ndarray, start: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of windows by document and start; those that meet are one."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], (start + windows)[order]
    if not len(doc):
        return doc, start, stop - start
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (start[1:] > stop[:-1])
    head = np.flatnonzero(fresh)
    return doc[head], start[head], np.maximum.reduceat(stop, head) - start[head]


def dealt(kind: int, bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(kind, bucket, piece) for each bucket that has rows."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    for a, b in zip(cut, [*cut[1:], len(bucket)], strict=True):
        yield kind, int(bucket[a]), pack(*[c[order[a:b]] for c in columns])


def table(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.array([r[2] for r in rows], pa.binary())], names=["kind", "bucket", "doc_id", "text", "piece"])


# Kinds of pieces.
RANKS, REMOVED, OPEN = 0, 1, 2


def buffers(batch: pa.RecordBatch, doc: int, text: int, length: int, tagged: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document ids, offset of the buffer in its document, bytes, starts, sizes); a long document comes in overlapping pieces."""
    for part in rows_of(batch, text):
        ids, offsets, blobs = [], [], []
        for d, t in zip(part.column(doc).to_pylist(), part.column(text).to_pylist(), strict=True):
            b, tag = t.encode("utf-8", "surrogatepass") if t else b"", tag_of(t, tagged)
            for i in range(0, max(len(b) - length + 1, 1), PIECE):
                ids.append(d)
                offsets.append(tag + i)
                blobs.append(b[i : i + PIECE + length - 1])
        i = 0
        while i < len(blobs):
            j, size = i, 0
            while j < len(blobs) and (j == i or size + len(blobs[j]) <= PIECE + length):
                size += len(blobs[j])
                j += 1
            sizes = np.array([len(x) for x in blobs[i:j]], np.int64)
            yield np.array(ids[i:j], np.int64), np.array(offsets[i:j], np.int64), np.frombuffer(b"".join(blobs[i:j]), np.uint8), np.cumsum(sizes) - sizes, sizes
            i = j


def first_ranks(docs: DataFrame, buckets: int, length: int, first: int, tagged: bool = False) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size = Hasher(), [], 0

        def flush() -> pa.RecordBatch:
            short, full, doc, start, windows = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            rest, same = first_of_each([full], doc, start)
            rest = rest[np.lexsort((start[rest], doc[rest]))]
            _, first_at, of, count = np.unique(short[rest], return_index=True, return_inverse=True, return_counts=True)
            crowded = count[of] > CROWD
            x = rest[crowded]
            rows = list(dealt(OPEN, text_bucket(doc[x], start[x], buckets), doc[x], start[x], windows[x].astype(np.int32)))
            mark = np.zeros(len(rest), bool)
            mark[first_at] = True
            mark &= crowded
            x = rest[~crowded | mark]
            marked = np.where(mark[~crowded | mark], -windows[x], windows[x]).astype(np.int32)  # a mark has its windows below zero
            rows += dealt(RANKS, (short[x] >> np.uint64(1)).astype(np.int64) % buckets, short[x], full[x], doc[x], start[x], marked)
            d, s, w = joined(doc[same], start[same], windows[same])
            rows += dealt(REMOVED, text_bucket(d, s, buckets), d, s, w.astype(np.int32))
            return table(rows)

        for batch in batches:
            for ids, offsets, data, starts, sizes in buffers(batch, 0, 1, length, tagged):
                short, full, doc, start, windows = runs(hasher, data, starts, sizes, length, first)
                held.append((short, full, ids[doc], start + offsets[doc], windows))
                size += len(data)
                if size >= SETTLE:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return docs.mapInArrow(tidy(run), _LIST)


def settled(ranks: DataFrame, buckets: int, kinds: str) -> DataFrame:
    """Sort the rows of each bucket by rank, document and start; give removed intervals and, with two ranks, runs that stay open."""
    two = kinds.startswith("uu")

    def settle(pieces: list[bytes], removed: list[bytes]) -> list[tuple[int, int, bytes]]:
        rows: list[tuple[int, int, bytes]] = []
        gone = [np.concatenate(c) for c in zip(*[unpack(p, "iis") for p in removed], strict=True)] if removed else None
        parts = [gone] if gone is not None else []
        if pieces:
            cols = [np.concatenate(c) for c in zip(*[unpack(p, kinds) for p in pieces], strict=True)]
            keys, (doc, start, windows) = cols[: 2 if two else 1], cols[-3:]
            marks, windows = windows < 0, np.abs(windows)
            heads, same = first_of_each(keys, doc, start)
            parts.append([doc[same], start[same], windows[same]])
            if two:
                short = keys[0][heads]
                twin = np.zeros(len(heads), bool)
                if len(heads) > 1:
                    twin[1:] = short[1:] == short[:-1]
                    twin[:-1] |= twin[1:]
                twin |= np.isin(short, keys[0][marks])
                left = heads[twin]
                rows += dealt(OPEN, text_bucket(doc[left], start[left], buckets), doc[left], start[left], windows[left])
        doc, start, windows = joined(*[np.concatenate(c) for c in zip(*parts, strict=True)]) if parts else (np.zeros(0, np.int64),) * 3
        rows += dealt(REMOVED, text_bucket(doc, start, buckets), doc, start, windows.astype(np.int32))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pieces, removed = None, [], []
        for batch in batches:
            out: list[tuple[int, int, bytes]] = []
            for kind, bucket, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4), strict=True):
                if bucket != key:
                    out += settle(pieces, removed)
                    key, pieces, removed = bucket, [], []
                if kind == OPEN:
                    out.append((kind, bucket, piece.as_py()))
                else:
                    (pieces if kind == RANKS else removed).append(piece.as_py())
            yield table(out)
        yield table(settle(pieces, removed))

    return ranks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(run), _LIST)


def beside(docs: DataFrame, lists: DataFrame, buckets: int, tagged: bool) -> DataFrame:
    """Documents behind the lists of their bucket, in one exchange."""
    # the same number as text_bucket gives: both sides are dealt by a column that Python has made
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0), np.int64)
            n = len(ids)
            tags = np.array([tag_of(t, tagged) for t in batch.column(1).to_pylist()] if tagged else np.zeros(n), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, 9), pa.int32()), pa.array(text_bucket(ids, tags, buckets), pa.int64()), batch.column(0), batch.column(1), pa.nulls(n, pa.binary())], names=["kind", "bucket", "doc_id", "text", "piece"])

    return docs.mapInArrow(tidy(run), _LIST).unionByName(lists).repartition("bucket").sortWithinPartitions("bucket", "kind")


class Lists:
    """Intervals by document of one bucket."""

    def __init__(self):
        self.pieces: list[bytes] = []
        self.index: dict[int, tuple[int, int]] | None = None

    def of(self, doc: int, tag: int) -> tuple[np.ndarray, np.ndarray]:
        if self.index is None:
            cols = [np.concatenate(c) for c in zip(*[unpack(p, "iis") for p in self.pieces], strict=True)] if self.pieces else [np.zeros(0, np.int64)] * 3
            order = np.argsort(cols[0], kind="stable")
            ids, self.start, self.windows = (c[order] for c in cols)
            keys, at, n = np.unique(ids, return_index=True, return_counts=True)
            self.index = {int(k): (int(a), int(a + c)) for k, a, c in zip(keys, at, n, strict=True)}
        a, b = self.index.get(doc, (0, 0))
        start, windows = self.start[a:b], self.windows[a:b]
        own = start >> TAG_BIT == tag >> TAG_BIT
        return start[own] - tag, windows[own]


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[Lists]]]:
    """Slices of document rows with the lists of each row's bucket."""
    key, lists = None, Lists()
    for batch in batches:
        for part in rows_of(batch, 3):
            take, owner = [], []
            kinds, buckets = part.column(0).to_pylist(), part.column(1).to_pylist()
            for i, (kind, bucket) in enumerate(zip(kinds, buckets, strict=True)):
                if bucket != key:
                    key, lists = bucket, Lists()
                if kind == 9:
                    take.append(i)
                    owner.append(lists)
                else:
                    lists.pieces.append(part.column(4)[i].as_py())
            yield part.take(pa.array(take, pa.int64())), owner


def window_ranks(docs: DataFrame, open_runs: DataFrame, buckets: int, length: int, tagged: bool = False) -> DataFrame:
    """Ranks of full length of the windows in open runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for part, owner in by_bucket(batches):
            ranks, docs_, starts_ = [], [], []
            for d, t, lists in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), owner, strict=True):
                tag = tag_of(t, tagged)
                start, windows = lists.of(d, tag)
                if not len(start) or not t:
                    continue
                data = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
                hasher.load(data)
                ends = np.cumsum(windows)
                p = np.repeat(start - (ends - windows), windows) + np.arange(int(ends[-1]))
                ranks.append(hasher.of(p, p + length))
                docs_.append(np.full(len(p), d, np.int64))
                starts_.append(tag + p)
            if not ranks:
                continue
            rank, doc, start = map(np.concatenate, (ranks, docs_, starts_))
            rest, same = first_of_each([rank], doc, start)
            rest = rest[np.lexsort((start[rest], doc[rest]))]
            rows = list(dealt(RANKS, (rank[rest] >> np.uint64(1)).astype(np.int64) % buckets, rank[rest], doc[rest], start[rest], np.ones(len(rest), np.int32)))
            d, s, w = joined(doc[same], start[same], np.ones(len(same), np.int64))
            rows += dealt(REMOVED, text_bucket(d, s, buckets), d, s, w.astype(np.int32))
            yield table(rows)

    return beside(docs, open_runs, buckets, tagged).mapInArrow(tidy(run), _LIST)


def cut_out(docs: DataFrame, removed: DataFrame, buckets: int, length: int, tagged: bool = False) -> DataFrame:
    """(doc_id, n_bytes, spans, kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, owner in by_bucket(batches):
            n, spans, kept = [], [], []
            for d, t, lists in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), owner, strict=True):
                b = t.encode("utf-8", "surrogatepass") if t else b""
                start, windows = lists.of(d, tag_of(t, tagged))
                n.append(len(b))
                _, a, w = joined(np.zeros(len(start), np.int64), start, windows.astype(np.int64) + length - 1)
                e = a + w
                spans.append([{"start": x, "stop": y} for x, y in zip(a.tolist(), e.tolist(), strict=True)])
                at, parts = 0, []
                for x, y in zip(a.tolist(), e.tolist(), strict=True):
                    parts.append(b[at:x])
                    at = y
                kept.append(b"".join([*parts, b[at:]]))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([part.column(2), pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    out = beside(docs, removed, buckets, tagged).mapInArrow(tidy(run), "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NULL_ID)))


def with_lists(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """The documents whose ids the lists name, if those are few enough to tell every task; otherwise all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.unique(unpack(p, "iis")[0]) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(ids)) if ids else [], pa.int64())], names=["doc_id"])

    named = lists.select("piece").mapInArrow(tidy(run), "doc_id long").distinct()
    return docs.join(F.broadcast(named), "doc_id", "left_semi") if named.count() <= BROADCAST_ROWS else docs


def texts_share_ids(rows: DataFrame) -> bool:
    """Whether an id has several texts; a row an id is compared, never the texts themselves."""
    h = F.xxhash64("text")
    return not rows.groupBy("doc_id").agg(F.min(h).alias("low"), F.max(h).alias("high")).where("low <> high").isEmpty()


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, first: int = FIRST) -> DataFrame:
    """(doc_id, n_bytes, spans removed, kept bytes) of every document."""
    if not 1 <= first <= length:
        raise ValueError("first must be from 1 to length")
    spark = docs.sparkSession
    space = Workspace(spark)
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(text).alias("text"))
    buckets = max(LEAST_BUCKETS, math.ceil(text_bytes(rows) / BUCKET_BYTES))
    tagged = texts_share_ids(rows)
    a = space.put("runs", settled(first_ranks(rows, buckets, length, first, tagged), buckets, "uuiis"), codec="uncompressed")
    still = a.where(F.col("kind") == OPEN)
    b = space.put("windows", settled(window_ranks(with_lists(rows, still), still, buckets, length, tagged), buckets, "uiis"), codec="uncompressed")
    removed = a.unionByName(b).where(F.col("kind") == REMOVED)
    return cut_out(rows, removed, buckets, length, tagged)


def doubled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, start) of every string of ``length`` bytes that starts earlier too, by plain prefix doubling.

    Suffixes are ranked by k bytes for k = 1, 2, 4, ...: pairs of the ranks at a place and k bytes further are sorted and renamed by the
    place at which they come first.  Places whose rank is unique leave; the last round joins two overlapping ranks to ``length`` bytes.
    The plain form of ``remove_repeats``, for tests and small corpora with one text an id: every round shuffles a row for every place left.
    """
    size = F.octet_length("text")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8").alias("text"))
    at = docs.where(size >= length).select("doc_id", "text", F.explode(F.sequence(F.lit(0), size - 1)).alias("start"))
    name = lambda *by: F.min(F.struct("doc_id", "start")).over(Window.partitionBy(*by))
    many = lambda *by: F.count("*").over(Window.partitionBy(*by))
    ranks = checkpoint(at.select("doc_id", "start", F.conv(F.hex(F.substring("text", F.col("start") + 1, 1)), 16, 10).cast("long").alias("byte")).select("doc_id", "start", name("byte").alias("rank")))
    k = 1
    while k < length:
        step = min(k, length - k)
        far = ranks.select("doc_id", (F.col("start") - step).alias("start"), F.col("rank").alias("next"))
        pairs = ranks.join(far, ["doc_id", "start"])
        ranks = checkpoint(pairs.select("doc_id", "start", name("rank", "next").alias("to"), many("rank", "next").alias("n")).where("n > 1").select("doc_id", "start", F.col("to").alias("rank")))
        k += step
    return ranks.where(F.struct("doc_id", "start") != F.col("rank")).select("doc_id", "start")
