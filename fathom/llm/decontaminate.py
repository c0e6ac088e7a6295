"""Benchmark decontamination by Wu-Manber search over words.

The alphabet is words, the block two adjacent words: a window of m words gives shifts of up to m - 1 words, so most positions are never
looked at.  Windows of equal length share one table; items shorter than a window have tables of their own.  Windows are numbers in
arrays; a Python worker builds them once, for all its tasks.

Defined results: null text has no words; an item without words is never found; an item id of null marks words but is not listed;
repeated items and rows count as they are; texts of any length are searched whole; without documents there are no rows, without items no
hits; columns of any name pass through.
"""

from __future__ import annotations

import math
import uuid
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import append, mix64, text_bytes

WINDOW = 13
#: Benchmark text that is searched for in one pass over the documents; more text takes more passes.
BLOCK_BYTES = 16 << 20
_SPREAD = 0x9E3779B1

_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, ASCII letters (lower-cased) and non-ASCII characters."""
    return [] if not text else text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class WuManber:
    """Search for all windows of one length m in a sequence of word numbers.

    A block of two words has a slot, which is a hash of both; ``shift`` holds a byte for each slot, ``first`` where the slot's bucket of
    windows begins.  Windows are places in ``words``, so a window costs some bytes, whatever its length.
    """

    def __init__(self, words: np.ndarray, starts: np.ndarray, owners: np.ndarray, m: int):
        """``starts``: places of the windows, ``owners``: the item of each."""
        self.m, self.block = m, min(2, m)
        self.far = min(m - self.block + 1, 255)
        bits = max(8, int(2 * len(starts)).bit_length())
        self.mask, self.words = (1 << bits) - 1, array("i", words.tobytes())
        starts, self.group, self.owners = self._distinct(words, starts, owners)
        shift = np.full(1 << bits, self.far, np.uint8)
        for j in range(self.block - 1, m):
            np.minimum.at(shift, self._slots(words, starts + j), min(m - 1 - j, 255))
        self.shift = shift.tobytes()
        slots = self._slots(words, starts + m - 1)
        order = np.argsort(slots, kind="stable")
        self.first = array("I", np.concatenate([[0], np.cumsum(np.bincount(slots, minlength=1 << bits))]).astype(np.uint32).tobytes())
        self.starts = array("i", starts[order].astype(np.int32).tobytes())
        self.which = array("i", order.astype(np.int32).tobytes())

    def _distinct(self, words: np.ndarray, starts: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, array, array]:
        """One place for each different window, and (where they begin, items) of the items that have it."""
        h = np.zeros(len(starts), np.uint64)
        for j in range(self.m):
            h = mix64(h ^ words[starts + j].astype(np.uint64))
        order = np.lexsort((starts, h))
        starts, owners, h = starts[order], owners[order], h[order]
        fresh = np.ones(len(starts), bool)
        fresh[1:] = h[1:] != h[:-1]
        for j in range(self.m):
            fresh[1:] |= words[starts[1:] + j] != words[starts[:-1] + j]
        return starts[fresh], array("i", np.append(np.flatnonzero(fresh), len(starts)).astype(np.int32).tobytes()), array("i", owners.astype(np.int32).tobytes())

    def _slots(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        last = words[at].astype(np.int64)
        return (last if self.block == 1 else words[at - 1].astype(np.int64) * _SPREAD + last) & self.mask

    def search(self, ids: array) -> Iterator[tuple[int, int]]:
        """(start, number of the window) of every occurrence."""
        m, shift, first, starts, words, n, mask, two = self.m, self.shift, self.first, self.starts, self.words, len(ids), self.mask, self.block == 2
        i = m - 1
        while i < n:
            slot = (ids[i - 1] * _SPREAD + ids[i] if two else ids[i]) & mask
            skip = shift[slot]
            if skip:
                i += skip
                continue
            start = i - m + 1
            for k in range(first[slot], first[slot + 1]):
                p = starts[k]
                if words[p] == ids[start] and words[p : p + m] == ids[start : i + 1]:
                    yield start, self.which[k]
                    break  # windows are distinct
            i += 1

    def items(self, window: int) -> array:
        return self.owners[self.group[window] : self.group[window + 1]]


class Searcher:
    """All windows of a set of items."""

    def __init__(self, items: Iterable[tuple[object, str | None]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        self.names: list = []
        ids, by_len, at = array("i"), defaultdict(list), 0
        for item, text in items:
            own = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            if not own:
                continue
            ids.extend(own)
            by_len[min(window, len(own))].append((at, len(own), len(self.names)))
            self.names.append(item)
            at += len(own)
        words = np.frombuffer(ids, np.int32) if ids else np.zeros(0, np.int32)
        self.engines = []
        for m, places in sorted(by_len.items()):
            counts = np.array([n - m + 1 for _, n, _ in places])
            inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            self.engines.append(WuManber(words, np.repeat([a for a, _, _ in places], counts) + inside, np.repeat([i for _, _, i in places], counts), m))

    def find(self, text: str | None) -> tuple[int, list[tuple[int, int]], set]:
        """(number of words, merged word spans that are hit, items)."""
        get, words = self.vocab.get, words_of(text)
        ids = array("i", [get(w, 0) for w in words])
        hits: list[tuple[int, int]] = []
        items: set = set()
        for engine in self.engines:
            found = set()
            for start, window in engine.search(ids):
                hits.append((start, start + engine.m))
                found.add(window)
            for window in found:
                items.update(self.names[k] for k in engine.items(window))
        return len(ids), merge(hits), items


#: The last searcher of a Python worker, which serves one task after another.
_BUILT: dict[str, Searcher] = {}


def _searcher(key: str, items: Callable[[], list], window: int) -> Searcher:
    found = _BUILT.get(key)
    if found is None:
        _BUILT.clear()
        found = _BUILT[key] = Searcher(items(), window)
    return found


def merge(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans; touching ones join."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str]:
    """``docs`` with a column of struct(n_words, spans of hit words, items); also that column's name.

    The benchmark's size is measured first.  It is searched for in blocks of some ``block_bytes`` of item text, each of which goes to
    the executors as one bounded table; a document keeps its hits from block to block, so any size of benchmark works.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"))
    blocks = max(1, math.ceil(text_bytes(items, "t") / block_bytes))
    out, name = docs, ""
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        held, key = docs.sparkSession.sparkContext.broadcast(sorted(((r[0], r[1]) for r in part.collect()), key=repr)), uuid.uuid4().hex

        def make(held=held, key=key):
            searcher = _searcher(key, lambda: held.value, window)

            def step(texts: pa.Array, before: pa.Array | None = None) -> list:
                rows = []
                old = before.to_pylist() if before is not None else [None] * len(texts)
                for t, o in zip(texts.to_pylist(), old, strict=True):
                    n, spans, found = searcher.find(t)
                    if o:
                        spans = merge([*spans, *[(s["start"], s["end"]) for s in o["spans"]]])
                        found = found | set(o["items"])
                    rows.append({"n_words": n, "spans": [{"start": a, "end": b} for a, b in spans], "items": sorted(x for x in found if x is not None)})
                return [rows]

            return step

        cols = out.columns
        out, (new,) = append(out, [text] if not name else [text, name], make, [("benchmark_hits", "struct<n_words:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<string>>")])
        out = out.select(*[c for c in cols if c != name], F.col(new).alias(name or new)) if name else out
        name = name or new
    return out, name


def n_hit(hits: str) -> Column:
    return F.aggregate(F.col(hits)["spans"], F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])


def is_contaminated(hits: str) -> Column:
    """Hit at all, and a twentieth of the words or more."""
    return (n_hit(hits) > 0) & (20 * n_hit(hits) >= F.col(hits)["n_words"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents that are not contaminated, with their own columns only."""
    found, name = find_benchmark(docs, benchmark, **how)
    return found.where(~is_contaminated(name)).select(*docs.columns)
