"""Token ids in wavelet matrix files.

Documents in ascending id order are cut into shards of some SHARD_TOKENS ids.  A shard is one value ("file") that holds a table of its
documents and a wavelet matrix of the ids: for every bit from the highest on, a plane of the bits in the order that the higher bits
left, zeros before ones.  Planes carry counts of ones at every 512th bit, so ``access``, ``count`` and ``positions`` of an id take a few
look-ups each without unpacking the rest.

File: ``FWM1``, then little-endian: bits of an id (u32), ids (u64), documents (u64), then the sections, each with its stored length
(u64): document ids (i64 differences), ids a document (u32), zeros by plane (u64), ones before every 512th bit by plane (u32), planes
(bits, most significant first).  All but the planes are compressed with zstandard; planes are stored as they are.

Defined results: null text gives only the end id; a null document id sorts and stays first as the smallest 64-bit number in files and
comes back as null; rows that share a document id follow each other in the order of their texts' hashes, so a repeated row is encoded again next to the
first; an empty table gives no shards; texts of any length are encoded whole; other columns are not looked at.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from threading import Lock

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathom.llm.common import rows_of, tidy
from fathom.plans.staging import Workspace

SHARD_TOKENS = 1 << 20
END = 2
MAGIC = b"FWM1"
NULL_ID = -(1 << 63)
STEP = 512
#: Chunks of texts beyond Latin letters, and words, that a worker remembers, some 200 bytes each.
CHUNKS, PIECES = 100_000, 500_000

# How byte-level vocabularies write the bytes that have no printable character.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _PLAIN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
#: Characters for which the piece pattern and lower case are the same in both libraries: ASCII and Latin letters.
_OTHER = re.compile("[^\x21-\x7e\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-įı-ſ]|<\\|")
# The letters among them; the same pieces in texts that have no other.
_LETTERS = "a-zA-Z\xc0-\xd6\xd8-\xf6\xf8-ſ"
_PLAIN_PIECE = re.compile(rf"[{_LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\s{_LETTERS}0-9]+")
#: The same for texts, which may have the usual white space besides.
_OTHER_TEXT = re.compile("[^\t-\r\x20-\x7e\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-įı-ſ]|<\\|")
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile(r"\s")
#: Characters that are encoded at a time, up to the next white space.
SLICE = 1 << 18


class _Pieces(dict):
    """Ids of words that are normalised already, by the tokenizer's model."""

    def __init__(self, model, kind: str):
        super().__init__()
        self.tokenize, self.kind = model.tokenize, kind

    def __missing__(self, w: str) -> bytes:
        plain = w if w.isascii() else w.encode().decode("latin-1").translate(_BYTES)
        v = self[w] = array(self.kind, [t.id for t in self.tokenize(plain)]).tobytes()
        return v


class _Chunks(dict):
    """Ids of the runs between white space."""

    def __init__(self, pieces: _Pieces, full):
        super().__init__()
        self.pieces, self.full = pieces, full

    def __missing__(self, c: str) -> bytes:
        if c.isascii() and "<|" not in c and c.isprintable():
            low = c.lower()
        elif _OTHER.search(c):
            v = self[c] = self.full(c)
            return v
        else:
            low = unicodedata.normalize("NFC", c).lower()
        v = self[c] = self.pieces[low] if low.isalpha() else b"".join(map(self.pieces.__getitem__, _PIECE.findall(low)))
        return v


class Encoder:
    """``encode(text, add_special_tokens=False)`` of a word tokenizer, remembering what it has seen.

    Nothing that the tokenizer looks at crosses white space, so a text's ids are those of its chunks in turn.  Texts of ASCII and Latin
    letters are normalised here and their words encoded by the library's model; of other texts this is done chunk by chunk, and chunks
    with any other character go through the whole tokenizer.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.wordy = self.recognised()
        self.bits = max(1, max(self.whole.get_vocab().values(), default=1).bit_length())
        #: Ids are kept as little-endian numbers of this kind.
        self.kind = "H" if self.bits <= 16 else "I"
        self.pieces = _Pieces(self.whole.model, self.kind)
        self.chunks = _Chunks(self.pieces, self.full)

    def recognised(self) -> bool:
        """Whether the tokenizer is of the kind whose words can be encoded apart; any other is used as a whole."""
        import json

        spec = json.loads(self.whole.to_str())
        kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        steps = [x.get("type") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        return kinds == ["NFC", "Replace", "Lowercase"] and steps == ["Split", "ByteLevel"] and spec["model"].get("end_of_word_suffix") == "</w>" and not spec["model"].get("ignore_merges")

    def full(self, text: str) -> bytes:
        return array(self.kind, self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.wordy or _ODD_SPACE.search(text):
            return self.full(text)
        if len(text) > SLICE:
            return b"".join(map(self.part, slices(text)))
        return self.part(text)

    def part(self, text: str) -> bytes:
        if len(self.chunks) > CHUNKS:
            self.chunks.clear()
        if len(self.pieces) > PIECES:
            self.pieces.clear()
        if _OTHER_TEXT.search(text):
            return b"".join(map(self.chunks.__getitem__, text.split()))
        low = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower()
        return b"".join(map(self.pieces.__getitem__, _PLAIN_PIECE.findall(low)))


def slices(text: str) -> Iterator[str]:
    """Parts of a long text that end at white space."""
    at = 0
    while at < len(text):
        m = _SPACE.search(text, at + SLICE)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end


_ENCODERS: dict[str, Encoder] = {}
_LOCK = Lock()


def encoder(path: str) -> Encoder:
    """The worker's encoder, which the next task finds filled; one path is held at a time."""
    with _LOCK:
        found = _ENCODERS.get(path)
        if found is None:
            _ENCODERS.clear()
            found = _ENCODERS[path] = Encoder(path)
        return found


class Wavelet:
    """A wavelet matrix over ids below 2 ** bits."""

    def __init__(self, n: int, bits: int, planes: list[np.ndarray], zeros: np.ndarray, ones: list[np.ndarray]):
        self.n, self.bits, self.planes, self.zeros, self.ones = n, bits, planes, zeros, ones

    @staticmethod
    def build(ids: np.ndarray, bits: int) -> Wavelet:
        x = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros, ones = [], np.zeros(bits, np.uint64), []
        for k in range(bits):
            on = (x & x.dtype.type(1 << (bits - 1 - k))) != 0
            planes.append(np.packbits(on))
            ones.append(Wavelet.samples(planes[-1]))
            x = np.concatenate([np.compress(~on, x), np.compress(on, x)])
            zeros[k] = len(ids) - int(np.count_nonzero(on))
        return Wavelet(len(ids), bits, planes, zeros, ones)

    @staticmethod
    def samples(plane: np.ndarray) -> np.ndarray:
        """Ones before every STEP-th bit."""
        words = np.zeros(-(-len(plane) // (STEP // 8)) * (STEP // 8), np.uint8)
        words[: len(plane)] = plane
        return np.concatenate([[0], np.cumsum(np.bitwise_count(words).reshape(-1, STEP // 8).sum(axis=1, dtype=np.int64))]).astype(np.uint32)

    def rank(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        block = i // STEP
        first = block * (STEP // 8)
        full = i // 8
        n = int(self.ones[k][block]) + int(np.bitwise_count(self.planes[k][first:full]).sum())
        return n + ((int(self.planes[k][full]) >> (8 - i % 8)).bit_count() if i % 8 else 0)

    def select(self, k: int, one: bool, j: int) -> int:
        """Place of the j-th (from 0) one or zero of plane k."""
        ones = self.ones[k].astype(np.int64)
        before = ones if one else np.arange(len(ones), dtype=np.int64) * STEP - ones
        block = int(np.searchsorted(before, j, "right")) - 1
        part = np.unpackbits(self.planes[k][block * (STEP // 8) : (block + 1) * (STEP // 8)])
        return block * STEP + int(np.flatnonzero(part == one)[j - int(before[block])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for k in range(self.bits):
            r = self.rank(k, i)
            on = self.rank(k, i + 1) - r
            out = out << 1 | on
            i = int(self.zeros[k]) + r if on else i - r
        return out

    def _range(self, value: int, i: int, j: int) -> tuple[int, int]:
        for k in range(self.bits):
            a, b = self.rank(k, i), self.rank(k, j)
            i, j = (int(self.zeros[k]) + a, int(self.zeros[k]) + b) if value >> (self.bits - 1 - k) & 1 else (i - a, j - b)
        return i, j

    def count(self, value: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of an id between two places."""
        i, j = self._range(value, start, self.n if stop is None else stop)
        return j - i

    def positions(self, value: int) -> Iterator[int]:
        """Places of an id, ascending."""
        i, j = self._range(value, 0, self.n)
        for p in range(i, j):
            for k in range(self.bits - 1, -1, -1):
                on = bool(value >> (self.bits - 1 - k) & 1)
                p = self.select(k, on, p - int(self.zeros[k]) if on else p)
            yield p

    def ids(self) -> np.ndarray:
        """All ids in order."""
        x = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for k in range(self.bits - 1, -1, -1):
            on = np.unpackbits(self.planes[k], count=self.n).view(bool)
            up, z = np.empty_like(x), int(self.zeros[k])
            up[np.flatnonzero(~on)] = x[:z]
            up[np.flatnonzero(on)] = x[z:] | x.dtype.type(1 << (self.bits - 1 - k))
            x = up
        return x.astype(np.uint32)


def pack(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    """A shard file."""
    import zstandard

    w = Wavelet.build(ids, bits)
    small = zstandard.ZstdCompressor(level=3)
    tables = [np.diff(doc_ids, prepend=0).astype("<i8"), lengths.astype("<u4"), w.zeros.astype("<u8"), np.concatenate(w.ones or [np.zeros(0, np.uint32)]).astype("<u4")]
    sections = [small.compress(t.tobytes()) for t in tables] + [b"".join(p.tobytes() for p in w.planes)]
    return MAGIC + struct.pack("<IQQ", bits, len(ids), len(doc_ids)) + b"".join(struct.pack("<Q", len(s)) + s for s in sections)


def unpack(b: bytes) -> tuple[np.ndarray, np.ndarray, Wavelet]:
    """(document ids, ids a document, wavelet matrix) of a shard file."""
    import zstandard

    if b[:4] != MAGIC:
        raise ValueError("not a shard file")
    bits, n, docs = struct.unpack_from("<IQQ", b, 4)
    sections, i = [], 24
    while i < len(b):
        (size,) = struct.unpack_from("<Q", b, i)
        sections.append(b[i + 8 : i + 8 + size])
        i += 8 + size
    plain = zstandard.ZstdDecompressor()
    a, c, z, o = (plain.decompress(s) for s in sections[:4])
    width = -(-n // 8)
    planes = [np.frombuffer(sections[4], np.uint8, width, k * width) for k in range(bits)]
    ones = np.frombuffer(o, "<u4").reshape(bits, -1)
    with np.errstate(over="ignore"):
        doc_ids = np.cumsum(np.frombuffer(a, "<i8"))
    if len(doc_ids) != docs:
        raise ValueError("broken document table")
    return doc_ids, np.frombuffer(c, "<u4"), Wavelet(n, bits, planes, np.frombuffer(z, "<u8"), list(ones))


def write_shards(docs: DataFrame, space: Workspace, name: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end: int = END, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode, sort and write; gives the table of files (shard, first_doc, n_docs, n_tokens, payload).

    Documents are dealt to tasks by ranges of ids (and of hashes inside an id), so files are in order among each other and no task sees the whole.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("d"), F.col(text).alias("t"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the text's hash splits an id that has very many rows, such as the null one
    rows = rows.withColumn("h", F.xxhash64("t"))
    ordered = rows.repartitionByRange(parts, "d", "h").sortWithinPartitions("d", "h", "t").select("d", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = encoder(tokenizer)
        width = 2 if coder.kind == "H" else 4
        stop, task = array(coder.kind, [end]).tobytes(), TaskContext.get().partitionId()
        held_ids: list[int] = []
        held: list[bytes] = []
        size = made = 0

        def flush() -> pa.RecordBatch:
            nonlocal held_ids, held, size, made
            lengths = np.array([len(x) // width for x in held], np.int64)
            ids = np.frombuffer(b"".join(held), coder.kind)
            d = np.array(held_ids, np.int64)
            out = pa.RecordBatch.from_arrays([pa.array([task << 32 | made], pa.int64()), pa.array([held_ids[0]], pa.int64()), pa.array([len(d)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([pack(d, lengths, ids, coder.bits)], pa.binary())], names=["shard", "first_doc", "n_docs", "n_tokens", "payload"])
            held_ids, held, size, made = [], [], 0, made + 1
            return out

        for batch in batches:
            for part in rows_of(batch, 1):
                for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    held_ids.append(d)
                    held.append(coder.encode(t) + stop)
                    size += len(held[-1]) // width
                    if size >= shard_tokens:
                        yield flush()
        if held:
            yield flush()

    return space.put(name, ordered.mapInArrow(tidy(run), "shard long, first_doc long, n_docs long, n_tokens long, payload binary"), codec="uncompressed")


def read_shards(files: DataFrame) -> DataFrame:
    """(doc_id, shard, start, n_tokens, ids_crc32) from the files; ``start`` counts the ids of all documents before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids, lengths, w = unpack(payload.as_py())
                raw, stops = memoryview(w.ids().astype("<u4").tobytes()), np.cumsum(lengths, dtype=np.int64)
                starts = stops - lengths
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(np.full(len(doc_ids), shard), pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths.astype(np.int64), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "shard", "local", "n_tokens", "ids_crc32"])

    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    starts = files.select("shard", F.coalesce(F.sum("n_tokens").over(upto), F.lit(0)).cast("long").alias("base"))
    rows = files.select("shard", "payload").mapInArrow(tidy(run), "doc_id long, shard long, local long, n_tokens long, ids_crc32 long")
    return rows.join(starts, "shard").select(F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), "shard", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def word_tokenizer() -> str:
    """Path of the public word tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_table(docs: DataFrame, tokenizer: str | None = None, **how) -> DataFrame:
    """Write the files into the shared folder and read them back."""
    space = Workspace(docs.sparkSession)
    return read_shards(write_shards(docs, space, "shards", tokenizer or word_tokenizer(), **how))
