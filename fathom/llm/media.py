"""Media columns: what binary values really are, by signature sniffing.

An Aho-Corasick automaton finds all magic bytes in one pass; a validator for each format then walks the structure from there and says
where the object ends.  The object at offset 0 decides the type of a value; valid objects further in are carved out.  A sound file's
samples are looked into in the same way when they are read back, so that media inside them comes to light too.

Defined results: null or empty values have type null and nothing carved; a value whose start no validator confirms keeps a type of null;
of objects that lie inside an accepted one only the outer is reported.  Values of any length are read whole, repeated rows get equal
values, an empty table gives an empty one.  Columns of any name pass through.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import append

UNIT = 64
RATE = 8000


def _png(b: bytes, at: int) -> int:
    i = at + 8
    while i + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, i)
        if i + 12 + n > len(b) or (i == at + 8 and (kind != b"IHDR" or n != 13)) or zlib.crc32(b[i + 4 : i + 8 + n]) != struct.unpack_from(">I", b, i + 8 + n)[0]:
            return 0
        i += 12 + n
        if kind == b"IEND":
            return i - at
    return 0


def _gif(b: bytes, at: int) -> int:
    if len(b) < at + 13:
        return 0
    flags = b[at + 10]
    i = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    while i < len(b):
        mark = b[i]
        if mark == 0x3B:
            return i + 1 - at
        if mark == 0x21:
            i += 2
        elif mark == 0x2C and i + 10 < len(b):
            flags = b[i + 9]
            i += 11 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
        else:
            return 0
        while i < len(b) and b[i]:
            i += b[i] + 1
        i += 1
    return 0


def _jpeg(b: bytes, at: int) -> int:
    i, scanned = at + 2, False
    while i + 4 <= len(b) and b[i] == 0xFF:
        mark = b[i + 1]
        if mark == 0xD9:
            return i + 2 - at if scanned else 0
        if not (0xC0 <= mark <= 0xFE) or 0xD0 <= mark <= 0xD8:
            return 0
        n = struct.unpack_from(">H", b, i + 2)[0]
        if n < 2:
            return 0
        i += 2 + n
        if mark == 0xDA:
            scanned = True
            while (i := b.find(b"\xff", i)) >= 0 and i + 1 < len(b) and (b[i + 1] == 0 or 0xD0 <= b[i + 1] <= 0xD7):
                i += 2
            if i < 0:
                return 0
    return i + 2 - at if scanned and b[i : i + 2] == b"\xff\xd9" else 0


def _wav(b: bytes, at: int) -> int:
    if len(b) < at + 12 or b[at + 8 : at + 12] != b"WAVE":
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return 0
    i, kinds = at + 12, []
    while i + 8 <= end:
        kind, n = struct.unpack_from("<4sI", b, i)
        kinds.append(kind)
        i += 8 + n + (n & 1)
    return end - at if i == end and b"fmt " in kinds and b"data" in kinds else 0


def _bmp(b: bytes, at: int) -> int:
    if len(b) < at + 30:
        return 0
    size, zero, offset, header = struct.unpack_from("<IIII", b, at + 2)
    planes, depth = struct.unpack_from("<HH", b, at + 26)
    return size if zero == 0 and 12 <= header <= 124 and 14 + header <= offset <= size <= len(b) - at and planes == 1 and depth in (1, 4, 8, 16, 24, 32) else 0


def _pdf(b: bytes, at: int) -> int:
    if not b[at + 5 : at + 6].isdigit() or b[at + 6 : at + 7] != b".":
        return 0
    ref = b.find(b"startxref", at)
    end = b.find(b"%%EOF", ref) if ref >= 0 else -1
    return end + 5 - at if end >= 0 else 0


def _gzip(b: bytes, at: int) -> int:
    d = zlib.decompressobj(31)
    try:
        i = at
        while i < len(b) and not d.eof:
            d.decompress(b[i : i + 65536])  # what comes out is not kept
            i += 65536
    except zlib.error:
        return 0
    return min(i, len(b)) - len(d.unused_data) - at if d.eof else 0


def _zip(b: bytes, at: int) -> int:
    end = b.find(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return 0
    size, offset, note = struct.unpack_from("<IIH", b, end + 12)
    ok = at + offset + size == end and (b[at + offset : at + offset + 4] == b"PK\x01\x02" or size == 0)
    return end + 22 + note - at if ok and end + 22 + note <= len(b) else 0


def _ogg(b: bytes, at: int) -> int:
    i, last = at, False
    while i + 27 <= len(b) and b[i : i + 4] == b"OggS" and b[i + 4] == 0:
        n = b[i + 26]
        if i + 27 + n > len(b):
            return 0
        last = bool(b[i + 5] & 4)
        i += 27 + n + sum(b[i + 27 : i + 27 + n])
        if i > len(b):
            return 0
        if last:
            return i - at
    return 0


#: What a validator searches for up to the end of the value: where that is missing, it is not asked again.
ENDS = {"pdf": (b"startxref", b"%%EOF"), "zip": (b"PK\x05\x06",)}

# Format name, magic bytes, validator.
FORMATS: list[tuple[str, bytes, Callable[[bytes, int], int]]] = [
    ("png", b"\x89PNG\r\n\x1a\n", _png),
    ("gif", b"GIF87a", _gif),
    ("gif", b"GIF89a", _gif),
    ("jpeg", b"\xff\xd8\xff", _jpeg),
    ("wav", b"RIFF", _wav),
    ("bmp", b"BM", _bmp),
    ("pdf", b"%PDF-", _pdf),
    ("gzip", b"\x1f\x8b\x08", _gzip),
    ("zip", b"PK\x03\x04", _zip),
    ("ogg", b"OggS", _ogg),
]


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, (_, magic, _) in enumerate(FORMATS):
        a.add_word(magic.decode("latin-1"), k)
    a.make_automaton()
    return a


def objects(b: bytes, a) -> list[tuple[str, int, int]]:
    """(format, offset, length) of the valid outermost objects, by offset."""
    out, covered = [], 0
    ends = {name: -2 for name in ENDS}
    for last, k in a.iter(b.decode("latin-1")):
        name, magic, valid = FORMATS[k]
        at = last + 1 - len(magic)
        if name in ends:
            if ends[name] == -2:
                ends[name] = min(b.rfind(x) for x in ENDS[name])
            if ends[name] < at:
                continue
        if at >= covered and (n := valid(b, at)):
            out.append((name, at, n))
            covered = at + n
    return out


def sniff(df: DataFrame, value: str, declared: str | None = None) -> tuple[DataFrame, str]:
    """``df`` with a column of struct(type, corrected, carved); also its name.

    ``type`` is what the value is, ``corrected`` whether that differs from the declared type, ``carved`` the embedded objects with their
    offset, length and SHA-256.
    """

    def make():
        a = automaton()

        def step(values: pa.Array, said: pa.Array | None = None) -> list:
            names = said.to_pylist() if said is not None else [None] * len(values)
            rows = []
            for v, name in zip(values, names, strict=True):
                b = v.as_py() or b""
                found = objects(b, a)
                kind = found[0][0] if found and found[0][1] == 0 else None
                carved = [{"type": k, "offset": at, "length": n, "sha256": hashlib.sha256(b[at : at + n]).hexdigest()} for k, at, n in found if at]
                rows.append({"type": kind, "corrected": said is not None and kind is not None and kind != name, "carved": carved})
            return [rows]

        return step

    out, (name,) = append(df, [value] if declared is None else [value, declared], make, [("media", "struct<type:string,corrected:boolean,carved:array<struct<type:string,offset:bigint,length:bigint,sha256:string>>>")])
    return out, name


def to_wav(payload: bytes) -> bytes:
    """Mono 8-bit samples."""
    pad = b"\0" * (len(payload) & 1)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload + pad


def from_wav(b: bytes) -> bytes:
    """The samples of a file that ``to_wav`` or another writer of 8-bit samples made."""
    i = 12
    while i + 8 <= len(b):
        kind, n = struct.unpack_from("<4sI", b, i)
        if kind == b"data":
            return b[i + 8 : i + 8 + n]
        i += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def padded(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, its UTF-8 filled with zeros to a positive multiple of UNIT)."""
    b = (text or "").encode("utf-8", "surrogatepass")
    return len(b), b + bytes((-len(b)) % UNIT or (0 if b else UNIT))


def store_text(df: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``df`` with each text stored as a sound file, in a column of struct(n_bytes, stored); also its name."""

    def make():
        def step(texts: pa.Array) -> list:
            rows = []
            for t in texts:
                n, payload = padded(t.as_py())
                rows.append({"n_bytes": n, "stored": to_wav(payload)})
            return [rows]

        return step

    out, (name,) = append(df, [text], make, [("media_file", "struct<n_bytes:bigint,stored:binary>")])
    return out, name


def read_back(df: DataFrame, stored: str) -> tuple[DataFrame, str]:
    """``df`` with digests and features of the samples read from stored sound files; also the column's name.

    ``low``, ``high``, ``total`` and ``crossings`` (of the middle, 128) describe the samples, ``embedded`` the objects among them.
    """

    def make():
        a = automaton()

        def step(values: pa.Array) -> list:
            rows = []
            for v in values:
                b = v.as_py()
                payload = from_wav(b)
                x = np.frombuffer(payload, np.uint8)
                up = x >= 128
                inside = [{"type": k, "offset": at, "length": n} for k, at, n in objects(payload, a)]
                shape = {"low": int(x.min()), "high": int(x.max()), "total": int(x.sum(dtype=np.int64)), "crossings": int(np.count_nonzero(up[1:] != up[:-1])), "embedded": inside} if len(x) else {"embedded": inside}
                rows.append(shape | {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-UNIT:]), "media_bytes": len(b), "media_sha256": hashlib.sha256(b).hexdigest()})
            return [rows]

        return step

    out, (name,) = append(df, [stored], make, [("samples", "struct<payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string,low:int,high:int,total:bigint,crossings:bigint,embedded:array<struct<type:string,offset:bigint,length:bigint>>>")])
    return out, name


def media_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: its text stored as sound, read back, sniffed under the type of the text that it was, and described.

    ``feature``: type found; whether that corrects the declared one; number, width and rate of the samples; their lowest, highest, sum
    and crossings of the middle; objects embedded in them as type@offset+length.
    """
    stored, f = store_text(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text")
    files = stored.select("doc_id", F.col(f)["n_bytes"].alias("n_bytes"), F.col(f)["stored"].alias("stored"), F.lit("text").alias("declared"))
    read, s = read_back(files, "stored")
    seen, m = sniff(read, "stored", "declared")
    place = lambda c: F.concat_ws("@", c["type"], F.concat_ws("+", c["offset"].cast("string"), c["length"].cast("string")))
    numbers = F.concat_ws(",", *[F.col(s)[x].cast("string") for x in ("low", "high", "total", "crossings")])
    feature = F.concat_ws(
        ";",
        F.coalesce(F.col(m)["type"], F.lit("unknown")),
        F.when(F.col(m)["corrected"], "corrected").otherwise("declared"),
        F.concat(F.col(s)["payload_bytes"].cast("string"), F.lit(f"x8@{RATE}")),
        numbers,
        F.array_join(F.transform(F.concat(F.col(s)["embedded"], F.transform(F.col(m)["carved"], lambda c: F.struct(c["type"], c["offset"], c["length"]))), place), "+"),
    )
    digests = [F.col(s)[x].alias(x) for x in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")]
    return seen.select("doc_id", "n_bytes", *digests, feature.alias("feature"))
