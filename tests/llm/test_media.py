import gzip
import io
import struct
import wave
import zipfile
import zlib

from llm_brute import media as plain
from pyspark.sql import functions as F

from fathom.llm import media

PNG = b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in ((b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(b"\0\0")), (b"IEND", b"")))
GIF = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
JPEG = b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x03x" + b"data\xff\0more" + b"\xff\xd9"
BMP = b"BM" + struct.pack("<IIIIiiHH", 58, 0, 54, 40, 1, 1, 1, 24) + bytes(28)
PDF = b"%PDF-1.4\nx\nstartxref\n0\n%%EOF"


def samples():
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a", "b")
    return {"png": PNG, "gif": GIF, "jpeg": JPEG, "bmp": BMP, "pdf": PDF, "wav": media.to_wav(b"1234"), "gzip": gzip.compress(b"hello"), "zip": z.getvalue()}


def test_types_lengths_and_carving():
    a = media.automaton()
    for name, b in samples().items():
        assert media.objects(b, a) == [(name, 0, len(b))], name
        assert media.objects(b"junk" + b + b"tail", a) == [(name, 4, len(b))], name
        assert media.objects(b[:-1], a) == [], name
    both = b"x" + PNG + b"BM" + GIF
    assert [(k, at) for k, at, _ in media.objects(both, a)] == [("png", 1), ("gif", 1 + len(PNG) + 2)]


def test_declared_types(spark):
    rows = [(1, bytearray(PNG), "image"), (2, bytearray(b"a" + GIF), "gif"), (3, None, "png"), (4, bytearray(b""), None), (5, bytearray(GIF), "gif"), (5, bytearray(GIF), "gif")]
    df = spark.createDataFrame(rows, "id int, media binary, declared string")
    out, name = media.sniff(df, "media", "declared")
    got = sorted((r.id, r[name].type, r[name].corrected, [(c.type, c.offset, c.length) for c in r[name].carved]) for r in out.collect())
    assert got == [(1, "png", True, []), (2, None, False, [("gif", 1, len(GIF))]), (3, None, False, []), (4, None, False, []), (5, "gif", False, []), (5, "gif", False, [])]


def test_stored_form_is_a_sound_file():
    n, payload = media.padded("héllo")
    with wave.open(io.BytesIO(media.to_wav(payload))) as f:
        assert f.getparams()[:3] == (1, 1, media.RATE) and f.readframes(10**6) == payload
    assert (n, len(payload)) == (6, 64) and media.from_wav(media.to_wav(payload)) == payload
    assert media.from_wav(media.to_wav(b"odd")) == b"odd"


def test_digest(docs, corpus, none):
    rows = media.media_digest(docs).collect()
    assert len(rows) == len(corpus)
    texts = {d: t for d, t, *_ in corpus}
    for r in rows:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == plain(texts[r.doc_id])
        assert r.media_bytes == r.payload_bytes + 44 and r.feature.startswith("wav;corrected;")
    assert media.media_digest(none).count() == 0
    assert len({(r.media_sha256, r.feature) for r in rows if texts[r.doc_id] in (None, "")}) == 1


def test_media_inside_stored_texts(spark):
    """Features come from the samples; what a text embeds is found in the sound file and carved at its place."""
    pdf = PDF.decode()
    rows = [(1, "see " + pdf + " and GIF89a"), (2, "%PDF-1.4 " * 50_000), (3, "RIFF OggS BM PK\x03\x04 %PDF-1.4 startxref"), (4, "x\x00" + pdf + "é" + pdf), (5, None), (5, None), (6, "y" * 1_000_000)]
    got = {r.doc_id: r.feature for r in media.media_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = len(PDF)
    for doc, text in rows:
        payload = media.padded(text)[1]
        up = [v >= 128 for v in payload]
        crossings = sum(a != b for a, b in zip(up, up[1:], strict=False))
        inside = {1: f"pdf@4+{n}", 4: f"pdf@2+{n}+pdf@{4 + n}+{n}"}.get(doc, "")
        assert got[doc] == f"wav;corrected;{len(payload)}x8@{media.RATE};{min(payload)},{max(payload)},{sum(payload)},{crossings};{inside}"
    a = media.automaton()
    b = media.to_wav(media.padded(rows[0][1])[1])
    assert media.objects(b, a) == [("wav", 0, len(b))] and media.objects(media.from_wav(b), a) == [("pdf", 4, n)]


def test_mended_declarations_of_stored_media(spark):
    """A table of files under wrong names, each with another one behind it."""
    kinds = list(samples().items())
    rows = [(i, bytearray(b + kinds[i - 1][1]), kinds[i - 2][0]) for i, (_, b) in enumerate(kinds)]
    out, name = media.sniff(spark.createDataFrame(rows, "id int, media binary, declared string"), "media", "declared")
    for r in out.collect():
        kind, b = kinds[r.id]
        behind = kinds[r.id - 1]
        assert r[name].type == kind and r[name].corrected
        assert [(c.type, c.offset, c.length) for c in r[name].carved] == [(behind[0], len(b), len(behind[1]))], kind


def test_extra_columns_pass(docs):
    out, name = media.store_text(docs)
    assert out.columns[:-1] == docs.columns and out.where(F.col(name)["stored"].isNull()).count() == 0
