"""Media columns: signature sniffing, structure checks, corrected types and carved spans.

One Aho-Corasick pass over the bytes finds every magic number; a validator for the format then walks its chunks,
blocks, segments, pages or boxes and tells where the file ends, or that there is none. A value's type is that of a
valid file at offset 0, else what was declared; a declared type that the bytes contradict is corrected. Valid
files elsewhere in the bytes are carved; a file inside another carved file is not listed again.

Cases: null bytes have a null type and no spans; truncated files and chance magic numbers are not files; equal
bytes give equal results; no rows give no rows; other columns are kept.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text

SAMPLE_RATE = 16000
BLOCK = 192
SLICE_BYTES = 4 << 20
SPANS = "array<struct<type string, offset long, length long, body_offset long, body_length long>>"
_SPAN = pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("body_offset", pa.int64()), ("body_length", pa.int64())])

Found = tuple[int, int, int] | None  # length, and where the body begins and how long it is


def _riff(data: memoryview, at: int, kind: bytes) -> Found:
    if len(data) < at + 12 or bytes(data[at + 8 : at + 12]) != kind:
        return None
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    if end > len(data):
        return None
    body, p, chunks = None, at + 12, set()
    while p + 8 <= end:
        name, size = bytes(data[p : p + 4]), struct.unpack_from("<I", data, p + 4)[0]
        if p + 8 + size > end:
            return None
        chunks.add(name)
        if name in (b"data", b"VP8 ", b"VP8L") and body is None:
            body = (p + 8 - at, size)
        p += 8 + size + size % 2
    if p != end or body is None or kind == b"WAVE" and b"fmt " not in chunks:
        return None
    return end - at, *body


def _png(data: memoryview, at: int) -> Found:
    p, body, first = at + 8, None, True
    while p + 12 <= len(data):
        size, name = struct.unpack_from(">I", data, p)[0], bytes(data[p + 4 : p + 8])
        if p + 12 + size > len(data) or first and (name != b"IHDR" or size != 13):
            return None
        if zlib.crc32(data[p + 4 : p + 8 + size]) != struct.unpack_from(">I", data, p + 8 + size)[0]:
            return None
        if name == b"IDAT" and body is None:
            body = (p + 8 - at, size)
        p, first = p + 12 + size, False
        if name == b"IEND":
            return (p - at, *body) if body else None
    return None


def _gif(data: memoryview, at: int) -> Found:
    if len(data) < at + 13:
        return None
    p, body = at + 13 + (3 << (data[at + 10] & 7) + 1 if data[at + 10] & 0x80 else 0), None
    while p < len(data):
        if data[p] == 0x3B:
            return (p + 1 - at, *body) if body else None
        if data[p] == 0x21:
            p += 2
        elif data[p] == 0x2C and p + 10 < len(data):
            p += 10 + (3 << (data[p + 9] & 7) + 1 if data[p + 9] & 0x80 else 0)
            body = body or (p - at, 0)
            p += 1
        else:
            return None
        while p < len(data) and data[p]:
            p += 1 + data[p]
        p += 1
    return None


def _jpeg(data: memoryview, at: int) -> Found:
    p, body = at + 2, None
    while p + 4 <= len(data) and data[p] == 0xFF:
        mark = data[p + 1]
        if mark == 0xD9:
            return (p + 2 - at, *body) if body else None
        size = struct.unpack_from(">H", data, p + 2)[0]
        if size < 2 or p + 2 + size > len(data):
            return None
        p += 2 + size
        if mark == 0xDA:
            start = p
            while p + 1 < len(data) and not (data[p] == 0xFF and data[p + 1] not in (0, *range(0xD0, 0xD8))):
                p += 1
            body = body or (start - at, p - start)
    return (p + 2 - at, *body) if body and p + 2 <= len(data) and data[p] == 0xFF and data[p + 1] == 0xD9 else None


def _bmp(data: memoryview, at: int) -> Found:
    if len(data) < at + 54:
        return None
    size, zero, pixels, header = struct.unpack_from("<IIII", data, at + 2)
    planes, bits = struct.unpack_from("<HH", data, at + 26)
    if zero or header not in (40, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or not 14 + header <= pixels < size or at + size > len(data):
        return None
    return size, pixels, size - pixels


def _ogg(data: memoryview, at: int, dead: set[int]) -> Found:
    """``dead``: pages of chains that failed; a chain that begins at one of them fails too."""
    p, walked = at, []
    while p not in dead and p + 27 <= len(data) and bytes(data[p : p + 5]) == b"OggS\0":
        table = p + 27 + data[p + 26]
        if table > len(data) or (end := table + sum(data[p + 27 : table])) > len(data):
            break
        walked.append(p)
        p, last = end, data[p + 5] & 4
        if last:
            return p - at, 0, p - at
    dead.update(walked)
    return None


def _mp4(data: memoryview, at: int, dead: set[int]) -> Found:
    """``dead``: boxes of chains without media data."""
    p, body, walked = at, None, []
    while p not in dead and p + 8 <= len(data):
        size, name = struct.unpack_from(">I", data, p)[0], bytes(data[p + 4 : p + 8])
        if size < 8 or p + size > len(data) or name not in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"uuid", b"moof", b"sidx", b"mfra"):
            break
        if name == b"mdat":
            body = body or (p + 8 - at, size - 8)
        walked.append(p)
        p += size
    if not body:
        dead.update(walked)
    return (p - at, *body) if body else None


#: magic bytes, their offset in the file, type, validator
FORMATS: list[tuple[bytes, int, str, Callable[[memoryview, int, set[int]], Found]]] = [
    (b"RIFF", 0, "audio/wav", lambda d, at, _: _riff(d, at, b"WAVE")),
    (b"RIFF", 0, "image/webp", lambda d, at, _: _riff(d, at, b"WEBP")),
    (b"\x89PNG\r\n\x1a\n", 0, "image/png", lambda d, at, _: _png(d, at)),
    (b"GIF87a", 0, "image/gif", lambda d, at, _: _gif(d, at)),
    (b"GIF89a", 0, "image/gif", lambda d, at, _: _gif(d, at)),
    (b"\xff\xd8\xff", 0, "image/jpeg", lambda d, at, _: _jpeg(d, at)),
    (b"BM", 0, "image/bmp", lambda d, at, _: _bmp(d, at)),
    (b"OggS", 0, "audio/ogg", _ogg),
    (b"ftyp", 4, "video/mp4", _mp4),
]
_AUTOMATON: list[ahocorasick.Automaton] = []


def _automaton() -> ahocorasick.Automaton:
    if not _AUTOMATON:
        made = ahocorasick.Automaton()
        for magic in {f[0] for f in FORMATS}:
            made.add_word(magic.decode("latin-1"), magic)
        made.make_automaton()
        _AUTOMATON.append(made)
    return _AUTOMATON[0]


def spans(data: bytes) -> list[tuple[str, int, int, int, int]]:
    """(type, offset, length, body_offset, body_length) of the files in ``data``; none lies inside another."""
    view, out, done = memoryview(data), [], 0
    dead: dict[str, set[int]] = {f[2]: set() for f in FORMATS}
    for last, magic in _automaton().iter(data.decode("latin-1")):
        for known, lead, kind, valid in FORMATS:
            at = last + 1 - len(magic) - lead
            if known == magic and at >= done and (got := valid(view, at, dead[kind])):
                out.append((kind, at, got[0], at + got[1], got[2]))
                done = at + got[0]
                break
    return out


def wav(payload: bytes, rate: int = SAMPLE_RATE) -> bytes:
    """8-bit mono PCM whose samples are the payload's bytes."""
    pad = b"\0" * (len(payload) % 2)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + pad


def padded(raw: bytes, block: int = BLOCK) -> bytes:
    """Spaces up to a positive multiple of ``block``."""
    return raw + b" " * (-len(raw) % block if raw else block)


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, declared_type, media: each text as a sound file whose type nobody declared rightly."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text.slices(batches, budget=SLICE_BYTES):
            raw = piece.column(1).cast(pa.binary()).to_pylist()
            files = [wav(padded(x)) for x in raw]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(map(len, raw), pa.int64()), pa.array(["application/octet-stream"] * len(raw)), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "declared_type", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(encode, "doc_id long, n_bytes long, declared_type string, media binary")


def sniffed(media: DataFrame, data: str = "media", declared: str = "declared_type") -> DataFrame:
    """Adds actual_type, corrected (the declared type was wrong) and spans, in place of columns of these names; the bytes stay."""
    media = media.drop("actual_type", "corrected", "spans")
    fields = ", ".join(f"`{c}` {t}" for c, t in media.dtypes)

    def sniff(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text.slices(batches, data, SLICE_BYTES):
            values = piece.column(data).to_pylist()
            told = piece.column(declared).to_pylist()
            found = [spans(x) if x is not None else [] for x in values]
            kinds = [None if x is None else s[0][0] if s and s[0][1] == 0 else t for x, s, t in zip(values, found, told, strict=True)]
            rows = [[dict(zip(_SPAN.names, one, strict=True)) for one in s] for s in found]
            new = [pa.array(kinds, pa.string()), pa.array([k != t for k, t in zip(kinds, told, strict=True)]), pa.array(rows, pa.list_(_SPAN))]
            yield pa.RecordBatch.from_arrays([*piece.columns, *new], [*piece.schema.names, "actual_type", "corrected", "spans"])

    return media.mapInArrow(sniff, f"{fields}, actual_type string, corrected boolean, spans {SPANS}")


def feature(samples: np.ndarray) -> str:
    """Level, spread, crossings of the middle level, and shares of eight amplitude bands, all in whole numbers."""
    n, total = len(samples), int(samples.sum(dtype=np.int64))
    squares = int((samples.astype(np.int64) ** 2).sum())
    high = samples >= 128
    bands = np.bincount(samples >> 5, minlength=8) * 1000 // n
    return f"mean={total * 1000 // n};var={squares * 1000 // n - (total * 1000 // n) ** 2 // 1000};cross={int((high[1:] != high[:-1]).sum())};bands={','.join(map(str, bands))}"


def digests(rows: DataFrame) -> DataFrame:
    """``sniffed`` sound files -> doc_id, n_bytes, and digests of the stored bytes and of the samples read from them. A file that is
    null gets nulls; of one that no format fits, only the stored form has digests."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "type_corrected"]
        for piece in text.slices(batches, "media", SLICE_BYTES):
            col = {n: piece.column(n) for n in piece.schema.names}
            out = []
            for file, found in zip(col["media"].to_pylist(), col["spans"].to_pylist(), strict=True):
                if not found:
                    out.append((None, None, None, None if file is None else len(file), None if file is None else hashlib.sha256(file).hexdigest(), None))
                    continue
                span = found[0]
                samples = file[span["body_offset"] : span["body_offset"] + span["body_length"]]
                out.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(file), hashlib.sha256(file).hexdigest(), feature(np.frombuffer(samples, np.uint8)) if samples else None))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            made = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([col["doc_id"], col["n_bytes"], *made, col["actual_type"], col["corrected"]], names)

    return rows.mapInArrow(digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, type_corrected boolean")
