import hashlib
import struct
import zlib

from codeloom.llm import media, queries


def png(pixels=b"\0\xff"):
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(pixels)) + chunk(b"IEND", b"")


def bmp():
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\1\2\3\0"


GIF = b"GIF89a\1\0\1\0\x80\0\0\0\0\0\xff\xff\xff!\xf9\4\0\0\0\0\0,\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
JPEG = b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\4ab\1\2\xff\0\3\xff\xd9"
OGG = b"OggS\0\2" + b"\0" * 20 + b"\1\3abc" + b"OggS\0\4" + b"\0" * 20 + b"\1\2xy"
MP4 = struct.pack(">I4s8s", 16, b"ftyp", b"isom\0\0\0\0") + struct.pack(">I4s4s", 12, b"mdat", b"data")


def test_every_format_whole_and_embedded():
    files = {"audio/wav": media.wav(b"abc"), "image/png": png(), "image/bmp": bmp(), "image/gif": GIF, "image/jpeg": JPEG, "audio/ogg": OGG, "video/mp4": MP4}
    for kind, data in files.items():
        assert [s[:3] for s in media.spans(data)] == [(kind, 0, len(data))]
        assert [s[:3] for s in media.spans(b"junk BM GIF89a" + data + b"tail")] == [(kind, 14, len(data))]
        assert [s for s in media.spans(data[:-1]) if s[1] == 0 and s[2] >= len(data)] == []
    together = b"x".join(files.values())
    assert [s[0] for s in media.spans(together)] == list(files)
    assert [s[0] for s in media.spans(media.wav(png()))] == ["audio/wav"]  # a file inside another is not listed
    broken = bytearray(png())
    broken[30] ^= 1
    assert media.spans(bytes(broken)) == []


def test_declared_types_are_corrected(spark):
    rows = [(1, bytearray(png()), "audio/wav"), (2, bytearray(b"plain text"), "text/plain"), (3, None, "image/gif"), (4, bytearray(b"head" + GIF), None), (5, bytearray(b""), "x"), (6, bytearray(GIF), "image/gif")]
    df = spark.createDataFrame(rows, "k int, media binary, declared_type string")
    got = {r["k"]: r for r in media.sniffed(df).collect()}
    assert [got[k]["actual_type"] for k in range(1, 7)] == ["image/png", "text/plain", None, None, "x", "image/gif"]
    assert [got[k]["corrected"] for k in (1, 2, 6)] == [True, False, False]
    assert got[4]["spans"][0]["type"] == "image/gif" and got[4]["spans"][0]["offset"] == 4
    assert media.sniffed(df.limit(0)).count() == 0


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        stored = media.wav(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(raw), len(payload), len(stored)) and len(payload) % 192 == 0 < len(payload)
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["media_sha256"] == hashlib.sha256(stored).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-16:]) and r["media_type"] == "audio/wav" and r["type_corrected"]


def test_odd_rows(spark, odd_docs, no_docs):
    rows = media.digests(media.sniffed(media.stored(odd_docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])))).collect()
    check(rows, {r["doc_id"]: r["text"] for r in odd_docs.where("doc_id IS NOT NULL").collect()})
    assert len({r["feature"] for r in rows if r["doc_id"] in (1, 5)}) == 1
    assert media.digests(media.sniffed(media.stored(odd_docs))).count() == odd_docs.count()
    assert media.digests(media.sniffed(media.stored(no_docs))).count() == 0


def test_query_over_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    check(queries.op7_media(spark, sf).collect(), {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()})


def test_files_that_nothing_fits_and_other_columns(spark):
    rows = [(1, 5, "text/plain", b"hello", "x", True, 7), (2, 0, "audio/wav", None, "x", False, 8), (3, 3, "audio/wav", media.wav(b"abc"), "x", False, 9)]
    df = spark.createDataFrame(rows, "doc_id long, n_bytes long, declared_type string, media binary, actual_type string, corrected boolean, spans int")
    got = {r["doc_id"]: r for r in media.digests(media.sniffed(df)).collect()}
    assert (got[1]["payload_bytes"], got[1]["media_bytes"], got[1]["media_type"]) == (None, 5, "text/plain")
    assert got[2]["media_sha256"] is None and got[3]["payload_bytes"] == 3 and got[3]["media_type"] == "audio/wav"


def test_chains_that_fail_are_walked_once():
    """Files of many pages or boxes that end without their last one: each page is a beginning, and none is walked again."""
    import time

    page = b"OggS\0\0" + bytes(20) + b"\x01\x10" + bytes(16)
    box = b"\0\0\0\x10ftypisom" + bytes(4)
    began = time.time()
    assert media.spans(page * 50_000) == [] and media.spans(box * 100_000) == []
    assert time.time() - began < 5
    last = b"OggS\0\4" + bytes(20) + b"\x01\x10" + bytes(16)
    data = page * 3 + b"gap" + page * 2 + last + box * 2 + b"\0\0\0\x0amdatxy" + box
    found = media.spans(data)
    assert [(k, a, n) for k, a, n, _, _ in found] == [("audio/ogg", 3 * len(page) + 3, 2 * len(page) + len(last)), ("video/mp4", 5 * len(page) + 3 + len(last), 3 * len(box) + 10)]
