import hashlib
import struct
import zlib

import pytest

from quillstream.llm import media


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1024, 2048, 2049, 64 * 33, 100_000])
def test_payload_comes_back(n):
    data = bytes(i * 7 % 251 for i in range(n))
    payload = media.pad(data)
    assert len(payload) % 64 == 0 and len(payload) >= max(64, n) and payload[:n] == data and not payload[n:].strip(b"\0")
    stored = media.store(payload)
    info = media.inspect(stored)
    assert info["error"] is None and info["codec"] == "raw " and info["duration"] == len(payload)
    assert media.sample_bytes(stored, info) == payload
    # every sixteenth sample of 64 bytes is a keyframe, and its range is where its bytes are
    for k, (at, size) in enumerate(zip(info["key_offsets"], info["key_sizes"], strict=True)):
        assert stored[at : at + size] == payload[k * 1024 : k * 1024 + 64]


def test_a_padded_multiple_gets_no_more():
    assert media.pad(b"x" * 64) == b"x" * 64


def full(kind, *parts):
    return media.full_box(kind, *parts)


def film(stsz, stsc, stco, stss=b"", extra=b"", mdhd=None):
    entry = media.box(b"avc1", bytes(70))
    mdhd = mdhd or full(b"mdhd", struct.pack(">IIIII", 0, 0, 1000, 5000, 0))
    tables = media.box(b"stbl", full(b"stsd", struct.pack(">I", 1), entry), stsz, stsc, stco, stss)
    return media.box(b"moov", extra, media.box(b"trak", media.box(b"mdia", mdhd, full(b"hdlr", bytes(4), b"vide"), media.box(b"minf", tables))))


def test_uneven_samples_and_chunks():
    body = bytes(range(100))
    mdat = media.box(b"mdat", body)
    sizes = [3, 5, 7, 11, 13]
    stsz = full(b"stsz", struct.pack(">II5I", 0, 5, *sizes))
    stsc = full(b"stsc", struct.pack(">I6I", 2, 1, 2, 1, 3, 1, 1))  # two samples in each of two chunks, then one
    stco = full(b"co64", struct.pack(">I3Q", 3, 8, 38, 68))
    stss = full(b"stss", struct.pack(">I2I", 2, 1, 4))
    info = media.inspect(mdat + film(stsz, stsc, stco, stss))
    assert info["offsets"].tolist() == [8, 11, 38, 45, 68] and info["key_offsets"].tolist() == [8, 45] and info["key_sizes"].tolist() == [3, 11]
    assert (info["codec"], info["handler"], info["seconds"]) == ("avc1", "vide", 5.0)


def test_wide_boxes_compact_sizes_and_version_1():
    mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + 10) + bytes(10)
    stsz = full(b"stz2", struct.pack(">II", 4, 3), bytes([0x23, 0x40]))
    stsc = full(b"stsc", struct.pack(">4I", 1, 1, 3, 1))
    stco = full(b"stco", struct.pack(">2I", 1, 16))
    mdhd = media.box(b"mdhd", b"\1\0\0\0", struct.pack(">QQIQ", 0, 0, 90000, 1 << 33), bytes(4))
    info = media.inspect(mdat + film(stsz, stsc, stco, mdhd=mdhd, extra=media.box(b"free", bytes(5))))
    assert info["sizes"].tolist() == [2, 3, 4] and info["keyframes"] == 3 and info["duration"] == 1 << 33


#: Two samples of 2 bytes, the second one a keyframe; every number is put down by hand.
FILM = """
    00000010 66747970 69736f6d 00000200  0000000c 6d646174 41424344
    000000f8 6d6f6f76 000000f0 7472616b 00000018 746b6864 00000000 00000000 00000000 00000001
    000000d0 6d646961 0000001c 6d646864 00000000 00000000 00000000 000003e8 000007d0
    00000014 68646c72 00000000 00000000 76696465
    00000098 6d696e66 00000090 7374626c
    00000018 73747364 00000000 00000001 00000008 6d703476
    00000018 73747473 00000000 00000001 00000002 000003e8
    0000001c 73747363 00000000 00000001 00000001 00000002 00000001
    00000014 7374737a 00000000 00000002 00000002
    00000014 7374636f 00000000 00000001 00000018
    00000014 73747373 00000000 00000001 00000002
"""
#: A fragment of two samples of 3 bytes, the first one a keyframe, that last 10 and 11.
FRAGMENT = """
    00000058 6d6f6f66 00000010 6d666864 00000000 00000001
    00000040 74726166 00000018 74666864 00020030 00000001 00000003 00010000
    00000020 7472756e 00000105 00000002 00000060 00000000 0000000a 0000000b
    0000000e 6d646174 61626364 6566
"""


def plain(info):
    return {k: info[k] for k in ("codec", "handler", "timescale", "duration", "seconds", "samples", "keyframes")}


def test_a_file_put_down_by_hand():
    data = bytes.fromhex(FILM)
    info = media.inspect(data)
    assert info["error"] is None and plain(info) == {"codec": "mp4v", "handler": "vide", "timescale": 1000, "duration": 2000, "seconds": 2.0, "samples": 2, "keyframes": 1}
    assert info["offsets"].tolist() == [24, 26] and info["key_offsets"].tolist() == [26] and info["key_sizes"].tolist() == [2]
    assert media.sample_bytes(data, info) == b"ABCD"


def test_fragments():
    data = bytes.fromhex(FILM + FRAGMENT)
    info = media.inspect(data)
    assert info["error"] is None and plain(info) == {"codec": "mp4v", "handler": "vide", "timescale": 1000, "duration": 2021, "seconds": 2.021, "samples": 4, "keyframes": 2}
    assert info["offsets"].tolist() == [24, 26, 372, 375] and info["key_offsets"].tolist() == [26, 372] and info["key_sizes"].tolist() == [2, 3]
    assert media.sample_bytes(data, info) == b"ABCDabcdef"
    assert media.inspect(data[:-1])["error"] and media.inspect(bytes.fromhex(FILM) + bytes.fromhex(FRAGMENT).replace(b"tfhd", b"free"))["error"]


def test_fragments_with_defaults_of_the_movie():
    """Sizes and flags in trex and in the run itself; the second run goes on where the first ends."""
    trex = full(b"trex", struct.pack(">5I", 1, 1, 7, 4, 0x10000))
    moov = media.box(b"moov", media.box(b"mvex", trex), media.box(b"trak", full(b"tkhd", struct.pack(">3I", 0, 0, 1)), media.box(b"mdia", full(b"mdhd", struct.pack(">4I", 0, 0, 10, 0)))))
    tfhd = media.box(b"tfhd", struct.pack(">II", 0, 1))
    size = 8 + 8 + len(tfhd) + 20 + 28
    one = media.box(b"trun", struct.pack(">IIi", 1, 2, size + 8))
    two = media.box(b"trun", struct.pack(">II", 0x600, 1), struct.pack(">II", 9, 0))
    moof = media.box(b"moof", media.box(b"traf", tfhd, one, two))
    assert len(one) == 20 and len(two) == 24
    data = moov + moof + media.box(b"mdat", bytes(40))
    start = len(moov) + size + 8
    info = media.inspect(data)
    assert info["offsets"].tolist() == [start, start + 4, start + 8] and info["sizes"].tolist() == [4, 4, 9] and info["key_offsets"].tolist() == [start + 8] and info["duration"] == 21


def test_every_track_is_reported(spark):
    picture = film(full(b"stsz", struct.pack(">II", 4, 2)), full(b"stsc", struct.pack(">4I", 1, 1, 2, 1)), full(b"stco", struct.pack(">2I", 1, 8)), full(b"stss", struct.pack(">2I", 1, 1)))
    sound = film(full(b"stsz", struct.pack(">II", 1, 3)), full(b"stsc", struct.pack(">4I", 1, 1, 3, 1)), full(b"stco", struct.pack(">2I", 1, 16))).replace(b"vide", b"soun").replace(b"avc1", b"mp4a")
    data = media.box(b"mdat", bytes(20)) + media.box(b"moov", picture[8:], sound[8:])
    info = media.inspect(data)
    assert [(t["codec"], t["handler"], t["samples"], t["keyframes"]) for t in info["tracks"]] == [("avc1", "vide", 2, 1), ("mp4a", "soun", 3, 3)] and info["codec"] == "avc1"
    row = media.media_columns(spark.createDataFrame([(bytearray(data),)], "media binary")).first().media_info
    assert [t.codec for t in row.tracks] == ["avc1", "mp4a"] and [x.offset for x in row.tracks[1].keyframe_ranges] == [16, 17, 18]


@pytest.mark.parametrize("version", [b"", bytes(4)])
def test_metadata_with_and_without_a_version(version):
    """QuickTime's meta box has none; its handler isn't the track's."""
    meta = media.box(b"meta", version, full(b"hdlr", bytes(4), b"mdta"))
    data = bytes.fromhex(FILM)
    data = data[:28] + struct.pack(">I", 248 + len(meta)) + b"moov" + struct.pack(">I", 240 + len(meta)) + b"trak" + meta + data[44:]
    info = media.inspect(data)
    assert info["error"] is None and info["handler"] == "vide"


@pytest.mark.parametrize("data", [b"", b"abc", b"hello world, no boxes here", media.store(media.pad(b"x"))[:-9], media.box(b"moov"), film(full(b"stsz", struct.pack(">II", 900, 4)), full(b"stsc", struct.pack(">4I", 1, 1, 4, 1)), full(b"stco", struct.pack(">2I", 1, 8))), media.box(b"moov", media.box(b"trak", full(b"stsz", struct.pack(">II", 1, 4_000_000_000))))])
def test_malformed_files_say_why(data):
    assert media.inspect(data)["error"]


def test_query_against_plain_python(spark, sf_dir, duck):
    from quillstream.llm.queries import op1_media_columns

    rows = {r.doc_id: r for r in op1_media_columns(spark, sf_dir).collect()}
    texts = duck.execute("select doc_id, text from documents").fetchall()
    assert len(rows) == len(texts)
    for i, text in texts:
        payload = media.pad(text.encode())
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_sha256 == hashlib.sha256(media.store(payload)).hexdigest() and r.media_bytes > r.payload_bytes


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, "m"), (2, "", "m"), (3, "a", "m"), (3, "a", "m"), (None, "é" * 500_000, None)], "doc_id long, text string, media string")
    rows = media.media_digests(df).collect()
    assert [r.n_bytes for r in rows] == [0, 0, 1, 1, 1_000_000] and rows[0].media_sha256 == rows[1].media_sha256 and rows[2].feature == rows[3].feature
    assert media.media_digests(df.limit(0)).count() == 0
    files = spark.createDataFrame([(bytearray(media.store(media.pad(b"x"))), "x"), (bytearray(b"junk"), "y"), (None, "z")], "media binary, media_info string")
    out = media.media_columns(files).collect()
    assert [r.media_info.codec for r in out] == ["raw ", None, None] and out[1].media_info.error and out[0].media_info.keyframe_ranges[0].length == 64
