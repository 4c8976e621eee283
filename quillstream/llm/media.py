"""Media columns for ISO base media files (operator 1).

`store` writes bytes into a small ISO media file; `inspect` walks the nested boxes of any such
file, decodes the sample tables of every track (and the runs of movie fragments) and reports codec, duration and the byte
ranges of the sync samples (keyframes). The payload is never decoded; `sample_bytes` copies it out by byte range.

Defined results: a null file gives a null row; bytes that are no ISO media file, or whose tables contradict each other,
give the reason in `error` and nulls elsewhere; a file without stss has only sync samples; a file is reported by its
first track with samples, and all tracks are in `tracks`. Files of any length are read whole; null texts count as empty,
repeated rows stay, an empty table gives an empty result, columns of any name pass through media_columns (one named
like its result is replaced) and are ignored by the query.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, whole_text

UNIT = 64  # bytes of one stored sample
GOP = 16  # every 16th sample is a sync sample
PER_CHUNK = 32  # samples of a chunk
TIMESCALE = 8000

#: Boxes that hold boxes, and the bytes before the first child where there are any.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"edts": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0, b"dinf": 0, b"meta": 4}
#: Flags of a fragment's headers, and the bit of a sample's flags that says it isn't a sync sample.
BASE_OFFSET, HAS_DESCRIPTION, HAS_DURATION, HAS_SIZE, HAS_FLAGS, BASE_IS_MOOF = 1, 2, 8, 16, 32, 0x20000
RUN_OFFSET, FIRST_FLAGS, RUN_DURATION, RUN_SIZE, RUN_FLAGS, RUN_TIME = 1, 4, 0x100, 0x200, 0x400, 0x800
NOT_SYNC = 0x10000

TRACK = "codec string, handler string, timescale long, duration long, seconds double, samples long, keyframes long, keyframe_ranges array<struct<offset:long,length:long>>"
INFO = f"{TRACK}, error string, tracks array<struct<{TRACK.replace(' ', ':').replace(',:', ',')}>>"


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full_box(kind: bytes, *parts: bytes) -> bytes:
    return box(kind, b"\0\0\0\0", *parts)


def pad(data: bytes) -> bytes:
    """data and zero bytes up to a positive multiple of UNIT."""
    return data + bytes(UNIT - len(data) % UNIT if len(data) % UNIT or not data else 0)


def store(payload: bytes) -> bytes:
    """An ISO media file with one track of 8-bit samples; payload is a multiple of UNIT long."""
    n = len(payload) // UNIT
    duration = n * UNIT
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")
    first = len(head) + 8
    chunks = -(-n // PER_CHUNK)
    last = n - (chunks - 1) * PER_CHUNK
    runs = [(1, PER_CHUNK, 1)] if last == PER_CHUNK else [(1, PER_CHUNK, 1), (chunks, last, 1)] if chunks > 1 else [(1, last, 1)]
    offsets = first + np.arange(chunks, dtype=np.int64) * PER_CHUNK * UNIT
    wide = first + len(payload) >= 1 << 32
    sync = np.arange(1, n + 1, GOP)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))
    tables = box(
        b"stbl",
        full_box(b"stsd", struct.pack(">I", 1), entry),
        full_box(b"stts", struct.pack(">III", 1, n, UNIT)),
        full_box(b"stss", struct.pack(">I", len(sync)), sync.astype(">u4").tobytes()),
        full_box(b"stsc", struct.pack(">I", len(runs)), np.array(runs, ">u4").tobytes()),
        full_box(b"stsz", struct.pack(">II", UNIT, n)),
        full_box(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
    )
    media = box(
        b"mdia",
        full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, duration & 0xFFFFFFFF, 0x55C4, 0)),
        full_box(b"hdlr", bytes(4), b"soun", bytes(13)),
        box(b"minf", full_box(b"smhd", bytes(4)), box(b"dinf", full_box(b"dref", struct.pack(">I", 1), struct.pack(">I4sI", 12, b"url ", 1))), tables),
    )
    moov = box(b"moov", full_box(b"mvhd", struct.pack(">IIII", 0, 0, TIMESCALE, duration & 0xFFFFFFFF), bytes(80)), box(b"trak", full_box(b"tkhd", bytes(80)), media))
    if len(payload) + 8 >= 1 << 32:
        raise ValueError("a payload of 4 GB or more needs a wide mdat")
    return b"".join((head, struct.pack(">I4s", len(payload) + 8, b"mdat"), payload, moov))


def walk(data: bytes, start: int = 0, end: int | None = None, depth: int = 0):
    """(depth, kind, body start, body end) of every box, containers before their children."""
    end = len(data) if end is None else end
    if depth > 16:
        raise ValueError("boxes are nested too deep")
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} at {start} has a bad size")
        yield depth, kind, body, start + size
        if kind in CONTAINERS:
            # QuickTime's meta box has no version: its first child starts at once.
            skip = 0 if kind == b"meta" and data[body + 4 : body + 8] == b"hdlr" else CONTAINERS[kind]
            yield from walk(data, body + skip, start + size, depth + 1)
        start += size
    if start != end:
        raise ValueError("bytes left after the last box")


def _numbers(data: bytes, at: int, end: int, count: int, kind: str = ">u4") -> np.ndarray:
    if at + count * np.dtype(kind).itemsize > end:
        raise ValueError("a table is longer than its box")
    return np.frombuffer(data, kind, count, at).astype(np.int64)


def _track(data: bytes, kind: bytes, at: int, end: int, track: dict) -> None:
    """Decode one box of a track into track."""
    u4 = lambda where: struct.unpack_from(">I", data, where)[0]
    at4 = at + 4
    if kind == b"tkhd":
        track["id"] = u4(at4 + (16 if data[at] == 1 else 8))
    elif kind in (b"mdhd", b"mvhd"):
        version = data[at]
        track[kind] = struct.unpack_from(">IQ", data, at4 + 16) if version == 1 else struct.unpack_from(">II", data, at4 + 8)
    elif kind == b"hdlr":
        track.setdefault("handler", data[at4 + 4 : at4 + 8].decode("latin-1"))  # QuickTime has another one for the data
    elif kind == b"stsd" and u4(at4):
        track["codec"] = data[at4 + 8 : at4 + 12].decode("latin-1")
    elif kind == b"stts":
        track["stts"] = _numbers(data, at4 + 4, end, 2 * u4(at4)).reshape(-1, 2)
    elif kind == b"stss":
        track["stss"] = _numbers(data, at4 + 4, end, u4(at4))
    elif kind == b"stsc":
        track["stsc"] = _numbers(data, at4 + 4, end, 3 * u4(at4)).reshape(-1, 3)
    elif kind == b"stsz":
        one, n = u4(at4), u4(at4 + 4)
        if n > len(data):
            raise ValueError("more samples than bytes")
        track["sizes"] = np.broadcast_to(np.int64(one), n) if one else _numbers(data, at4 + 8, end, n)
    elif kind == b"stz2":
        bits, n = data[at4 + 3], u4(at4 + 4)
        if bits == 4:
            raw = np.frombuffer(data, np.uint8, (n + 1) // 2, at4 + 8)
            track["sizes"] = np.column_stack((raw >> 4, raw & 15)).ravel()[:n].astype(np.int64)
        else:
            track["sizes"] = _numbers(data, at4 + 8, end, n, ">u2" if bits == 16 else ">u1")
    elif kind in (b"stco", b"co64"):
        track["chunks"] = _numbers(data, at4 + 4, end, u4(at4), ">u8" if kind == b"co64" else ">u4")


def _layout(track: dict) -> tuple[np.ndarray, np.ndarray]:
    """Offset and size of each sample of a track, from its chunk and size tables."""
    sizes, chunks, runs = (track.get(k) for k in ("sizes", "chunks", "stsc"))
    if sizes is None or not len(sizes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if chunks is None or runs is None or not len(runs):
        raise ValueError("a sample table is missing")
    first = np.append(runs[:, 0] - 1, len(chunks))
    per_chunk = np.repeat(runs[:, 1], np.clip(np.diff(first), 0, len(chunks)))[: len(chunks)]
    chunk_of = np.repeat(np.arange(len(per_chunk)), per_chunk)[: len(sizes)]
    if len(chunk_of) < len(sizes):
        raise ValueError("the chunks hold too few samples")
    before = np.cumsum(sizes) - sizes
    starts = np.searchsorted(chunk_of, np.arange(len(per_chunk)))
    return chunks[chunk_of] + before - before[np.minimum(starts, len(sizes) - 1)][chunk_of], np.asarray(sizes)


def _fragment_head(data: bytes, at: int, moof: int, end_before: int, defaults: dict[int, dict]) -> dict:
    """What a tfhd box says: track, where its data begin, and defaults."""
    flags, track = int.from_bytes(data[at + 1 : at + 4]), struct.unpack_from(">I", data, at + 4)[0]
    out = {"track": track, **defaults.get(track, {})}
    at += 8
    out["base"] = moof if flags & BASE_IS_MOOF else end_before
    if flags & BASE_OFFSET:
        (out["base"],) = struct.unpack_from(">Q", data, at)
        at += 8
    for flag, name in ((HAS_DESCRIPTION, "description"), (HAS_DURATION, "duration"), (HAS_SIZE, "size"), (HAS_FLAGS, "flags")):
        if flags & flag:
            (out[name],) = struct.unpack_from(">I", data, at)
            at += 4
    out["next"] = out["base"]
    return out


def _run(data: bytes, at: int, end: int, head: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Offsets, sizes and sync marks of a trun box, and its duration."""
    flags, n = int.from_bytes(data[at + 1 : at + 4]), struct.unpack_from(">I", data, at + 4)[0]
    at += 8
    first_flags, start = None, head["next"]
    if flags & RUN_OFFSET:
        start = head["base"] + struct.unpack_from(">i", data, at)[0]
        at += 4
    if flags & FIRST_FLAGS:
        (first_flags,) = struct.unpack_from(">I", data, at)
        at += 4
    fields = [name for flag, name in ((RUN_DURATION, "duration"), (RUN_SIZE, "size"), (RUN_FLAGS, "flags"), (RUN_TIME, "time")) if flags & flag]
    if n > len(data):
        raise ValueError("more samples than bytes")
    table = _numbers(data, at, end, n * len(fields)).reshape(n, len(fields))
    column = lambda name: table[:, fields.index(name)] if name in fields else np.full(n, head.get(name, 0), np.int64)
    sizes, marks = column("size"), column("flags").copy()
    if n and first_flags is not None and "flags" not in fields:
        marks[0] = first_flags
    if n and "size" not in fields and "size" not in head:
        raise ValueError("a fragment's samples have no size")
    head["next"] = start + int(sizes.sum())
    return start + np.cumsum(sizes) - sizes, sizes, marks & NOT_SYNC == 0, int(column("duration").sum())


def _track_info(track: dict, movie: dict, length: int) -> dict:
    """What is reported of a track."""
    offsets, sizes = _layout(track)
    n = len(sizes)
    sync = track["stss"] - 1 if "stss" in track else np.arange(n)
    if len(sync) and (sync.min() < 0 or sync.max() >= n):
        raise ValueError("a sync sample doesn't exist")
    scale, duration = track.get(b"mdhd") or movie.get(b"mvhd") or (0, 0)
    if "stts" in track:
        duration = int((track["stts"][:, 0] * track["stts"][:, 1]).sum()) or duration
    for run_offsets, run_sizes, marks, lasts in track.get("runs", ()):
        sync = np.concatenate((sync, n + np.flatnonzero(marks)))
        offsets, sizes = np.concatenate((offsets, run_offsets)), np.concatenate((sizes, run_sizes))
        n, duration = len(sizes), duration + lasts
    if n and ((offsets + sizes).max() > length or offsets.min() < 0):
        raise ValueError("samples lie beyond the end of the file")
    return {"codec": track.get("codec"), "handler": track.get("handler"), "timescale": scale, "duration": duration, "seconds": duration / scale if scale else None, "samples": n, "keyframes": len(sync), "key_offsets": offsets[sync], "key_sizes": sizes[sync], "offsets": offsets, "sizes": sizes}


def inspect(data: bytes | None) -> dict | None:
    """Codec, duration, sample and keyframe byte ranges of the first track that has samples, and in `tracks` of each.

    Samples of movie fragments come after those of the track's own tables. A ValueError or a cut-off table is reported
    in `error`, all else then is null.
    """
    if data is None:
        return None
    try:
        tracks: list[dict] = []
        movie: dict = {}
        defaults: dict[int, dict] = {}
        moof, head, end_before, end_of_meta = 0, None, 0, 0
        for _, kind, at, end in walk(data):
            if kind == b"trak":
                tracks.append({})
            elif kind == b"mvhd":
                _track(data, kind, at, end, movie)
            elif kind == b"trex":
                track, _, duration, size, flags = struct.unpack_from(">5I", data, at + 4)
                defaults[track] = {"duration": duration, "size": size, "flags": flags} if size else {"duration": duration, "flags": flags}
            elif kind == b"moof":
                wide = data[at - 16 : at - 8] == b"\0\0\0\1moof"
                moof = end_before = at - (16 if wide else 8)
                head = None
            elif kind == b"meta":
                end_of_meta = end
            elif kind == b"traf":
                head = None
            elif kind == b"tfhd":
                head = _fragment_head(data, at, moof, end_before, defaults)
            elif kind == b"trun":
                if head is None:
                    raise ValueError("a run of samples has no track")
                own = next((t for t in tracks if t.get("id") == head["track"]), None)
                if own is None:
                    raise ValueError("a run of samples has no track")
                own.setdefault("runs", []).append(_run(data, at, end, head))
                end_before = head["next"]  # where the next track's data begin, if it doesn't say
            elif tracks and not (kind == b"hdlr" and at < end_of_meta):
                _track(data, kind, at, end, tracks[-1])
        if not tracks:
            raise ValueError("no track")
        found = [_track_info(t, movie, len(data)) for t in tracks]
        return next((t for t in found if t["samples"]), found[0]) | {"tracks": found, "error": None}
    except (ValueError, struct.error, IndexError) as e:
        return {"error": str(e) or "malformed"}


def sample_bytes(data: bytes, info: dict) -> bytes:
    """All samples of an inspected file in order; neighbours are copied as one range."""
    offsets, sizes = info["offsets"], info["sizes"]
    if not len(offsets):
        return b""
    ends = offsets + sizes
    cut = np.flatnonzero(offsets[1:] != ends[:-1]) + 1
    return b"".join(data[a:b] for a, b in zip(offsets[np.r_[0, cut]], ends[np.r_[cut - 1, len(ends) - 1]], strict=True))


def _ranges(x: dict) -> list[dict]:
    return [{"offset": int(a), "length": int(b)} for a, b in zip(x["key_offsets"], x["key_sizes"], strict=True)]


def _stored(text: pd.Series) -> pd.Series:
    return text.map(lambda x: store(pad(x.encode("utf-8"))))


NAMES = ("codec", "handler", "timescale", "duration", "seconds", "samples", "keyframes")


def _inspected(media: pd.Series) -> pd.DataFrame:
    whole = lambda x: {**{k: x.get(k) for k in NAMES}, "keyframe_ranges": None if "key_offsets" not in x else _ranges(x)}
    rows = []
    for x in map(inspect, media):
        x = x or {}
        rows.append({**whole(x), "error": x.get("error"), "tracks": [whole(t) for t in x["tracks"]] if x.get("tracks") else None})
    columns = [*NAMES, "keyframe_ranges", "error", "tracks"]
    return pd.DataFrame(rows, columns=columns).astype({k: "Int64" for k in ("timescale", "duration", "samples", "keyframes")})


DIGEST = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration long, keyframe_ranges array<struct<offset:long,length:long>>"


def _digest(media: pd.Series) -> pd.DataFrame:
    rows = []
    for data in media:
        info = inspect(data)
        payload = sample_bytes(data, info)
        ranges = np.column_stack((info["key_offsets"], info["key_sizes"])).astype(">i8").tobytes()
        tail = zlib.crc32(payload[-UNIT:])
        feature = f"{info['codec'].strip()}/{info['handler']} {info['duration']}@{info['timescale']} samples={info['samples']} keys={info['keyframes']} ranges={zlib.crc32(ranges):08x} mean={np.frombuffer(payload, np.uint8).mean():.4f}"
        rows.append((len(payload), hashlib.sha256(payload).hexdigest(), tail, len(data), hashlib.sha256(data).hexdigest(), feature, info["codec"], info["duration"], _ranges(info)))
    return pd.DataFrame(rows, columns=[x.split()[0] for x in DIGEST.split(", ")])


def stored_media(text: Column) -> Column:
    """The text's UTF-8 bytes, padded with zeros to a positive multiple of 64, as an ISO media file."""
    return F.pandas_udf(_stored, "binary")(text)


def media_columns(df: DataFrame, media: str = "media", out: str = "media_info") -> DataFrame:
    """df with a struct column `out` (see INFO) that describes the ISO media files in `media`.

    All other columns pass through; a column already named `out` is replaced. Null files give a
    struct of nulls, malformed files a struct whose only value is `error`.
    """
    bound_batches(df.sparkSession)
    return df.withColumn(out, F.pandas_udf(_inspected, INFO)(F.col(media)))


def media_digests(docs: DataFrame) -> DataFrame:
    """One row per document: its text stored as a media file, read back through the sample tables.

    Null texts count as empty, repeated rows stay, an empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    text = whole_text()
    x = F.pandas_udf(_digest, DIGEST)(stored_media(text))
    return docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), x.alias("x")).select("doc_id", "n_bytes", "x.*")
