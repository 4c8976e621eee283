"""Hand-declared types of events, snapshots and tables. An optional field is a nullable one; an empty string isn't null."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D, B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


MUSIC = _struct(title=S, artist=S, album=S, coverHash=S, ts=L)
SYSTEM = _struct(batteryPct=D, charging=B, cpuPct=D, memoryPct=D, ts=L)
ACTIVITY = _struct(label=S, ts=L)
EVENT = _struct(version=S, system=SYSTEM, music=MUSIC, activity=ACTIVITY, idempotencyKey=S)
EVENT_BATCH = _struct(events=T.ArrayType(EVENT))
SNAPSHOT = _struct(system=SYSTEM, music=MUSIC, activity=ACTIVITY, lastUpdateTs=L)
SETTINGS = _struct(publicEnabled=B, authorizedMusicStats=B)
TOP_ITEM = _struct(name=S, count=L)
SUMMARY = _struct(plays=L, uniqueTracks=L)
BASE = _struct(code=T.IntegerType(), message=S, warnings=T.ArrayType(S))

USERS = _struct(id=L, open_id=S, secret_key=T.BinaryType(), sharing_key=S, status=T.ShortType(), created_at=T.TimestampNTZType(), updated_at=T.TimestampNTZType())
USER_SETTINGS = _struct(user_id=L, settings=SETTINGS, updated_at=T.TimestampNTZType())
CURRENT_STATE = _struct(user_id=L, snapshot=SNAPSHOT, updated_at=T.TimestampNTZType())
STATE_HISTORY = _struct(id=L, user_id=L, recorded_at=T.TimestampNTZType(), snapshot=SNAPSHOT)
COVER_ASSETS = _struct(cover_hash=S, asset=_struct(b64=S, contentType=S, size=L, uploadTime=L, storageType=S), created_at=T.TimestampNTZType())
MEDIA = _struct(title=S, artist=S, album=S, duration=D, elapsedTime=D, playing=B, bundleIdentifier=S, playbackRate=D, artworkMimeType=S, artworkData=S)
MEDIA_LINE = _struct(type=S, diff=B, payload=MEDIA)
LEGACY = _struct(key=S, type=S, musicData=_struct(title=S, artist=S, album=S))
