"""What stays: retention and deletion rules (CLN1 to CLN4, SNK3, SNK4, SNK7, AGG7, AGG8). All return the rows kept."""

from __future__ import annotations

from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import covers as media
from .state import first_in_time
from .windows import DEFAULT_ZONE, ntz


def _not_before(column: str, time: datetime) -> Column:
    """What a deletion of rows before `time` leaves; one without a time isn't before it."""
    return F.col(column).isNull() | (F.col(column) >= ntz(time))


def keep_current(current: DataFrame, now: datetime) -> DataFrame:
    """States updated within the last 24 hours."""
    return current.where(_not_before("updated_at", now - timedelta(hours=24)))


def keep_history(history: DataFrame, year: int, tz: str = DEFAULT_ZONE) -> DataFrame:
    """History without the calendar year before `year` in the zone; older years and rows without a time stay."""
    first, end = (datetime(y, 1, 1, tzinfo=ZoneInfo(tz)) for y in (year - 1, year))
    return history.where((F.col("recorded_at") < ntz(first)) | _not_before("recorded_at", end))


def keep_covers(covers: DataFrame, cutoff: datetime, accesses: DataFrame | None = None) -> DataFrame:
    """Covers that aren't unused. accesses: (cover_hash, last_access), the time as text; where that can be read (RFC 3339)
    it decides, else, as for Unix seconds, which record_access() writes, the time of creation."""
    if accesses is None:
        return covers.where(_not_before("created_at", cutoff))
    last = accesses.groupBy("cover_hash").agg(F.max("last_access").alias("_last"))
    written = F.when(F.col("_last").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d([.]\d+)?(Z|[+-]\d\d:\d\d)$"), F.col("_last"))
    used = F.to_utc_timestamp(F.try_to_timestamp(written), F.current_timezone()).cast("timestamp_ntz")
    both = covers.join(last, "cover_hash", "left").withColumn("_used", F.coalesce(used, F.col("created_at")))
    return both.where(_not_before("_used", cutoff)).drop("_last", "_used")


def record_access(hashes: DataFrame, covers: DataFrame, cached: DataFrame, now: datetime) -> DataFrame:
    """(cover_hash, last_access) that reading the asked hashes writes: of stored covers that aren't cached, Unix seconds."""
    read = hashes.select("cover_hash").distinct().join(covers.select("cover_hash"), "cover_hash", "left_semi")
    return read.join(cached.select("cover_hash"), "cover_hash", "left_anti").withColumn("last_access", F.lit(str(int(now.timestamp()))))


def keep_authorized_history(history: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """History without that of users whose permission to count (user_id, authorizedMusicStats) was taken back."""
    was = before.where("authorizedMusicStats").select("user_id")
    now = after.where("authorizedMusicStats").select("user_id")
    return history.join(was.join(now, "user_id", "left_anti"), "user_id", "left_anti")


def updated_settings(settings: DataFrame, commands: DataFrame) -> DataFrame:
    """settings after the last valid `public` and `stat` command of each user (user_id, seq, action, value).

    A user without settings gets them, false unless commanded otherwise.
    """
    last = lambda action: F.max_by(F.col("value") == "on", F.when(F.col("action") == action, F.col("seq")))
    new = commands.where(F.col("action").isin("public", "stat")).groupBy("user_id").agg(last("public").alias("p"), last("stat").alias("s"))
    both = settings.join(new, "user_id", "full")
    return both.select("user_id", F.coalesce("p", "publicEnabled", F.lit(False)).alias("publicEnabled"), F.coalesce("s", "authorizedMusicStats", F.lit(False)).alias("authorizedMusicStats"))


def insert_covers(existing: DataFrame, uploads: DataFrame) -> DataFrame:
    """uploads (doc_id, data) that aren't stored yet: cover_hash, size, first_id. The first upload of a hash counts."""
    hashed = uploads.select(media.content_hash(F.col("data")).alias("cover_hash"), F.octet_length("data").alias("size"), "doc_id")
    new = hashed.groupBy("cover_hash").agg(F.min("doc_id").alias("first_id"), F.first("size").cast("long").alias("size"))
    return new.join(existing.select("cover_hash"), "cover_hash", "left_anti")


def delete_covers(covers: DataFrame, hashes: DataFrame) -> DataFrame:
    """Covers without the given ones (cover_hash)."""
    return covers.join(hashes.select("cover_hash"), "cover_hash", "left_anti")


def missing_covers(covers: DataFrame, hashes: DataFrame) -> DataFrame:
    """Hashes to delete that aren't stored: each is an error."""
    return hashes.select("cover_hash").join(covers.select("cover_hash"), "cover_hash", "left_anti")


def cover_totals(covers: DataFrame, now: datetime) -> DataFrame:
    """(total, recent): all covers and those of the last 24 hours."""
    return covers.agg(F.count("*").alias("total"), F.count_if(F.col("created_at") > ntz(now - timedelta(hours=24))).alias("recent"))


def exists(hashes: DataFrame, covers: DataFrame) -> DataFrame:
    """hashes (cover_hash) with `found`."""
    known = covers.select("cover_hash").distinct().withColumn("known", F.lit(True))
    return hashes.join(known, "cover_hash", "left").withColumn("found", F.coalesce("known", F.lit(False))).drop("known")


def new_user(open_id: Column) -> list[Column]:
    """Columns of a new user: random keys, public, not counted (SNK6)."""
    return [open_id.alias("open_id"), new_key("secret_key").alias("secret_key"), new_key("sharing_key").alias("sharing_key"), F.lit(1).cast("short").alias("status"), F.lit(True).alias("publicEnabled"), F.lit(False).alias("authorizedMusicStats")]


def new_key(column: str) -> Column:
    """A random key: secret ones are longer."""
    return F.sha2(F.uuid(), 256) if column == "secret_key" else F.replace(F.uuid(), F.lit("-"))


def rotated(users: DataFrame, column: str) -> DataFrame:
    """users with a fresh random key in `column` (SNK8)."""
    return users.withColumn(column, new_key(column))


#: For how many seconds the answers of two kinds of request are kept.
CACHED_SECONDS = {"exists": 300, "asset": 3600}


def cached_covers(requests: DataFrame, covers: DataFrame) -> DataFrame:
    """requests (request_id, kind, cover_hash, at_ms) with `found` and `cached`: whether an answer that is still
    kept spares the store (CCH2). Only covers that are found are kept, for CACHED_SECONDS by kind."""
    asked = requests.join(covers.select("cover_hash").distinct().withColumn("found", F.lit(True)), "cover_hash", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    seconds = F.when(F.col("kind") == "exists", CACHED_SECONDS["exists"]).otherwise(CACHED_SECONDS["asset"])
    first = first_in_time(asked.withColumn("_ttl_ms", seconds * 1000), ("kind", "cover_hash"), "at_ms", "request_id", "_ttl_ms", "_read", F.col("found"))
    return first.withColumn("cached", ~F.col("_read")).drop("_ttl_ms", "_read")


def stored_covers(hashes: DataFrame, covers: DataFrame) -> DataFrame:
    """hashes (cover_hash) with the stored cover's columns; `code` is 404 where there is none (SRC5)."""
    known = covers.withColumn("_known", F.lit(True))
    return hashes.join(known, "cover_hash", "left").withColumn("code", F.when(F.col("_known"), 0).otherwise(404)).drop("_known")
