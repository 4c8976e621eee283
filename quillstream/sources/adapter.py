"""Projects the supplied test tables into users, settings, events, covers and texts.

This mapping is our own invention, so that every operator has rows with nulls, ties and gaps to work on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-30 12:34:56"
NOW_MS = 1706618096000
#: Milliseconds between two arrivals on the compressed clock, on which equal keys come within 30 s.
ARRIVAL_STEP = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts: Column) -> Column:
    """Milliseconds of a timestamp without zone, read as UTC, whatever the session's zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def _name(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq (arrival order), arrival_ms, recorded_at, user_id, idempotency_key, k, music, system, activity."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp_ntz").alias("recorded_at"), "user_id", "event_type", k.alias("k"))
    k, kind, ms = F.col("k"), F.col("event_type"), epoch_ms(F.col("recorded_at"))
    music = F.struct(
        F.when(k % 11 != 0, _name("track-", k % 17)).alias("title"), F.when(k % 13 != 0, _name("artist-", k % 7)).alias("artist"),
        F.when(k % 5 != 0, _name("album-", k % 9)).alias("album"), F.lit(None).cast("string").alias("coverHash"), ms.alias("ts"),
    )
    system = F.struct(
        (k % 101 / 100).alias("batteryPct"), F.when(k % 10 != 0, k % 2 == 0).alias("charging"), F.when(k % 6 != 0, k * 7 % 100 / 100).alias("cpuPct"),
        (k * 3 % 100 / 100).alias("memoryPct"), F.when(k % 29 == 0, F.lit(0).cast("long")).otherwise(ms - k % 7 * 1000).alias("ts"),
    )
    activity = F.struct(_name("label-", k % 4).alias("label"), F.when(k % 31 == 0, F.lit(0).cast("long")).otherwise(ms + 500).alias("ts"))
    key = F.when(k % 19 == 0, F.lit(None)).when(k % 23 == 0, F.lit("")).otherwise(_name("key-", k % 3))
    return e.select(
        "seq", (F.col("seq") * ARRIVAL_STEP).alias("arrival_ms"), "recorded_at", "user_id", key.alias("idempotency_key"), "k",
        F.when(kind != "error", music).alias("music"), F.when(kind.isin("view", "click"), system).alias("system"), F.when(kind.isin("purchase", "signup"), activity).alias("activity"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, user_id, recorded_at, snapshot: every event as a history row."""
    return events(spark, sf_dir).select(F.col("seq").alias("id"), "user_id", "recorded_at", F.struct("system", "music", "activity", epoch_ms(F.col("recorded_at")).alias("lastUpdateTs")).alias("snapshot"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select("user_id").distinct().select(u.alias("id"), _name("open-", u).alias("open_id"), _name("secret-", u).alias("secret_key"), _name("share-", u).alias("sharing_key"), F.when(u % 17 == 0, 0).otherwise(1).cast("short").alias("status"))


def user_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each user but every seventh."""
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select("user_id").distinct().where(u % 7 != 0).select("user_id", (u % 5 != 0).alias("publicEnabled"), (u % 3 != 0).alias("authorizedMusicStats"))


def requests(spark: SparkSession, sf_dir: str, prefix: str) -> DataFrame:
    """request_id, key: one request for each event, some without a key or with an unknown one."""
    e = events(spark, sf_dir)
    return e.select(F.col("seq").alias("request_id"), F.when(F.col("k") % 10 == 0, "").when(F.col("k") % 10 == 1, prefix + "unknown").otherwise(_name(prefix, F.col("user_id"))).alias("key"))


def covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, data: the texts of documents as cover bytes."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))


#: The same events for DuckDB.
EVENTS_SQL = f"""
e0 as (select event_id as seq, event_id * {ARRIVAL_STEP} as arrival_ms, ts as recorded_at, user_id, event_type, cast(json_extract(props, '$.k') as int) as k, epoch_us(ts) // 1000 as ms from events),
ev as (select *,
  event_type <> 'error' as has_music, event_type in ('view', 'click') as has_system, event_type in ('purchase', 'signup') as has_activity,
  case when event_type <> 'error' and k % 11 <> 0 then 'track-' || (k % 17) end as title,
  case when event_type <> 'error' and k % 13 <> 0 then 'artist-' || (k % 7) end as artist,
  case when event_type <> 'error' and k % 5 <> 0 then 'album-' || (k % 9) end as album,
  case when event_type <> 'error' then ms end as music_ts,
  case when event_type in ('view', 'click') then (k % 101) / 100 end as battery,
  case when event_type in ('view', 'click') and k % 10 <> 0 then k % 2 = 0 end as charging,
  case when event_type in ('view', 'click') and k % 6 <> 0 then (k * 7 % 100) / 100 end as cpu,
  case when event_type in ('view', 'click') then (k * 3 % 100) / 100 end as memory,
  case when event_type in ('view', 'click') then case when k % 29 = 0 then 0 else ms - k % 7 * 1000 end end as system_ts,
  case when event_type in ('purchase', 'signup') then 'label-' || (k % 4) end as label,
  case when event_type in ('purchase', 'signup') then case when k % 31 = 0 then 0 else ms + 500 end end as activity_ts,
  case when k % 19 = 0 then null when k % 23 = 0 then '' else 'key-' || (k % 3) end as ikey
  from e0)"""
USERS_SQL = """
us as (select user_id as id, 'share-' || user_id as sharing_key, 'secret-' || user_id as secret_key, case when user_id % 17 = 0 then 0 else 1 end as status from (select distinct user_id from events)),
se as (select user_id, user_id % 5 <> 0 as public, user_id % 3 <> 0 as stats from (select distinct user_id from events) where user_id % 7 <> 0)"""
