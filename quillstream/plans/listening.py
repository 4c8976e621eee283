"""Statistics queries: time windows, plays, top lists."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import access, stats
from ..operators.windows import Window, WindowType, window, within
from ..sources import adapter as A
from .registry import query

NOW = datetime(2024, 1, 30, 12, 34, 56, tzinfo=UTC)
USER = 11
DST_NOW = datetime(2024, 3, 12, 15, 45, 30, tzinfo=UTC)
ZONES = ("Asia/Shanghai", "America/New_York", "Asia/Kolkata", "UTC", "Europe/Berlin")
CUSTOM = (1705744740000, 1705924740000)  # 2024-01-20 09:59 to 2024-01-22 11:59


def _sql_time(x: datetime) -> str:
    return f"timestamp '{x:%Y-%m-%d %H:%M:%S}'"


def counted_sql(w: Window, by: str = "", where: str = "true") -> str:
    """CTEs up to `counts` (by..., kind, name, n)."""
    key = f"{by}, " if by else ""
    rows = f"select * from ev where recorded_at >= {_sql_time(w.start)} and recorded_at <= {_sql_time(w.end)} and has_music and {where}"
    return f"""with {A.EVENTS_SQL}, {A.USERS_SQL}, rows_ as ({rows}),
names as (
  select {key}'track' as kind, title || ' - ' || artist as name from rows_
  union all select {key}'artist', artist from rows_
  union all select {key}'album', album || ' - ' || artist from rows_),
counts as (select {key}kind, name, count(*) as n from names where name is not null group by all)
"""


ROLLING_7D = window(WindowType.ROLLING_7D, NOW, "UTC")
ROLLING_3D = window(WindowType.ROLLING_3D, NOW, "UTC")
MONTH = window(WindowType.MONTH_TO_DATE, NOW, "")
YEAR = window(WindowType.YEAR_TO_DATE, NOW, "")
SPAN = window(WindowType.CUSTOM, NOW, "UTC", CUSTOM)


@query(f"""
with z as (select unnest({list(ZONES)}) as tz), l as (select tz, date_trunc('hour', timezone(tz, timestamptz '{DST_NOW:%Y-%m-%d %H:%M:%S}+00')) as h from z),
b as (
  select 1 as type, tz, h - interval 3 day as f, h as t from l union all select 2, tz, h - interval 7 day, h from l
  union all select 3, tz, date_trunc('month', h), h from l union all select 4, tz, date_trunc('year', h), h from l
  union all select 5, tz, date_trunc('hour', timezone(tz, to_timestamp({CUSTOM[0]} / 1000))), date_trunc('hour', timezone(tz, to_timestamp({CUSTOM[1]} / 1000))) from z)
select type, tz, cast(epoch_ms(timezone(tz, f)) as bigint) as from_ms, cast(epoch_ms(timezone(tz, t)) as bigint) as to_ms from b""")
def tw_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [(int(k), z, window(k, DST_NOW, z, CUSTOM)) for k in WindowType for z in ZONES]
    return spark.createDataFrame([(k, z, w.from_ms, w.to_ms) for k, z, w in found], "type int, tz string, from_ms long, to_ms long")


def _of_user(spark: SparkSession, sf_dir: str, w: Window) -> DataFrame:
    history = A.history(spark, sf_dir).where(F.col("user_id") == USER)
    return stats.counts(within(access.authorized(history, A.user_settings(spark, sf_dir)), w))


@query(counted_sql(ROLLING_7D, where=f"user_id = {USER} and user_id in (select user_id from se where stats)") + "select cast(coalesce(sum(n) filter (kind = 'track'), 0) as bigint) as plays, count(*) filter (kind = 'track') as unique_tracks from counts")
def stats_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.summary(_of_user(spark, sf_dir, ROLLING_7D))


def _top(name: str, kind: str, w: Window, n: int) -> None:
    sql = counted_sql(w, where=f"user_id = {USER} and user_id in (select user_id from se where stats)") + f"select name, n as count from counts where kind = '{kind}' order by n desc, name limit {stats.top_n(n)}"

    @query(sql, name)
    def of(spark: SparkSession, sf_dir: str) -> DataFrame:
        return stats.top_of(_of_user(spark, sf_dir, w), kind, n)


_top("stats_top_artists", stats.ARTIST, ROLLING_7D, 10)
_top("stats_top_tracks", stats.TRACK, ROLLING_7D, 5)
_top("stats_top_albums", stats.ALBUM, ROLLING_7D, 0)


def _windowed(name: str, w: Window, n: int | None) -> None:
    sql = counted_sql(w) + f"select kind, cast(row_number() over (partition by kind order by n desc, name) as int) as rank, name, n as count from counts qualify rank <= {stats.top_n(n)}"

    @query(sql, name)
    def of(spark: SparkSession, sf_dir: str) -> DataFrame:
        return stats.top(stats.counts(within(A.history(spark, sf_dir), w)), n)


_windowed("stats_3d", ROLLING_3D, 3)
_windowed("stats_mtd", MONTH, None)
_windowed("stats_ytd", YEAR, 50)
_windowed("stats_custom", SPAN, -1)


@query(counted_sql(ROLLING_7D, "user_id", "user_id in (select user_id from se where stats)") + "select user_id, kind, cast(row_number() over (partition by user_id, kind order by n desc, name) as int) as rank, name, n as count from counts qualify rank <= 5")
def stats_all_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = access.authorized(A.history(spark, sf_dir), A.user_settings(spark, sf_dir))
    return stats.top(stats.counts(within(history, ROLLING_7D), ("user_id",)), 5, ("user_id",))


@query(counted_sql(ROLLING_7D, "user_id", "user_id in (select user_id from se where stats)") + "select user_id, cast(coalesce(sum(n) filter (kind = 'track'), 0) as bigint) as plays, count(*) filter (kind = 'track') as unique_tracks from counts group by user_id")
def stats_all_users_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = access.authorized(A.history(spark, sf_dir), A.user_settings(spark, sf_dir))
    return stats.summary(stats.counts(within(history, ROLLING_7D), ("user_id",)), ("user_id",))


@query(counted_sql(ROLLING_7D, where=f"user_id = {USER}") + f"""
, r as (select kind, name, n, row_number() over (partition by kind order by n desc, name) as rank from counts qualify rank <= 3)
select cast(coalesce((select sum(n) from counts where kind = 'track'), 0) as bigint) as plays, (select count(*) from counts where kind = 'track') as unique_tracks,
  coalesce((select string_agg(name || '=' || n, ';' order by rank) from r where kind = 'artist'), '') as artists,
  coalesce((select string_agg(name || '=' || n, ';' order by rank) from r where kind = 'track'), '') as tracks,
  coalesce((select string_agg(name || '=' || n, ';' order by rank) from r where kind = 'album'), '') as albums,
  cast({ROLLING_7D.from_ms} as bigint) as from_ms, cast({ROLLING_7D.to_ms} as bigint) as to_ms, false as cached""")
def stats_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = A.history(spark, sf_dir).where(F.col("user_id") == USER)
    r = stats.response(stats.counts(within(history, ROLLING_7D)), 3, ROLLING_7D.from_ms, ROLLING_7D.to_ms)
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["name"], F.lit("="), x["count"].cast("string"))), ";")
    return r.select("plays", "unique_tracks", text("top_artists").alias("artists"), text("top_tracks").alias("tracks"), text("top_albums").alias("albums"), F.col("from_ms").cast("long"), F.col("to_ms").cast("long"), "cached")


_WINDOWS = {int(WindowType.ROLLING_3D): ROLLING_3D, int(WindowType.ROLLING_7D): ROLLING_7D, int(WindowType.MONTH_TO_DATE): MONTH, int(WindowType.YEAR_TO_DATE): YEAR}
_IN_WINDOWS = ", ".join(f"({k}, {_sql_time(w.start)}, {_sql_time(w.end)})" for k, w in _WINDOWS.items())


@query(f"""with {A.EVENTS_SQL}, wi(type, f, t) as (values {_IN_WINDOWS}), rows_ as (select type, title, artist, album from ev, wi where recorded_at >= f and recorded_at <= t and has_music),
names as (select type, 'track' as kind, title || ' - ' || artist as name from rows_ union all select type, 'artist', artist from rows_ union all select type, 'album', album || ' - ' || artist from rows_),
counts as (select type, kind, name, count(*) as c from names where name is not null group by all),
r as (select type, kind, name, c, cast(row_number() over (partition by type, kind order by c desc, name) as int) as rank from counts)
select type, n, kind, rank, name, c as count from r, (select unnest([3, 5, 10, 20]) as n) where rank <= n""")
def stats_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window that a user can choose by every length of list (TOP6)."""
    return stats.choices(A.history(spark, sf_dir), _WINDOWS)


_AT_MS = "arrival_ms * 200"


@query(f"""with recursive {A.EVENTS_SQL}, rq as (select seq, user_id, k % 3 as w, {_AT_MS} as at_ms, (3600 + (5 + user_id % 16) * 60) * 1000 as ttl from ev),
nx as (select a.user_id, a.w, a.at_ms, min(b.at_ms) as next_ms from rq a left join rq b on b.user_id = a.user_id and b.w = a.w and b.at_ms >= a.at_ms + a.ttl group by all),
chain as (select user_id, w, min(at_ms) as ms from rq group by all union all select c.user_id, c.w, nx.next_ms from chain c join nx on nx.user_id = c.user_id and nx.w = c.w and nx.at_ms = c.ms where nx.next_ms is not null)
select rq.seq as request_id, chain.ms is null as cached from rq left join chain on chain.user_id = rq.user_id and chain.w = rq.w and chain.ms = rq.at_ms""")
def stats_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each user for three windows: which are answered from the cache (CCH1)."""
    from ..functions import formatting

    e = A.events(spark, sf_dir)
    window_start = F.col("k") % 3
    key = F.concat(formatting.cache_key(F.col("user_id"), "UTC", 0, 1), F.lit(":"), window_start.cast("string"))
    r = e.select(F.col("seq").alias("request_id"), "user_id", key.alias("cache_key"), F.expr(_AT_MS).alias("at_ms"))
    return stats.cache_hits(r, formatting.cache_ttl_seconds(F.col("user_id"))).select("request_id", "cached")


@query(f"with {A.EVENTS_SQL} select seq as id, user_id, recorded_at from ev where user_id = {USER} and recorded_at >= {_sql_time(ROLLING_7D.start)} and recorded_at <= {_sql_time(ROLLING_7D.end)}")
def history_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return within(A.history(spark, sf_dir).where(F.col("user_id") == USER), ROLLING_7D).select("id", "user_id", "recorded_at")


@query(f"with {A.USERS_SQL} select id as user_id, 'stats:' || id || ':UTC:{ROLLING_7D.from_ms // 1000}:{ROLLING_7D.to_ms // 1000}' as key, 3600 + (5 + id % 16) * 60 as ttl_seconds from us")
def cache_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import formatting

    u = A.users(spark, sf_dir)
    return u.select(F.col("id").alias("user_id"), formatting.cache_key(F.col("id"), "UTC", ROLLING_7D.from_ms // 1000, ROLLING_7D.to_ms // 1000).alias("key"), formatting.cache_ttl_seconds(F.col("id")).alias("ttl_seconds"))
