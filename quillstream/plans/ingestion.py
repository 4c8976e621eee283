"""Ingestion, merged state, client rules and stateful folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..operators import access, client, folds, state
from ..sources import adapter as A
from ..sources import ingest
from .registry import query

_TS = "case when greatest(coalesce(system_ts, 0), coalesce(music_ts, 0), coalesce(activity_ts, 0)) = 0 then {now} else greatest(coalesce(system_ts, 0), coalesce(music_ts, 0), coalesce(activity_ts, 0)) end".format(now=A.NOW_MS)
_EV = f"{A.EVENTS_SQL}, en as (select *, {_TS} as last_ts from ev)"
_DEDUP = """
ke as (select user_id, ikey, arrival_ms, seq from ev where coalesce(ikey, '') <> ''),
nx as (select a.user_id, a.ikey, a.seq, a.arrival_ms, min(b.arrival_ms) as next_ms from ke a left join ke b on b.user_id = a.user_id and b.ikey = a.ikey and b.arrival_ms >= a.arrival_ms + 30000 group by all),
fi as (select user_id, ikey, min(arrival_ms) as ms from ke group by all),
chain as (select user_id, ikey, ms from fi union all select c.user_id, c.ikey, nx.next_ms from chain c join nx on nx.user_id = c.user_id and nx.ikey = c.ikey and nx.arrival_ms = c.ms where nx.next_ms is not null),
de as (select ev.*, coalesce(ev.ikey, '') = '' or chain.ms is not null as accepted from ev left join chain on chain.user_id = ev.user_id and chain.ikey = ev.ikey and chain.ms = ev.arrival_ms)"""
_MERGED = """mg as (select user_id, arg_max(battery, seq) filter (has_system) as battery_, max(seq) filter (has_system) as s_seq, max(seq) filter (has_music) as m_seq, max(seq) filter (has_activity) as a_seq, max(seq) as l_seq from en group by user_id),
cu as (select mg.user_id, m.seq is not null as has_music, m.title, m.artist, m.album, m.music_ts, s.seq is not null as has_system, s.battery, s.charging, s.cpu, s.memory, s.system_ts, a.seq is not null as has_activity, a.label, a.activity_ts, l.last_ts
  from mg left join en m on m.seq = m_seq left join en s on s.seq = s_seq left join en a on a.seq = a_seq join en l on l.seq = l_seq)"""
FLAT = "has_music, title, artist, album, battery, charging, cpu, memory, label, last_ts"


def flat(df: DataFrame, *keys: str) -> DataFrame:
    """A snapshot as plain columns."""
    s = lambda path: F.col(f"snapshot.{path}")
    return df.select(
        *keys, s("music").isNotNull().alias("has_music"), s("music.title"), s("music.artist"), s("music.album"), s("system.batteryPct").alias("battery"), s("system.charging"),
        s("system.cpuPct").alias("cpu"), s("system.memoryPct").alias("memory"), s("activity.label"), s("lastUpdateTs").alias("last_ts"),
    )


@query(f"with {_EV} select seq, last_ts from en")
def event_last_update_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.events(spark, sf_dir).select("seq", state.last_update_ts(A.NOW_MS).alias("last_ts"))


@query(f"with {_EV}, {_MERGED} select user_id, {FLAT} from cu")
def state_merge_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(state.merge_latest(A.events(spark, sf_dir), A.NOW_MS), "user_id")


@query(f"""with {_EV}, w as (select seq, user_id, last_ts, max(case when has_music then seq end) over o as m_seq, max(case when has_system then seq end) over o as s_seq, max(case when has_activity then seq end) over o as a_seq
  from en window o as (partition by user_id order by seq))
select w.user_id, w.seq, m.seq is not null as has_music, m.title, m.artist, m.album, s.battery, s.charging, s.cpu, s.memory, a.label, w.last_ts
from w left join en m on m.seq = m_seq left join en s on s.seq = s_seq left join en a on a.seq = a_seq""")
def state_merge_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(state.merge_trace(A.events(spark, sf_dir), A.NOW_MS), "user_id", "seq")


@query(f"with {_EV}, {_MERGED} select user_id, {FLAT} from cu")
def state_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of arrivals, one merged into the other's result: the same as one batch."""
    e = A.events(spark, sf_dir)
    middle = e.agg((F.max("seq") / 2).cast("long").alias("m")).first().m or 0
    first, second = (state.merge_latest(e.where(x), A.NOW_MS) for x in (F.col("seq") <= middle, F.col("seq") > middle))
    return flat(state.upserted(first, second), "user_id")


@query(f"with recursive {A.EVENTS_SQL}, {_DEDUP} select seq, user_id, accepted from de")
def ingest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.deduplicated(A.events(spark, sf_dir)).select("seq", "user_id", "accepted")


@query(f"with recursive {A.EVENTS_SQL}, {_DEDUP} select user_id, count(*) filter (accepted) as accepted, count(*) filter (not accepted) as deduped from de group by user_id")
def ingest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.counters(state.deduplicated(A.events(spark, sf_dir)), ("user_id",))


@query(f"with {_EV}, {A.USERS_SQL} select seq, user_id, recorded_at, {FLAT} from en where has_music and user_id in (select user_id from se where stats)")
def history_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(state.history_rows(A.events(spark, sf_dir), A.user_settings(spark, sf_dir), A.NOW_MS), "seq", "user_id", "recorded_at")


@query(f"with recursive {_EV.replace('with ', '')}, {_DEDUP.replace('select ev.*', 'select en.*').replace('from ev left join chain on chain.user_id = ev.user_id and chain.ikey = ev.ikey and chain.ms = ev.arrival_ms', 'from en left join chain on chain.user_id = en.user_id and chain.ikey = en.ikey and chain.ms = en.arrival_ms').replace('coalesce(ev.ikey', 'coalesce(en.ikey')}, {A.USERS_SQL} select seq, user_id, last_ts from de where accepted and has_music and user_id in (select user_id from se where stats)")
def ingest_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History rows of the accepted events."""
    _, _, rows = state.process(A.events(spark, sf_dir), A.user_settings(spark, sf_dir), A.NOW_MS)
    return rows.select("seq", "user_id", F.col("snapshot.lastUpdateTs").alias("last_ts"))


@query(f"with {_EV}, {_MERGED}, {A.USERS_SQL} select id as user_id, coalesce(has_music, false) as has_music, title, artist, album, battery, charging, cpu, memory, label, case when id % 6 = 0 then {A.NOW_MS} else last_ts end as last_ts from us left join se on se.user_id = id left join cu on cu.user_id = id and id % 6 <> 0 where status = 1 and coalesce(public, false)")
def state_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of public users; those whose state isn't stored have an empty one."""
    u = access.with_settings(A.users(spark, sf_dir), A.user_settings(spark, sf_dir)).where((F.col("status") == 1) & F.coalesce("publicEnabled", F.lit(False)))
    current = state.merge_latest(A.events(spark, sf_dir), A.NOW_MS).where(F.col("user_id") % 6 != 0)
    return flat(state.current_or_empty(u, current, A.NOW_MS).withColumn("user_id", F.col("id")), "user_id")


@query(f"with {A.EVENTS_SQL} select seq // 10 as batch_id, cast(seq % 10 as int) as place, user_id, title, label, ikey from ev")
def event_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events packed into JSON batches of up to ten and read again."""
    e = A.events(spark, sf_dir)
    item = F.struct("seq", F.lit("1").alias("version"), "system", "music", "activity", F.col("idempotency_key").alias("idempotencyKey"), "user_id")
    batches = e.groupBy(F.floor(F.col("seq") / 10).alias("batch_id")).agg(F.sort_array(F.collect_list(item)).alias("events"))
    users = F.transform("events", lambda x: x["user_id"])
    read = ingest.event_batches(batches.select(users.alias("user_id"), "batch_id", F.to_json(F.struct("events")).alias("body")))
    return read.select("batch_id", "place", F.get("user_id", F.col("place")).alias("user_id"), F.col("music.title").alias("title"), F.col("activity.label").alias("label"), F.col("idempotencyKey").alias("ikey"))


@query(f"with {A.EVENTS_SQL} select seq as report_id, 'secret-' || user_id as key, k % 3 = 0 as has_music, case when k % 3 = 0 then coalesce(title, '') end as title, case when k % 3 = 0 then coalesce(artist, '') end as artist from ev where k % 4 <> 1")
def legacy_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    data = F.when(k % 3 == 0, F.struct(F.col("music.title").alias("title"), F.col("music.artist").alias("artist")))
    body = F.to_json(F.struct(F.concat(F.lit("secret-"), F.col("user_id").cast("string")).alias("key"), F.when(k % 4 == 1, "system").otherwise("music").alias("type"), data.alias("musicData")))
    r = ingest.legacy_reports(A.events(spark, sf_dir).select(F.col("seq").alias("report_id"), body.alias("body")), A.NOW_MS)
    return r.select("report_id", "key", F.col("music").isNotNull().alias("has_music"), "music.title", "music.artist")


@query(f"with {A.EVENTS_SQL} select seq, k % 2 = 0 as diff, title from ev where k % 6 <> 1 and k % 6 <> 5")
def media_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    good = F.to_json(F.struct(F.lit("data").alias("type"), (k % 2 == 0).alias("diff"), F.struct(F.col("music.title").alias("title"), F.lit(1.0).alias("duration")).alias("payload")))
    line = F.when(k % 6 == 1, F.lit("  ")).when(k % 6 == 5, F.lit('{"type": "da')).otherwise(F.concat(F.lit("  "), good))
    lines = A.events(spark, sf_dir).select("seq", line.alias("value"))
    return ingest.media_lines(lines).select("seq", "diff", "payload.title")


@query(f"""with {A.EVENTS_SQL}, l as (select seq, user_id, title, artist, has_music, lag(has_music) over o as b, lag(title) over o as bt, lag(artist) over o as ba from ev window o as (partition by user_id order by seq))
select seq, has_music and not coalesce(b and title = bt and artist = ba, false) as reported from l""")
def song_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return client.song_reports(A.events(spark, sf_dir).select("user_id", "seq", "music")).select("seq", "reported")


@query(f"with {A.EVENTS_SQL}, l as (select seq, label, lag(label) over (partition by user_id order by seq) as b from ev where has_activity) select seq, label, b is null or b <> label as reported from l")
def label_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = A.events(spark, sf_dir).where("activity is not null").select("user_id", "seq", "activity.label")
    return client.label_reports(a).select("seq", "label", "reported")


@query(f"""with {A.EVENTS_SQL}, t as (select seq, user_id, seq * 2 + k % 3 as u, seq + k % 2 as s, cast(0 as bigint) as n, case when k % 9 = 0 then seq * 5 else seq * 7 end as i from ev),
d as (select seq, u - lag(u) over o + s - lag(s) over o + n - lag(n) over o as used, i - lag(i) over o as idle from t window o as (partition by user_id order by seq))
select seq, case when used + idle > 0 then used / (used + idle) end as cpu from d""")
def cpu_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("k"), F.col("seq")
    ticks = A.events(spark, sf_dir).select("user_id", "seq", (s * 2 + k % 3).alias("user_ticks"), (s + k % 2).alias("system_ticks"), F.lit(0).cast("long").alias("nice_ticks"), F.when(k % 9 == 0, s * 5).otherwise(s * 7).alias("idle_ticks"))
    return client.cpu_usage(ticks).select("seq", "cpu")


_BUNDLES = tuple(x for _, ids in client.ACTIVITY_GROUPS for x in ids[:2]) + ("com.example.none",)


@query("with {0}, g as (select unnest({1}) as bundle_id, unnest({2}) as label) select seq, {3}[k % {4} + 1] as bundle_id, coalesce(g.label, '其他') as label from ev left join g on bundle_id = {3}[k % {4} + 1]".format(A.EVENTS_SQL, [x for n, ids in client.ACTIVITY_GROUPS if n != "在终端" for x in ids], [n for n, ids in client.ACTIVITY_GROUPS if n != "在终端" for _ in ids], list(_BUNDLES), len(_BUNDLES)))
def activity_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.events(spark, sf_dir).select("seq", F.get(F.array(*map(F.lit, _BUNDLES)), F.col("k") % len(_BUNDLES)).alias("bundle_id"))
    return client.with_activity_label(e, client.group_table(spark, disabled=("在终端",)))


@query(f"with {A.EVENTS_SQL} select seq, coalesce(length(title) > 0 and length(artist) > 0, false) as valid, [null, 'com.apple.Music', 'com.example.x'][k % 3 + 1] is null or [null, 'com.apple.Music', 'com.example.x'][k % 3 + 1] = 'com.apple.Music' as allowed from ev")
def media_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    bundle = F.get(F.array(F.lit(None), F.lit("com.apple.Music"), F.lit("com.example.x")), F.col("k") % 3)
    return A.events(spark, sf_dir).select("seq", client.valid_media(F.col("music.title"), F.col("music.artist")).alias("valid"), client.allowed_player(bundle, ("com.apple.Music",)).alias("allowed"))


@query(f"with {A.EVENTS_SQL} select seq, coalesce(music_ts, 0) = 0 or coalesce(title, '') = '' as music_empty, coalesce(activity_ts, 0) = 0 or coalesce(label, '') = '' as activity_empty, coalesce(system_ts, 0) = 0 as system_empty from ev")
def empty_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.events(spark, sf_dir).select("seq", client.music_empty(F.col("music")).alias("music_empty"), client.activity_empty(F.col("activity")).alias("activity_empty"), client.system_empty(F.col("system")).alias("system_empty"))


_APPS = [(x.rpartition(".")[2], x) for _, ids in client.ACTIVITY_GROUPS for x in ids]
_CHOSEN = ("com.microsoft.teams", "com.tencent.qq")


@query("with a as (select unnest({0}) as name, unnest({1}) as bundle_id) select name, bundle_id, bundle_id in {2} as selected, cast(row_number() over (order by bundle_id in {2} desc, lower(name), bundle_id) as int) as position from a where contains(lower(name), 'te') or contains(lower(bundle_id), 'te')".format([n for n, _ in _APPS], [b for _, b in _APPS], _CHOSEN))
def app_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return client.search_apps(spark.createDataFrame(_APPS, "name string, bundle_id string"), "Te", _CHOSEN)


@query("select i as attempt, least(least(30000.0, 1000.0 * pow(1.8, i - 1)) + 100.0, 30000.0) as delay_ms from (select cast(unnest(range(1, 11)) as int) as i)")
def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return client.backoff(spark, jitter_ms=100.0)


@query(f"with {A.EVENTS_SQL} select seq, [1000, 1006, 1008, 1013, 4401, 4403, 1001][k % 7 + 1] in (1006, 1008, 1013, 4401, 4403) as web, [1000, 1006, 1008, 1013, 4401, 4403, 1001][k % 7 + 1] in (1008, 1013, 4401, 4403) as block from ev")
def reconnect_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.get(F.array(*map(F.lit, (1000, 1006, 1008, 1013, 4401, 4403, 1001))), F.col("k") % 7)
    return A.events(spark, sf_dir).select("seq", client.stops_reconnecting(code).alias("web"), client.stops_reconnecting(code, block=True).alias("block"))


def _config_errors(events: DataFrame) -> DataFrame:
    k = F.col("k")
    endpoint = F.when(k % 4 == 0, "").when(k % 4 == 1, "not a url").otherwise("https://example.com")
    interval = F.when(k * 4 > 300, k * 4).otherwise(k % 40)
    return events.select("seq", client.config_error(endpoint, interval, k % 3).alias("error"))


@query(f"""with {A.EVENTS_SQL}, cf as (select seq, k, case when k * 4 > 300 then k * 4 else k % 40 end as interval from ev)
select seq, case when k % 4 = 0 then '服务器地址不能为空' when k % 4 = 1 then '服务器地址格式无效' when interval not between 5 and 300 then '系统轮询间隔必须在 5-300 秒之间' when k % 3 not between 1 and 300 then '活动轮询间隔必须在 5-60 秒之间' end as error from cf""")
def config_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _config_errors(A.events(spark, sf_dir))


@query(f"with {A.EVENTS_SQL} select user_id, count(*) as reports, max(arrival_ms) as last_ms from ev group by user_id")
def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return client.report_totals(A.events(spark, sf_dir))


@query(f"with {A.EVENTS_SQL} select seq, ['PONG', 'SNAPSHOT', 'IGNORED'][k % 3 + 1] as reply from ev")
def socket_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.get(F.array(F.lit("PING"), F.lit("SNAPSHOT"), F.lit("ERROR")), F.col("k") % 3)
    return A.events(spark, sf_dir).select("seq", client.socket_reply(kind).alias("reply"))


def _subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, subscriber_id): up to three subscribers a user."""
    i = F.col("id")
    numbers = F.filter(F.sequence(F.lit(0), F.lit(2)), lambda n: n < i % 4)
    return A.users(spark, sf_dir).select(i.alias("user_id"), F.explode(numbers).alias("n")).select("user_id", (F.col("user_id") * 10 + F.col("n")).alias("subscriber_id"))


@query(f"""with {A.EVENTS_SQL}, m as (select seq, user_id, arrival_ms * 7 + case when k % 37 = 0 then 90000 else 0 end as at_ms, ['PING', 'SNAPSHOT', 'ERROR'][k % 3 + 1] as kind from ev),
t as (select *, lag(at_ms) over w as b, (at_ms - first_value(at_ms) over w) // 10000 as sent from m window w as (partition by user_id order by at_ms, seq)),
c as (select *, max(coalesce(at_ms - b > 60000, false)) over w as closed, sent - coalesce(lag(sent) over w, 0) as beats, case kind when 'PING' then 'PONG' when 'SNAPSHOT' then 'SNAPSHOT' else 'IGNORED' end as r
  from t window w as (partition by user_id order by at_ms, seq))
select seq, case when closed then null when b is null then 'PONG,' || r else r end as reply, case when closed then 0 else beats end as heartbeats, closed from c""")
def socket_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as messages of one connection, some of them late."""
    k = F.col("k")
    kind = F.get(F.array(F.lit("PING"), F.lit("SNAPSHOT"), F.lit("ERROR")), k % 3)
    at = F.col("arrival_ms") * 7 + F.when(k % 37 == 0, 90_000).otherwise(0)
    m = A.events(spark, sf_dir).select(F.col("user_id").alias("connection_id"), "seq", at.alias("at_ms"), kind.alias("kind"))
    return client.socket_sessions(m).select("seq", "reply", "heartbeats", "closed")


@query(f"with {A.EVENTS_SQL}, {A.USERS_SQL}, sb as (select id as user_id, unnest(range(10 * id, 10 * id + id % 4)) as subscriber_id from us) select seq, subscriber_id, user_id from ev join sb using (user_id)")
def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change delivered to each of its user's subscribers, of whom there are up to three."""
    from ..streaming.ingest import subscribed

    return subscribed(A.events(spark, sf_dir).select("seq", "user_id"), _subscriptions(spark, sf_dir)).select("seq", "subscriber_id", "user_id")


@query(f"""with {A.EVENTS_SQL}, {A.USERS_SQL}, sb as (select id as user_id, unnest(range(10 * id, 10 * id + id % 4)) as subscriber_id from us),
d as (select subscriber_id, seq, row_number() over (partition by subscriber_id, arrival_ms // 10000 order by seq) as n from ev join sb using (user_id)) select subscriber_id, seq, n <= 2 as delivered from d""")
def fan_out_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same deliveries through a queue of two for each subscriber."""
    from ..streaming.ingest import bounded, subscribed

    sent = subscribed(A.events(spark, sf_dir).select("seq", "user_id", "arrival_ms"), _subscriptions(spark, sf_dir))
    return bounded(sent, queue=2).select("subscriber_id", "seq", "delivered")


@query(f"with {A.EVENTS_SQL} select seq, case when k % 2 = 0 then cast(0.5 as double) end as battery, title, label, ms as last_ts from ev")
def loose_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots from JSON in which some fields are of another type."""
    k, ms = F.col("k"), A.epoch_ms(F.col("recorded_at"))
    text = F.concat(F.lit('{"system":{"batteryPct":'), F.when(k % 2 == 0, "0.5").otherwise('"half"'), F.lit('},"music":'), F.coalesce(F.to_json("music"), F.lit("null")), F.lit(',"activity":'), F.coalesce(F.to_json("activity"), F.lit("null")), F.lit(',"lastUpdateTs":'), ms.cast("string"), F.lit("}"))
    s = A.events(spark, sf_dir).select("seq", ingest.loose_snapshot(text).alias("s"))
    return s.select("seq", F.col("s.system.batteryPct").alias("battery"), "s.music.title", "s.activity.label", F.col("s.lastUpdateTs").alias("last_ts"))


@query(f"with {A.EVENTS_SQL} select count(distinct user_id) as users, count(*) as clients from ev where k % 3 = 0")
def subscriber_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return client.subscriber_gauges(A.events(spark, sf_dir).where(F.col("k") % 3 == 0).select("user_id"))


@query(f"with {A.EVENTS_SQL} select seq, cast(trunc(seq * 1.0009765625 * 1000) as bigint) as ms from ev")
def wire_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.events(spark, sf_dir).select("seq", ingest.wire_ms(F.col("seq") * F.lit(1.0009765625)).alias("ms"))


@query(f"with {A.EVENTS_SQL} select seq, coalesce(lead(arrival_ms) over (partition by user_id order by arrival_ms, seq) - arrival_ms >= 2000, true) as applied from ev")
def settings_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of settings that others follow too soon don't count (STR13)."""
    return client.debounced(A.events(spark, sf_dir).select("user_id", "seq", F.col("arrival_ms").alias("at_ms")), 2000).select("seq", "applied")


# --- ordered folds ---


@query(f"""with recursive {A.EVENTS_SQL}, o as (select user_id, seq, 'key-' || (k % 7) as key, row_number() over (partition by user_id order by seq) as n from ev),
f as (select user_id, seq, key, n, false as known, [key] as memo from o where n = 1
  union all select o.user_id, o.seq, o.key, o.n, list_contains(f.memo, o.key), case when list_contains(f.memo, o.key) then f.memo when len(f.memo) >= 3 then [o.key] else list_append(f.memo, o.key) end
  from f join o on o.user_id = f.user_id and o.n = f.n + 1)
select user_id, seq, key, known from f""")
def upload_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covers that a client with a memo of three needn't ask for (CCH3)."""
    r = A.events(spark, sf_dir).select("user_id", "seq", F.concat(F.lit("key-"), (F.col("k") % 7).cast("string")).alias("key"))
    return folds.remembered(r, 3)


@query(f"""with {A.EVENTS_SQL}, l as (select user_id, seq, case when k % 6 = 1 then '' else 'line ' || seq || ' of ' || coalesce(title, 'nothing') end as line from ev),
p as (select user_id, seq, lag(line) over (partition by user_id order by seq) as value from l) select user_id, seq, value from p where value <> ''""")
def chunked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines cut into chunks anywhere and put together again: each ends with the next chunk (SRC9)."""
    line = F.when(F.col("k") % 6 == 1, "  ").otherwise(F.concat(F.lit(" line "), F.col("seq").cast("string"), F.lit(" of "), F.coalesce("music.title", F.lit("nothing"))))
    e = A.events(spark, sf_dir).select("user_id", "seq", line.alias("line"), (F.col("k") % 9).alias("cut"))
    by_user = W.Window.partitionBy("user_id").orderBy("seq")
    head, rest = F.substring(F.col("line"), F.lit(1), F.col("cut")), F.substring(F.col("line"), F.col("cut") + 1, F.length("line"))
    before = F.lag(rest).over(by_user)
    return folds.lines_of_chunks(e.select("user_id", "seq", F.concat(F.coalesce(F.concat(before, F.lit("\n")), F.lit("")), head).alias("chunk")))


_SONG = "struct(title varchar, artist varchar, playing boolean, art varchar)"


@query(f"""with recursive {A.EVENTS_SQL}, r as (select user_id, seq, row_number() over (partition by user_id order by seq) as n, k % 3 = 0 as diff, title, artist, case when k % 2 = 0 then k % 5 = 0 end as playing,
  case k % 4 when 0 then null when 1 then '' else base64(encode('art-' || (k % 5))) end as raw from ev),
f as (select distinct user_id, cast(0 as bigint) as n, cast(null as bigint) as seq, 'none' as act, cast(null as {_SONG}) as cur, cast(null as {_SONG}) as pend from r
  union all
  select user_id, n, seq, act,
    case when act = 'new' then song when act = 'picture' then struct_pack(title := pend.title, artist := pend.artist, playing := pend.playing, art := coalesce(song.art, pend.art))
      when act = 'play' and pend is not null then struct_pack(title := pend.title, artist := pend.artist, playing := song.playing, art := pend.art)
      when act = 'play' then struct_pack(title := cur.title, artist := cur.artist, playing := song.playing, art := cur.art)
      when act = 'own picture' then struct_pack(title := cur.title, artist := cur.artist, playing := cur.playing, art := song.art) when act <> 'stop' then cur end,
    case when act = 'wait' then song when act in ('none', 'own picture') then pend end
  from (select r.user_id, r.n, r.seq, f.cur, f.pend, struct_pack(title := r.title, artist := r.artist, playing := r.playing, art := nullif(r.raw, '')) as song,
    case when not diff and (coalesce(r.title, '') = '' or coalesce(r.artist, '') = '') then 'stop'
      when not diff and (f.cur is null or f.cur.title = r.title and f.cur.artist = r.artist or nullif(r.raw, '') is not null and r.raw is distinct from f.cur.art) then 'new' when not diff then 'wait'
      when raw is not null and f.pend is not null then 'picture' when raw <> '' and f.cur is not null then 'own picture' when raw is null and r.playing is not null and (f.pend is not null or f.cur is not null) then 'play' else 'none' end as act
    from f join r on r.user_id = f.user_id and r.n = f.n + 1))
select user_id, seq, act = 'stop' as stopped, cur.title as title, cur.artist as artist, cur.playing as playing, cur.art as artwork from f where act in ('stop', 'new', 'picture', 'play')""")
def now_playing_fsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    art = F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, "").otherwise(F.base64(F.concat(F.lit("art-"), (k % 5).cast("string")).cast("binary")))
    r = A.events(spark, sf_dir).select("user_id", "seq", (k % 3 == 0).alias("diff"), "music.title", "music.artist", "music.album", F.when(k % 2 == 0, k % 5 == 0).alias("playing"), F.lit("com.apple.Music").alias("bundle_id"), art.alias("artwork"))
    return folds.now_playing(r, ("com.apple.Music",))


@query(f"""with recursive {A.EVENTS_SQL}, o as (select user_id, seq, arrival_ms, row_number() over (partition by user_id order by arrival_ms, seq) as n from ev),
f as (select user_id, seq, arrival_ms, n, true as allowed, [arrival_ms] as calls from o where n = 1
  union all select user_id, seq, arrival_ms, n, len(k) <= 5, case when len(k) <= 5 then list_append(k, arrival_ms) else k end
  from (select o.*, list_filter(f.calls, lambda x: x > o.arrival_ms - 60000) as k from f join o on o.user_id = f.user_id and o.n = f.n + 1))
select user_id, seq, arrival_ms, allowed from f""")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.rate_limited(A.events(spark, sf_dir), 60_000, 5)


