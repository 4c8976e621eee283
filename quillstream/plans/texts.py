"""Templates, links, commands and formatted values."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import commands, crypto, links, templates
from ..functions import formatting as fmt
from ..operators import access, client, state
from ..sources import adapter as A
from ..sources import ingest
from .ingestion import _EV, _MERGED
from .registry import query

NOW = datetime(2024, 1, 30, 12, 34, 56, tzinfo=UTC)
TEMPLATES = (
    "正在听{artist}-{title}",
    "{artist}|{title}|{album}|{batteryPct}|{batteryPctRounded}|{activityLabel}",
    "{cpuPct}/{cpuPctRounded}/{memoryPct}/{memoryPctRounded}",
    "{nowLocal} {dateYMD} {nowISO}",
    "{charging?'充电中':'未充电'}{playing?'a':'b'}{charging?'':'⚡'}",
    "",
)


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _rendered_sql(template: str) -> str:
    steps = [
        ("{artist}", "coalesce(artist, '')"), ("{title}", "case when coalesce(has_music, false) then coalesce(title, '') else '未在播放' end"), ("{album}", "coalesce(album, '')"),
        ("{batteryPct}", "coalesce(printf('%.2f', battery), '')"), ("{batteryPctRounded}", "coalesce(printf('%.0f', battery * 100) || '%', '')"),
        ("{cpuPct}", "coalesce(printf('%.2f', cpu), '')"), ("{cpuPctRounded}", "coalesce(printf('%.0f', cpu * 100) || '%', '')"),
        ("{memoryPct}", "coalesce(printf('%.2f', memory), '')"), ("{memoryPctRounded}", "coalesce(printf('%.0f', memory * 100) || '%', '')"),
        ("{activityLabel}", "coalesce(label, '')"), ("{nowLocal}", "'2024-01-30 12:34:56'"), ("{dateYMD}", "'2024-01-30'"), ("{nowISO}", "'2024-01-30T12:34:56Z'"),
    ]
    out = f"case when {template} = '' then '正在听{{artist}}-{{title}}' else {template} end"
    for key, value in steps:
        out = f"replace({out}, '{key}', {value})"
    return rf"regexp_replace({out}, '\{{charging\?''([^'']*)'':''([^'']*)''\}}', case when coalesce(charging, false) then '\1' else '\2' end, 'g')"


_TEMPLATES_SQL = "tp as (select unnest([" + ", ".join(map(_lit, TEMPLATES)) + f"]) as template, unnest(range({len(TEMPLATES)})) as number)"


@query(f"with {_EV}, {_MERGED}, {_TEMPLATES_SQL}, {A.USERS_SQL} select id as user_id, cast(number as int) as number, {_rendered_sql('template')} as text from us left join se on se.user_id = id join cu on cu.user_id = id, tp where coalesce(public, true)")
def render_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All templates over the current state of each user whose page may be rendered."""
    u = access.with_settings(A.users(spark, sf_dir), A.user_settings(spark, sf_dir)).where(access.is_public(F.col("publicEnabled")))
    s = state.current_or_empty(u, state.merge_latest(A.events(spark, sf_dir), A.NOW_MS), A.NOW_MS)
    each = s.select(F.col("id").alias("user_id"), "snapshot", F.posexplode(F.array(*map(F.lit, TEMPLATES))).alias("number", "template"))
    return each.select("user_id", "number", templates.render(templates.or_default(F.col("template")), F.col("snapshot"), NOW).alias("text"))


@query("select cast(number as int) as number, replace(replace(replace(replace(" + _rendered_sql("template").replace("coalesce(has_music, false)", "false") + ", '', ''), '', ''), '', ''), '', '') as text from (select null::varchar as artist, null::varchar as title, null::varchar as album, null::double as battery, null::double as cpu, null::double as memory, null::varchar as label, null::boolean as charging) s, (select unnest([" + ", ".join(map(_lit, TEMPLATES)) + f"]) as template, unnest(range({len(TEMPLATES)})) as number) tp")
def render_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All templates without any snapshot."""
    from .. import schemas

    rows = spark.createDataFrame(list(enumerate(TEMPLATES)), "number int, template string").withColumn("snapshot", F.lit(None).cast(schemas.SNAPSHOT))
    return rows.select("number", templates.render(templates.or_default(F.col("template")), F.col("snapshot"), NOW).alias("text"))


@query("with {0} select seq, case when coalesce(charging, false) then '充电中|⚡' else '未充电|' end as text from ev".format(A.EVENTS_SQL))
def render_charging(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = state.with_snapshot(A.events(spark, sf_dir), A.NOW_MS)
    return e.select("seq", templates.render(F.lit("{charging?'充电中':'未充电'}|{charging?'⚡':''}"), F.col("snapshot"), NOW).alias("text"))


@query("select unnest([" + ", ".join(_lit(v[0]) for v in templates.VARIABLES) + "]) as key, unnest([" + ", ".join(_lit(v[1]) for v in templates.VARIABLES) + "]) as category, 'variable' as kind union all select 'charging', 'system', 'ternary'")
def template_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.catalogue(spark).select("key", "category", "kind")


@query(f"with {A.EVENTS_SQL} select seq, coalesce(title || '!', '未在播放音乐') as title, 'image-' || (k % 3) as image_key from ev")
def link_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = templates.preview(F.concat(F.col("music.title"), F.lit("!")), F.concat(F.lit("image-"), (F.col("k") % 3).cast("string")))
    return A.events(spark, sf_dir).select("seq", shown.alias("p")).select("seq", "p.*")


# --- links ---

_URLS = """lk as (select page_id, case page_id % 8
  when 0 then url when 1 then ' https://example.com/s/key%20' || page_id || '?m=%E6%AD%A3%7Btitle%7D+x&r=y ' when 2 then '' when 3 then '://bad'
  when 4 then 'https://example.com/status/key-' || page_id || '?m=hello' when 5 then 'https://example.com/s/key-' || page_id || '/extra?m=hello'
  when 6 then 'https://example.com/s/key-' || page_id || '/' else 'https://Example.com:8080/key-' || page_id end as u,
  case when page_id % 16 = 2 then ' legacy-' || page_id || ' ' else '' end as legacy from pages)"""


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id").cast("string")
    cases = {
        1: F.concat(F.lit(" https://example.com/s/key%20"), i, F.lit("?m=%E6%AD%A3%7Btitle%7D+x&r=y ")), 2: F.lit(""), 3: F.lit("://bad"),
        4: F.concat(F.lit("https://example.com/status/key-"), i, F.lit("?m=hello")), 5: F.concat(F.lit("https://example.com/s/key-"), i, F.lit("/extra?m=hello")),
        6: F.concat(F.lit("https://example.com/s/key-"), i, F.lit("/")), 7: F.concat(F.lit("https://Example.com:8080/key-"), i),
    }
    u = F.when(F.col("page_id") % 8 == 0, F.col("url"))
    for k, v in cases.items():
        u = u.when(F.col("page_id") % 8 == k, v)
    legacy = F.when(F.col("page_id") % 16 == 2, F.concat(F.lit(" legacy-"), i, F.lit(" "))).otherwise("")
    return A.table(spark, sf_dir, "pages").select("page_id", u.alias("u"), legacy.alias("legacy"))


@query(f"""with {_URLS} select page_id, case page_id % 8 when 1 then 'OK' when 6 then 'OK' when 2 then case when legacy <> '' then 'OK' else 'MISSING' end else 'INVALID' end as status,
  case page_id % 8 when 1 then 'key ' || page_id when 6 then 'key-' || page_id when 2 then case when legacy <> '' then trim(legacy) end end as sharing_key,
  case page_id % 8 when 1 then '正{{title}} x' when 6 then '' when 2 then case when legacy <> '' then 'hello {{title}}' end end as template from lk""")
def parse_share_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = links.parse_share_url(F.col("u"), F.col("legacy"), F.lit("hello {title}"))
    return _urls(spark, sf_dir).select("page_id", x.alias("x")).select("page_id", "x.*")


@query(f"with {_URLS} select page_id, case page_id % 8 when 1 then 'key ' || page_id when 5 then 'key-' || page_id when 6 then 'key-' || page_id else '' end as sharing_key from lk")
def parse_share_url_bot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("page_id", links.bot_key(F.col("u")).alias("sharing_key"))


def _block_links(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", links.block_link(F.col("u")).alias("x")).select("page_id", "x.*")


@query(rf"""with {_URLS}, pa as (select page_id, regexp_extract(trim(u), '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)([?][^#]*)?(#.*)?$', ['scheme', 'host', 'path']) as p from lk),
sg as (select page_id, lower(p.scheme) || '://' || lower(p.host) as base, [x for x in string_split(p.path, '/') if x <> ''] as parts, p.scheme <> '' as found from pa),
ky as (select page_id, base, case when not found then null when len(parts) >= 2 and parts[1] in ('status', 's') then parts[2] when len(parts) = 1 then parts[1] end as key from sg)
select page_id, case when key is not null then base end as base_url, key as sharing_key from ky""")
def parse_share_url_mini(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page; base_url and sharing_key are null for links that aren't of a known form."""
    return _block_links(_urls(spark, sf_dir))


@query(f"with {A.USERS_SQL} select id, case when id % 4 = 0 then '' else 'https://docs.example.com/?k=share-' || id || '&again=share-' || id end as url from us")
def substitute_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = F.when(F.col("id") % 4 == 0, "  ").otherwise("https://docs.example.com/?k={SharingKey}&again={SharingKey}")
    return A.users(spark, sf_dir).select("id", links.with_key(template, F.col("sharing_key")).alias("url"))


@query(f"with {A.USERS_SQL} select id, case when id % 3 = 0 then 'https://r.example.com/' || id else 'https://example.com/status/share-' || id end as url from us")
def redirect_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.when(F.col("id") % 3 == 0, F.concat(F.lit("https://r.example.com/"), F.col("id").cast("string"))).when(F.col("id") % 3 == 1, "")
    return A.users(spark, sf_dir).select("id", links.redirect_target(asked, "https://example.com/status/{SharingKey}", F.col("sharing_key")).alias("url"))


@query(f"with {A.USERS_SQL} select id, 'https://example.com/s/share-' || id || case id % 3 when 0 then '' when 1 then '?m=%7Btitle%7D+x' else '?r=https%3A%2F%2Fa.b%2F&m=%7Btitle%7D+x' end as share, '/api/v1/ws?sharingKey=share-' || id as socket, 'https://e.com:' || id || '/api/v1/state/report' as report, 'https://e.com:' || id as base from us")
def share_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, key = F.col("id"), F.col("sharing_key")
    endpoint = F.concat(F.lit("https://e.com:"), i.cast("string"))
    return A.users(spark, sf_dir).select(
        "id", links.share_link("https://example.com", key, F.when(i % 3 == 2, "https://a.b/"), F.when(i % 3 != 0, "{title} x")).alias("share"), links.socket_url(key).alias("socket"),
        links.report_url(F.concat(endpoint, F.lit("//"))).alias("report"), links.base_url(F.concat(endpoint, F.lit("/x/y?z"))).alias("base"),
    )


# --- commands ---

_LINES = ("/public on", " /STAT off ", "/rotate sharing-key", "帮助", "/public", "/public maybe", "推荐配置", "/config x", "/info a b", "/nonsense", "   ", "hello", "/rotate SECRET-KEY")
_VALID = ("ok", "ok", "ok", "ok", "bad_params", "bad_params", "ok", "bad_params", "ok", "unknown", None, "unknown", "ok")


def _sql_list(values: tuple) -> str:
    return "[" + ", ".join("null" if v is None else _lit(v) for v in values) + "]"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    n = F.col("conv_id") % (2 * len(_LINES))
    text = F.coalesce(F.get(F.array(*map(F.lit, _LINES)), n.cast("int")), F.col("text"))
    body = F.to_json(F.struct(text.alias("text")))
    m = ingest.bot_messages(c.select(F.struct("conv_id", "turn", F.col("text").alias("t")).alias("message_id"), body.alias("body")))
    return m.select("message_id.conv_id", "message_id.turn", "command")


_AT = f"[cast(conv_id % {2 * len(_LINES)} as int) + 1]"
_BLANKS = r"[ \t\n\x0b\f\r\x{00a0}]+"
_COMMANDS_SQL = rf"""li as (select conv_id, turn, regexp_replace(coalesce({_sql_list(_LINES)}{_AT}, text, ''), '^{_BLANKS}|{_BLANKS}$', '', 'g') as t from conversations),
cl as (select conv_id, turn, case when t = '' then null when starts_with(t, '/') then lower(t) {" ".join(f"when t = {_lit(k)} then {_lit(v)}" for k, v in commands.PHRASES.items())} else 'unknown' end as line from li),
cm as (select conv_id, turn, regexp_replace(p[1], '^/', '') as action, array_to_string(p[2:], ' ') as params from (select conv_id, turn, regexp_split_to_array(line, '{_BLANKS}') as p from cl))"""


@query(f"with {_COMMANDS_SQL} select conv_id, turn, action, params from cm")
def parse_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).select("conv_id", "turn", "command.action", F.array_join("command.params", " ").alias("params"))


@query(f"""with {_COMMANDS_SQL} select conv_id, turn, case when action is null then null
  when action = 'public' or action = 'stat' then case when params in ('on', 'off') then 'ok' else 'bad_params' end
  when action = 'rotate' then case when params in ('secret-key', 'sharing-key') then 'ok' else 'bad_params' end
  when action in ('config', 'help') then case when params = '' then 'ok' else 'bad_params' end
  when action = 'info' then 'ok' else 'unknown' end as verdict from cm""")
def validate_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).select("conv_id", "turn", commands.validate(F.col("command")).alias("verdict"))


@query("select doc_id, '`' || replace(lang, '`', '''') || '`' || chr(10) || '`' || source || '`' as lines, case when doc_id % 2 = 0 then '`未配置 DOC_URL`' else '`' || source || '`' end as setting, case when doc_id % 2 = 0 then '<font color=''green''>on</font>' else '<font color=''grey''>off</font>' end as status from documents")
def card_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("doc_id") % 2 == 0
    d = A.table(spark, sf_dir, "documents")
    return d.select("doc_id", commands.inline_lines(F.array("lang", "source")).alias("lines"), commands.optional_code(F.when(even, " ").otherwise(F.col("source")), "DOC_URL").alias("setting"), commands.status_text(even, "on", "off").alias("status"))


# --- formatted values ---


@query(f"""with {A.EVENTS_SQL}, ag as (select seq, system_ts, floor(({A.NOW_MS} - system_ts) / 1000) as s from ev)
select seq, case when coalesce(system_ts, 0) = 0 then '暂无数据' when s >= 86400 then cast(floor(s / 86400) as bigint) || '天前' when s >= 3600 then cast(floor(s / 3600) as bigint) || '小时前' when s >= 60 then cast(floor(s / 60) as bigint) || '分钟前' else '刚刚' end as text from ag""")
def relative_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.events(spark, sf_dir).select("seq", fmt.relative_time(F.col("system.ts"), F.lit(A.NOW_MS)).alias("text"))


@query(f"with {A.EVENTS_SQL} select seq, case when battery is null then '未知' else cast(cast(floor(battery * 100 + 0.5) as bigint) as varchar) || '% (' || case when coalesce(charging, false) then '充电中' else '未充电' end || ')' end as text from ev")
def battery_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.events(spark, sf_dir).select("seq", fmt.battery_text(F.col("system.batteryPct"), F.col("system.charging")).alias("text"))


@query(f"with {A.EVENTS_SQL} select seq, case when charging then 'green' when battery is null then 'gray' when battery > 0.5 then 'green' when battery > 0.2 then 'yellow' else 'red' end as battery, case when cpu is null then 'gray' when cpu < 0.5 then 'green' when cpu < 0.8 then 'yellow' else 'red' end as cpu from ev")
def colour_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.events(spark, sf_dir).select("seq", fmt.battery_colour(F.col("system.batteryPct"), F.col("system.charging")).alias("battery"), fmt.resource_colour(F.col("system.cpuPct")).alias("cpu"))


# printf rounds the exact binary value too, but a tie to the even digit. Of the values that end in 50 only 250 and 750 are ties in binary.
@query(f"with {A.EVENTS_SQL} select seq, case when seq >= 1000 then printf('%.1f', (seq + case when seq % 500 = 250 then 1 else 0 end) / 1000) || 'k' else cast(seq as varchar) end as text from ev")
def count_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.events(spark, sf_dir).select("seq", fmt.count_text(F.col("seq")).alias("text"))


@query(f"with {A.EVENTS_SQL} select seq, cast(trunc(battery * 100) as int) as battery, cast(trunc(memory * 100) as int) as memory, k * 7 > 300 as idle, case when k * 7 >= 60 then (k * 7 // 60) || '分' else '' end || (k * 7 % 60) || '秒' as idle_text from ev")
def client_percent_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    idle = F.col("k") * 7
    return A.events(spark, sf_dir).select("seq", fmt.whole_percent(F.col("system.batteryPct")).alias("battery"), fmt.whole_percent(F.col("system.memoryPct")).alias("memory"), fmt.is_idle(idle).alias("idle"), fmt.idle_text(idle).alias("idle_text"))


@query(f"with {A.EVENTS_SQL} select seq, case when k % 10 > 0 then greatest(0.0, least(1.0, (k - 5) / (k % 10))) end as memory, case when k % 10 > 0 then k / (k % 10) end as battery from ev")
def clamp_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return A.events(spark, sf_dir).select("seq", fmt.clamped(k - 5, k % 10).alias("memory"), fmt.capacity(k, k % 10).alias("battery"))


@query(f"with {A.EVENTS_SQL} select seq, printf('%.2f', k * 100 / 1000.0) as pct, strftime(timezone('Asia/Shanghai', timezone('UTC', recorded_at)), '%Y/%m/%d %H:%M:%S') as shown, case when k % 3 = 0 then 'r' when k % 3 = 1 then 'm' else '未知错误' end as error from ev")
def shown_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    e = A.events(spark, sf_dir)
    error = fmt.error_text(F.when(k % 3 == 0, "r").otherwise(""), F.when(k % 3 == 1, "m"))
    return e.select("seq", F.regexp_replace(fmt.percent(k / 1000), "%$", "").alias("pct"), fmt.absolute_time(A.epoch_ms(F.col("recorded_at")), "Asia/Shanghai").alias("shown"), error.alias("error"))


@query(f"""with {A.EVENTS_SQL}, s as (select seq, concat_ws(chr(10), '🎵 ' || artist || ' - ' || title,
  nullif(concat_ws(' ', case when coalesce(charging, false) then '🔌' else '🔋' end || ' ' || cast(trunc(battery * 100) as int) || '%', '💻 CPU ' || cast(trunc(cpu * 100) as int) || '%', '🧠 内存 ' || cast(trunc(memory * 100) as int) || '%'), ''), '👤 ' || label) as t from ev)
select seq, case when t = '' then '无状态数据' else t end as text from s""")
def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.events(spark, sf_dir).select("seq", fmt.status_summary(F.col("music"), F.col("system"), F.col("activity")).alias("text"))


_LABELS = ("在搞研发", "Coding time", "在工作&研究", "阅读代码", "Design review", "meeting", "上网", "shell", "听音乐", "Chat", "idle", "睡觉", "在终端", "", None)


def _category_sql(label: str) -> str:
    found = " ".join(f"when {' or '.join(f'contains(lower({label}), {_lit(w)})' for w in words)} then '{name}'" for name, words in client.CATEGORIES)
    return f"case when {label} is null then 'other' {found} else 'other' end"


@query(f"with l as (select conv_id, turn, case when conv_id % 3 = 0 then text else {_sql_list(_LABELS)}[cast((conv_id + turn) % {len(_LABELS)} as int) + 1] end as label from conversations) select conv_id, turn, {_category_sql('label')} as category from l")
def activity_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message or a label of the client."""
    own = F.get(F.array(*map(F.lit, _LABELS)), ((F.col("conv_id") + F.col("turn")) % len(_LABELS)).cast("int"))
    label = F.when(F.col("conv_id") % 3 == 0, F.col("text")).otherwise(own)
    return A.table(spark, sf_dir, "conversations").select("conv_id", "turn", client.category(label).alias("category"))


@query()
def aes_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, iv = b"0123456789abcdef", b"fedcba9876543210"
    u = A.users(spark, sf_dir).select("id", crypto.encode_id(F.col("open_id"), key, iv).alias("code"), "open_id")
    return u.select("id", "code", (crypto.decode_id(F.col("code"), key, iv) == F.col("open_id")).alias("same"))
