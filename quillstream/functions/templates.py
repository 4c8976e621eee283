"""Templates over a snapshot (FN1 to FN8). Values are put in one after the other, so what one
value brings in, a later step may expand."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .formatting import fixed

DEFAULT = "正在听{artist}-{title}"
NOT_PLAYING = "未在播放"
TERNARY = r"\{charging\?'([^']*)':'([^']*)'\}"
#: The catalogue of placeholders (key, category, label, type, example).
VARIABLES = (
    ("artist", "music", "歌手", "string", "Taylor Swift"),
    ("title", "music", "歌曲名", "string", "Love Story"),
    ("album", "music", "专辑名", "string", "1989"),
    ("batteryPct", "system", "电量小数", "decimal_string", "0.82"),
    ("batteryPctRounded", "system", "电量百分比", "percent_string", "82%"),
    ("cpuPct", "system", "CPU 使用率小数", "decimal_string", "0.37"),
    ("cpuPctRounded", "system", "CPU 使用率", "percent_string", "37%"),
    ("memoryPct", "system", "内存使用率小数", "decimal_string", "0.62"),
    ("memoryPctRounded", "system", "内存使用率", "percent_string", "62%"),
    ("activityLabel", "activity", "当前活动", "string", "在研发"),
    ("nowLocal", "time", "当前本地时间", "datetime_string", "2026-06-01 10:20:30"),
    ("dateYMD", "time", "当前日期", "date_string", "2026-06-01"),
    ("nowISO", "time", "当前 ISO 时间", "datetime_string", "2026-06-01T10:20:30+08:00"),
)
EXPRESSION = "{charging?'true_text':'false_text'}"


def _put(template: Column, values: dict[str, Column]) -> Column:
    for key, value in values.items():
        template = F.replace(template, F.lit("{" + key + "}"), F.coalesce(value, F.lit("")))
    return template


def _percent(value: Column) -> Column:
    return F.concat(fixed(value * 100, 0), F.lit("%"))


def render(template: Column, snapshot: Column, now: datetime) -> Column:
    """The filled-in template. now: aware, in the zone to show; null charging counts as not charging."""
    music, system = snapshot["music"], snapshot["system"]
    title = F.when(music.isNull(), NOT_PLAYING).otherwise(F.coalesce(music["title"], F.lit("")))
    of_music = {"artist": music["artist"], "title": title, "album": music["album"]}
    of_system = {}
    for name in ("batteryPct", "cpuPct", "memoryPct"):
        of_system |= {name: fixed(system[name], 2), name + "Rounded": _percent(system[name])}
    of_activity = {"activityLabel": snapshot["activity"]["label"]}
    iso = now.isoformat(timespec="seconds")
    of_time = {"nowLocal": F.lit(now.strftime("%Y-%m-%d %H:%M:%S")), "dateYMD": F.lit(now.strftime("%Y-%m-%d")), "nowISO": F.lit(iso.removesuffix("+00:00") + "Z" if iso.endswith("+00:00") else iso)}
    filled = template
    for values in (of_music, of_system, of_activity, of_time):
        filled = _put(filled, values)
    without = _put(template, {"artist": F.lit(""), "title": F.lit(NOT_PLAYING), "album": F.lit(""), "activityLabel": F.lit("")})
    without = _put(_put(without, of_time), dict.fromkeys(of_system, F.lit("")))
    out = F.when(snapshot.isNull(), without).otherwise(filled)
    charging = F.coalesce(system["charging"], F.lit(False))
    return F.when(charging, F.regexp_replace(out, TERNARY, "$1")).otherwise(F.regexp_replace(out, TERNARY, "$2"))


def or_default(template: Column) -> Column:
    return F.when(template == "", DEFAULT).otherwise(template)


def catalogue(spark: SparkSession) -> DataFrame:
    """The placeholders and the one expression."""
    rows = [("variable", k, "{" + k + "}", category, label, kind, example) for k, category, label, kind, example in VARIABLES]
    rows.append(("ternary", "charging", EXPRESSION, "system", None, None, None))
    return spark.createDataFrame(rows, "kind string, key string, placeholder string, category string, label string, type string, example string")

DEFAULT_PREVIEW = "未在播放音乐"


def preview(title: Column, image_key: Column) -> Column:
    """What a link preview shows: the rendered title, or a general one where there is none (PRJ5)."""
    return F.struct(F.coalesce(title, F.lit(DEFAULT_PREVIEW)).alias("title"), image_key.alias("image_key"))
