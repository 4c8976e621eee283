"""Numbers, times, colours and small texts (FN22 to FN33)."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, digits: int) -> Column:
    """The exact binary value with so many digits, exact ties to the even digit; null for null.

    The JVM's formatter rounds the shortest decimal form instead, so this is an Arrow-batched UDF.
    """

    def text(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if pd.isna(x) else f"{x:.{digits}f}").astype(object)

    return F.pandas_udf(text, "string")(value.cast("double"))


def fixed_half_up(value: Column, digits: int) -> Column:
    """The exact binary value with so many digits, exact ties upwards; null for null."""
    unit = f"1e-{digits}"

    def text(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if pd.isna(x) else str(Decimal(x).quantize(Decimal(unit), ROUND_HALF_UP))).astype(object)

    return F.pandas_udf(text, "string")(value.cast("double"))


def percent(value: Column) -> Column:
    """0.4567 as 45.67%."""
    return F.concat(fixed_half_up(value * 100, 2), F.lit("%"))


def count_text(n: Column) -> Column:
    """1234 as 1.2k; below a thousand as it is."""
    return F.when(n >= 1000, F.concat(fixed_half_up(n / 1000, 1), F.lit("k"))).otherwise(n.cast("string"))


def battery_text(battery: Column, charging: Column) -> Column:
    state = F.when(F.coalesce(charging, F.lit(False)), "充电中").otherwise("未充电")
    return F.when(battery.isNull(), "未知").otherwise(F.concat(F.floor(battery * 100 + 0.5).cast("string"), F.lit("% ("), state, F.lit(")")))


def battery_colour(battery: Column, charging: Column) -> Column:
    return F.when(charging, "green").when(battery.isNull(), "gray").when(battery > 0.5, "green").when(battery > 0.2, "yellow").otherwise("red")


def resource_colour(value: Column) -> Column:
    return F.when(value.isNull(), "gray").when(value < 0.5, "green").when(value < 0.8, "yellow").otherwise("red")


def relative_time(ts_ms: Column, now_ms: Column) -> Column:
    """How long ago, in the largest whole unit; 0 and null mean no data."""
    seconds = F.floor((now_ms - ts_ms) / 1000)
    units = ((86400, "天前"), (3600, "小时前"), (60, "分钟前"))
    out = F.when(F.coalesce(ts_ms, F.lit(0)) == 0, "暂无数据")
    for size, text in units:
        out = out.when(F.floor(seconds / size) > 0, F.concat(F.floor(seconds / size).cast("string"), F.lit(text)))
    return out.otherwise("刚刚")


def absolute_time(ts_ms: Column, tz: str) -> Column:
    """2024/01/30 20:34:56 in the zone."""
    utc = F.timestamp_add("MILLISECOND", ts_ms, F.lit("1970-01-01").cast("timestamp_ntz"))
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(tz), utc), "yyyy/MM/dd HH:mm:ss")


def error_text(response_message: Column, message: Column) -> Column:
    """The first of both that isn't null or empty, or else a general text."""
    return F.coalesce(F.nullif(response_message, F.lit("")), F.nullif(message, F.lit("")), F.lit("未知错误"))


def whole_percent(value: Column) -> Column:
    """Truncated, not rounded."""
    return (value * 100).cast("int")


def is_idle(idle_seconds: Column) -> Column:
    return idle_seconds > 300


def idle_text(idle_seconds: Column) -> Column:
    """125 as 2分5秒; less than a minute as 5秒."""
    s = idle_seconds.cast("int")
    minutes = F.floor(s / 60)
    return F.concat(F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("分"))).otherwise(""), (s % 60).cast("string"), F.lit("秒"))


def clamped(used: Column, total: Column) -> Column:
    """used / total within 0 and 1; null if total isn't positive."""
    return F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), used / total)))


def capacity(current: Column, most: Column) -> Column:
    return F.when(most > 0, current / most)


def status_summary(music: Column, system: Column, activity: Column) -> Column:
    """One line each for music, system and activity, as far as there is any."""
    pct = lambda v: whole_percent(v).cast("string")
    icon = F.when(F.coalesce(system["charging"], F.lit(False)), "🔌").otherwise("🔋")
    parts = F.concat_ws(" ", F.concat(icon, F.lit(" "), pct(system["batteryPct"]), F.lit("%")), F.concat(F.lit("💻 CPU "), pct(system["cpuPct"]), F.lit("%")), F.concat(F.lit("🧠 内存 "), pct(system["memoryPct"]), F.lit("%")))
    lines = F.concat_ws("\n", F.concat(F.lit("🎵 "), music["artist"], F.lit(" - "), music["title"]), F.nullif(parts, F.lit("")), F.concat(F.lit("👤 "), activity["label"]))
    return F.when(lines == "", "无状态数据").otherwise(lines)


def cache_key(user_id: Column, tz: str, from_seconds: int, to_seconds: int) -> Column:
    return F.concat(F.lit("stats:"), user_id.cast("string"), F.lit(f":{tz}:{from_seconds}:{to_seconds}"))


def cache_ttl_seconds(user_id: Column) -> Column:
    """One hour and 5 to 20 minutes more, by user."""
    return 3600 + (5 + user_id % 16) * 60
