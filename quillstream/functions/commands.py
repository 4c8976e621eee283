"""Bot commands: parsing, validation, card text (FN12, FN13, FN17)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases that stand for commands.
PHRASES = {
    "开启公开访问": "public on",
    "关闭公开访问": "public off",
    "授权音乐统计": "stat on",
    "取消授权音乐统计": "stat off",
    "查看我的信息": "info",
    "轮转数据上报密钥": "rotate secret-key",
    "轮转个人主页/飞书签名链接": "rotate sharing-key",
    "轮转个人主页": "rotate sharing-key",
    "帮助": "help",
    "推荐配置": "config",
}
#: What each command takes.
CHOICES = {"public": ("on", "off"), "stat": ("on", "off"), "rotate": ("secret-key", "sharing-key")}
PLAIN = ("config", "help")
BLANK = "[\\s\\u00a0]+"


def message_text(message: Column) -> Column:
    """The `text` of a message in JSON; empty if there is none."""
    return F.coalesce(F.get_json_object(message, "$.text"), F.lit(""))


def parse(text: Column) -> Column:
    """struct(action, params) or null for a blank text. Slash commands don't heed case, phrases must match."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{BLANK}|{BLANK}$", "")
    phrase = F.when(t == "", None)
    for words, command in PHRASES.items():
        phrase = phrase.when(t == words, command)
    line = F.when(t.startswith("/"), F.lower(t)).otherwise(F.coalesce(phrase, F.lit("unknown")))
    parts = F.split(line, BLANK)
    return F.when(t != "", F.struct(F.regexp_replace(F.get(parts, F.lit(0)), "^/", "").alias("action"), F.slice(parts, F.lit(2), F.size(parts)).alias("params")))


def validate(command: Column) -> Column:
    """`ok`, `bad_params` or `unknown`; null for no command."""
    action, params = command["action"], command["params"]
    out = F.when(command.isNull(), None)
    for name, choices in CHOICES.items():
        out = out.when(action == name, F.when((F.size(params) == 1) & F.get(params, F.lit(0)).isin(*choices), "ok").otherwise("bad_params"))
    return out.when(action.isin(*PLAIN), F.when(F.size(params) == 0, "ok").otherwise("bad_params")).when(action == "info", "ok").otherwise("unknown")


def inline_code(value: Column) -> Column:
    return F.concat(F.lit("`"), F.replace(value, F.lit("`"), F.lit("'")), F.lit("`"))


def inline_lines(values: Column) -> Column:
    return F.array_join(F.transform(values, inline_code), "\n")


def optional_code(value: Column, name: str) -> Column:
    """The value as code, or which setting is missing."""
    return F.when(F.trim(F.coalesce(value, F.lit(""))) == "", inline_code(F.lit(f"未配置 {name}"))).otherwise(inline_code(value))


def status_text(on: Column, on_text: str, off_text: str) -> Column:
    return F.when(on, f"<font color='green'>{on_text}</font>").otherwise(f"<font color='grey'>{off_text}</font>")
