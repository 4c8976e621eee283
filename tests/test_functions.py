import base64
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from quillstream import schemas
from quillstream.functions import commands, covers, crypto, links, templates
from quillstream.functions import formatting as fmt

NOW = datetime(2026, 6, 1, 10, 20, 30, tzinfo=UTC)
FULL = {"system": {"batteryPct": 0.82, "charging": True, "cpuPct": 0.37, "memoryPct": 0.62}, "music": {"artist": "Artist", "title": "Title", "album": "Album"}, "activity": {"label": "在研发"}}


def rendered(spark, template, snapshot):
    types = {"system": schemas.SYSTEM, "music": schemas.MUSIC, "activity": schemas.ACTIVITY}
    whole = None if snapshot is None else tuple(None if snapshot.get(m) is None else tuple(snapshot[m].get(f) for f in types[m].names) for m in ("system", "music", "activity")) + (0,)
    df = spark.createDataFrame([(template, whole)], schemas._struct(t=schemas.S, s=schemas.SNAPSHOT))
    return df.select(templates.render(templates.or_default(F.col("t")), F.col("s"), NOW)).first()[0]


ALL = "{artist}-{title}/{album}/{activityLabel}/{batteryPct}/{batteryPctRounded}/{cpuPct}/{cpuPctRounded}/{memoryPct}/{memoryPctRounded}"
CHARGING = "{charging?'充电中':'未充电'}|{charging?'充电中':'未在充电'}|{charging?'⚡':''}"


@pytest.mark.parametrize(
    ("template", "snapshot", "expected"),
    [
        ("", None, "正在听-未在播放"),
        (ALL, FULL, "Artist-Title/Album/在研发/0.82/82%/0.37/37%/0.62/62%"),
        ("{dateYMD}|{nowLocal}|{nowISO}", None, "2026-06-01|2026-06-01 10:20:30|2026-06-01T10:20:30Z"),
        (CHARGING, FULL, "充电中|充电中|⚡"),
        (CHARGING, {"system": {"charging": False}}, "未充电|未在充电|"),
        (CHARGING, {"system": {}}, "未充电|未在充电|"),
        (CHARGING, None, "未充电|未在充电|"),
        ("{artist}|{title}|{album}|{batteryPct}|{batteryPctRounded}|{activityLabel}", {}, "|未在播放||||"),
        ("{title}", {"music": {"artist": "x"}}, ""),
        ("{title}", {"music": {"title": "{dateYMD}"}}, "2026-06-01"),
        ("{playing?'a':'b'}", FULL, "{playing?'a':'b'}"),
    ],
)
def test_render(spark, template, snapshot, expected):
    assert rendered(spark, template, snapshot) == expected


def test_every_placeholder_is_filled_in(spark):
    for key, *_ in templates.VARIABLES:
        assert "{" not in rendered(spark, "{" + key + "}", FULL)


@pytest.mark.parametrize(("x", "text"), [(0.125, "0.12"), (0.135, "0.14"), (0.145, "0.14"), (0.155, "0.15"), (0.285, "0.28"), (0.005, "0.01"), (1.0, "1.00"), (0.0, "0.00"), (None, None)])
def test_fixed(spark, x, text):
    assert spark.createDataFrame([(x,)], "x double").select(fmt.fixed(F.col("x"), 2)).first()[0] == text


HOST = "https://page.test"


@pytest.mark.parametrize(
    ("url", "key", "template", "expected"),
    [
        (HOST + "/s/k7f2?r=ignored&m=%E6%92%AD%E6%94%BE%EF%BC%9A%7Bartist%7D", "", "", ("OK", "k7f2", "播放：{artist}")),
        (HOST + "/s/of-link?m=of+link", "of field", "of field too", ("OK", "of-link", "of link")),
        ("", "\tof field ", "{album}!", ("OK", "of field", "{album}!")),
        ("", "", "", ("MISSING", None, None)),
        (None, None, None, ("MISSING", None, None)),
        ("//:no", "", "", ("INVALID", None, None)),
        (HOST + "/status/k7f2?m=x", "", "", ("INVALID", None, None)),
        (HOST + "/s/k7f2/more?m=x", "", "", ("INVALID", None, None)),
        (HOST + "/go?to=https%3A%2F%2Fpage.test%2Fs%2Fk7f2", "", "", ("INVALID", None, None)),
        (HOST + "/s/a+b%20c", "", "", ("OK", "a+b c", "")),
        (HOST + "/s/%zz", "", "", ("INVALID", None, None)),
    ],
)
def test_share_urls(spark, url, key, template, expected):
    df = spark.createDataFrame([(url, key, template)], "u string, k string, t string")
    assert tuple(df.select(links.parse_share_url(F.col("u"), F.col("k"), F.col("t"))).first()[0]) == expected


def test_keys_and_links(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(links.with_key(F.lit("https://d/?k={SharingKey}"), F.lit("abc"))) == "https://d/?k=abc"
    assert one(links.with_key(F.lit("  "), F.lit("abc"))) == ""
    assert one(links.report_url(F.lit("https://e//"))) == "https://e/api/v1/state/report"
    assert one(commands.optional_code(F.lit(" "), "X")) == "`未配置 X`"
    assert one(commands.inline_lines(F.array(F.lit("a`b"), F.lit("c")))) == "`a'b`\n`c`"
    assert tuple(one(links.block_link(F.lit(" https://h.example:1/status/k/x ")))) == ("https://h.example:1", "k")
    assert one(links.block_link(F.lit("https://h.example/"))) is None
    assert one(crypto.decode_id(F.lit("no id"), b"0123456789abcdef", b"0123456789abcdef")) is None


@pytest.mark.parametrize(
    ("text", "action", "params", "verdict"),
    [
        ("/public on", "public", ["on"], "ok"),
        (" /STAT  off ", "stat", ["off"], "ok"),
        ("/stat", "stat", [], "bad_params"),
        ("/rotate secret-key", "rotate", ["secret-key"], "ok"),
        ("轮转个人主页", "rotate", ["sharing-key"], "ok"),
        ("/help me", "help", ["me"], "bad_params"),
        ("/info x", "info", ["x"], "ok"),
        ("/x", "x", [], "unknown"),
        ("帮 助", "unknown", [], "unknown"),
    ],
)
def test_commands(spark, text, action, params, verdict):
    df = spark.createDataFrame([(text,)], "t string").select(commands.parse(F.col("t")).alias("c"))
    row = df.select("c", commands.validate(F.col("c")).alias("v")).first()
    assert (row.c.action, row.c.params, row.v) == (action, params, verdict)


def test_encrypted_ids(spark):
    """AES-128 in CBC mode: the first two blocks of the public test vector (NIST SP 800-38A, F.2.1), and back."""
    key, iv = bytes.fromhex("2b7e151628aed2a6abf7158809cf4f3c"), bytes(range(16))
    plain = bytes.fromhex("6bc1bee22e409f96e93d7e117393172aae2d8a571e03ac9c9eb76fac45af8e51")
    df = spark.createDataFrame([(bytearray(plain), "ou_1234", "é")], "p binary, a string, b string")
    one = lambda c: df.select(c).first()[0]
    code = one(crypto.encode_id(F.col("p"), key, iv))
    assert base64.urlsafe_b64decode(code)[:32].hex() == "7649abac8119b246cee98e9b12e9197d5086cb9b507219ee95db113a917678b2"
    for c in ("a", "b"):
        assert one(crypto.decode_id(crypto.encode_id(F.col(c), key, iv), key, iv)) == one(F.col(c))
    assert one(crypto.decode_id(crypto.encode_id(F.col("a"), key, iv), iv, key)) is None


def test_blank_command(spark):
    df = spark.createDataFrame([("  ",), (None,)], "t string").select(commands.parse(F.col("t")).alias("c"))
    assert [r.c for r in df.collect()] == [None, None]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("data:image/png;base64,aGk=", (200, "image/png", b"hi")),
        ("data:x,aGk=", (200, "application/octet-stream", b"hi")),
        ("data:image/png;base64", (400, None, None)),
        ("aGk=", (200, "image/jpeg", b"hi")),
        ("R0lGODg=", (200, "image/gif", b"GIF88"[:5])),
        ("not base64!", (400, None, None)),
        (None, (400, None, None)),
    ],
)
def test_uploads(spark, text, expected):
    r = spark.createDataFrame([(text,)], "t string").select(covers.parse_upload(F.col("t"))).first()[0]
    assert (r.status, r.content_type, None if r.data is None else bytes(r.data)) == expected
