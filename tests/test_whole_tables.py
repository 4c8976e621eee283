"""Queries answer every row of their tables, those that are hard to state in SQL too."""

import math
import re
from decimal import ROUND_HALF_UP, Decimal

from quillstream.functions import commands
from quillstream.plans import catalogue, texts
from quillstream.sources import adapter


def parsed(text):
    """commands.parse by plain Python."""
    t = re.sub(r"^[ \t\n\x0b\f\r ]+|[ \t\n\x0b\f\r ]+$", "", text)
    if not t:
        return None, None
    line = t.lower() if t.startswith("/") else commands.PHRASES.get(t, "unknown")
    action, *params = re.split(r"[ \t\n\x0b\f\r ]+", line)
    return action.removeprefix("/"), " ".join(params)


def test_every_message_is_parsed(spark, sf_dir, duck):
    rows = {(r.conv_id, r.turn): (r.action, r.params) for r in catalogue.queries()["parse_command"](spark, sf_dir).collect()}
    verdicts = {(r.conv_id, r.turn): r.verdict for r in catalogue.queries()["validate_command"](spark, sf_dir).collect()}
    n = len(texts._LINES)
    messages = duck.execute("select conv_id, turn, text from conversations").fetchall()
    assert len(rows) == len(verdicts) == len(messages) and any(i % (2 * n) >= n for i, _, _ in messages)
    for i, turn, text in messages:
        own = texts._LINES[i % (2 * n)] if i % (2 * n) < n else text
        assert rows[i, turn] == parsed(own)
        if i % (2 * n) < n:
            assert verdicts[i, turn] == texts._VALID[i % (2 * n)]


def test_every_page_link_is_parsed(spark, sf_dir, duck):
    rows = {r.page_id: (r.base_url, r.sharing_key) for r in catalogue.queries()["parse_share_url_mini"](spark, sf_dir).collect()}
    pages = duck.execute("select page_id, url from pages").fetchall()
    assert rows.keys() == {i for i, _ in pages}
    for i, url in pages:
        if i % 8 in (2, 3):
            assert rows[i] == (None, None)
        if i % 8 == 0:
            scheme, host, path = re.match(r"(\w+)://([^/?#]+)([^?#]*)", url).groups()
            parts = [x for x in path.split("/") if x]
            key = parts[1] if len(parts) > 1 and parts[0] in ("s", "status") else parts[0] if len(parts) == 1 else None
            assert rows[i] == (None if key is None else f"{scheme}://{host}".lower(), key)


def test_every_event_is_formatted_and_validated(spark, sf_dir):
    queries = catalogue.queries()
    text = {n: {r[0]: r[1] for r in queries[n](spark, sf_dir).collect()} for n in ("config_validation", "count_format", "relative_time")}
    rows = adapter.events(spark, sf_dir).select("seq", "k", "system.ts").collect()
    assert all(x.keys() == {r.seq for r in rows} for x in text.values())
    for r in rows:
        interval = r.k * 4 if r.k * 4 > 300 else r.k % 40
        error = "服务器地址不能为空" if r.k % 4 == 0 else "服务器地址格式无效" if r.k % 4 == 1 else "系统轮询间隔必须在 5-300 秒之间" if not 5 <= interval <= 300 else "活动轮询间隔必须在 5-60 秒之间" if r.k % 3 == 0 else None
        assert text["config_validation"][r.seq] == error
        assert text["count_format"][r.seq] == (str(r.seq) if r.seq < 1000 else f"{Decimal(r.seq / 1000).quantize(Decimal('0.1'), ROUND_HALF_UP)}k")
        seconds = None if not r.ts else math.floor((adapter.NOW_MS - r.ts) / 1000)
        age = "暂无数据" if seconds is None else next((f"{seconds // size}{unit}" for size, unit in ((86400, "天前"), (3600, "小时前"), (60, "分钟前")) if seconds >= size), "刚刚")
        assert text["relative_time"][r.seq] == age


def test_every_delivery_is_returned(spark, sf_dir, duck):
    found = sorted((r.seq, r.subscriber_id, r.user_id) for r in catalogue.queries()["fan_out"](spark, sf_dir).collect())
    events = duck.execute("select event_id, user_id from events").fetchall()
    assert found == sorted((seq, 10 * user + n, user) for seq, user in events for n in range(user % 4))
    assert len(found) > len({seq for seq, _, _ in found})


def test_no_text_completes_the_first_bytes_of_a_format(spark, tmp_path):
    import duckdb

    c = duckdb.connect()
    c.execute("create table documents as select i as doc_id, t as text from range(21) r(i), (values ('For'), ('GIF89a'), ('F8'), (''), (null)) v(t)")
    c.execute(f"copy documents to '{tmp_path}/documents.parquet' (format parquet)")
    rows = catalogue.queries()["mime_sniff"](spark, str(tmp_path)).collect()
    expected = c.execute(catalogue.oracle_sql()["mime_sniff"]).fetchall()
    assert sorted(tuple(r) for r in rows) == sorted(expected)
