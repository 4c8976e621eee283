import pytest

from quillstream import schemas
from quillstream.operators import access, retention, state

EVENTS = "seq long, arrival_ms long, user_id long, idempotency_key string, " + ", ".join(f"{m} {t.simpleString()}" for m, t in (("system", schemas.SYSTEM), ("music", schemas.MUSIC), ("activity", schemas.ACTIVITY)))


def events(spark, rows):
    keys = ("seq", "arrival_ms", "user_id", "idempotency_key", "system", "music", "activity")
    return spark.createDataFrame([tuple(r.get(k) for k in keys) for r in rows], EVENTS)


def test_time_to_live_runs_from_acceptance(spark):
    times = [0, 10, 29, 30, 31, 60, 65]
    rows = [{"seq": i, "arrival_ms": t * 1000, "user_id": 1, "idempotency_key": "k"} for i, t in enumerate(times)]
    rows += [{"seq": 10, "arrival_ms": 1000, "user_id": 2, "idempotency_key": "k"}]
    rows += [{"seq": 20 + i, "arrival_ms": 1000, "user_id": 1, "idempotency_key": k} for i, k in enumerate((None, None, "", ""))]
    accepted = sorted(r.seq for r in state.deduplicated(events(spark, rows)).where("accepted").collect())
    assert accepted == [0, 3, 5, 10, 20, 21, 22, 23]


SYSTEM = {"batteryPct": 0.8, "charging": True, "cpuPct": 0.5, "memoryPct": 0.6, "ts": 1000}
MUSIC = {"title": "Old", "artist": "A", "album": "L", "coverHash": "h", "ts": 1000}


@pytest.mark.parametrize(
    ("old", "new", "expected"),
    [
        ({"system": SYSTEM}, {"system": {"batteryPct": 0.7, "ts": 2000}}, {"system": (0.7, None)}),
        ({"music": MUSIC}, {"music": {"title": "New", "artist": "B", "ts": 2000}}, {"music": ("New", None)}),
        ({"music": MUSIC}, {}, {"music": ("Old", "L")}),
        ({}, {"music": {"title": "New", "ts": 2000}}, {"music": ("New", None)}),
        ({"system": SYSTEM, "music": MUSIC}, {"music": {"title": "New", "ts": 500}}, {"system": (0.8, 0.5), "music": ("New", None)}),
    ],
)
def test_a_module_replaces_the_old_one_whole(spark, old, new, expected):
    e = events(spark, [{"seq": 1, "user_id": 1} | old, {"seq": 2, "user_id": 1} | new])
    s = state.merge_latest(e, 9000).first().snapshot
    last = state.merge_trace(e, 9000).where("seq = 2").first().snapshot
    assert s == last
    found = {}
    if s.system:
        found["system"] = (s.system.batteryPct, s.system.cpuPct)
    if s.music:
        found["music"] = (s.music.title, s.music.album)
    assert found == expected
    # The time is that of the last event, even an earlier one; without any it is now.
    assert s.lastUpdateTs == max([m["ts"] for m in new.values()], default=9000)


def test_history_holds_the_event_and_not_the_merge(spark):
    settings = spark.createDataFrame([(1, True, True), (2, True, False)], "user_id long, publicEnabled boolean, authorizedMusicStats boolean")
    rows = [{"seq": 1, "user_id": 1, "system": SYSTEM}, {"seq": 2, "user_id": 1, "music": MUSIC}, {"seq": 3, "user_id": 2, "music": MUSIC}, {"seq": 4, "user_id": 3, "music": MUSIC}]
    e = events(spark, rows).withColumnRenamed("arrival_ms", "recorded_at")
    found = state.history_rows(e, settings, 1).collect()
    assert [(r.seq, r.snapshot.system) for r in found] == [(2, None)]
    assert state.merge_latest(events(spark, rows), 1).count() == 3


def test_missing_settings_mean_different_things(spark):
    users = spark.createDataFrame([(1, "s1", 1), (2, "s2", 1), (3, "s3", 0)], "id long, sharing_key string, status int")
    settings = spark.createDataFrame([(2, True, True), (3, True, True)], "user_id long, publicEnabled boolean, authorizedMusicStats boolean")
    u = access.with_settings(users, settings)
    asked = access.by_key(spark.createDataFrame([(i, k) for i, k in enumerate(("s1", "s2", "s3", "x", "", None))], "request_id int, key string"), u, "sharing_key")
    from pyspark.sql import functions as F

    c = F.col
    rows = asked.select("request_id", access.sharing_code(c("key"), c("id"), c("status"), c("publicEnabled")).alias("code"), access.socket_code(c("key"), c("id"), c("status"), c("publicEnabled")).alias("ws"), access.is_public(c("publicEnabled")).alias("public"), access.may_count(c("authorizedMusicStats")).alias("stats")).orderBy("request_id").collect()
    assert [r.code for r in rows] == [403, 0, 403, 404, 400, 400]
    assert [r.ws and r.ws.error_code for r in rows] == ["UNAUTHORIZED", None, "UNAUTHORIZED", "UNAUTHORIZED", "INVALID_REQUEST", "INVALID_REQUEST"]
    assert (rows[0].public, rows[0].stats) == (True, False)


def test_revoked_users_lose_their_history(spark):
    history = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    of = lambda *x: spark.createDataFrame(list(x), "user_id long, authorizedMusicStats boolean")
    kept = retention.keep_authorized_history(history, of((1, True), (2, True), (3, False)), of((1, False), (2, True), (3, False)))
    assert sorted(r.user_id for r in kept.collect()) == [2, 3]


def test_rows_without_a_time_are_never_deleted(spark):
    from datetime import UTC, datetime

    rows = spark.createDataFrame([(1, None), (2, datetime(2023, 12, 31, 15, 59, 59)), (3, datetime(2023, 12, 31, 16)), (4, datetime(2022, 12, 31, 15)), (5, datetime(2022, 12, 31, 16))], "id int, recorded_at timestamp_ntz")
    assert sorted(r.id for r in retention.keep_history(rows, 2024).collect()) == [1, 3, 4]
    assert sorted(r.id for r in retention.keep_history(rows, 2024, "UTC").collect()) == [1, 4, 5]
    named = lambda c: rows.withColumnRenamed("recorded_at", c)
    assert sorted(r.id for r in retention.keep_current(named("updated_at"), datetime(2024, 1, 1, 15, 59, 59, tzinfo=UTC)).collect()) == [1, 2, 3]
    assert sorted(r.id for r in retention.keep_covers(named("created_at"), datetime(2023, 12, 31, 16, tzinfo=UTC)).collect()) == [1, 3]
    plan = retention.keep_history(rows, 2024)._jdf.queryExecution().optimizedPlan().toString()
    assert "year(" not in plan.lower()


def test_firsts_by_a_time_to_live_of_their_own(spark):
    """Brute force over several keys, times to live and ties; other columns pass through untouched."""
    import random

    draw = random.Random(3)
    rows = [(i, draw.randint(0, 200), draw.choice("ab"), draw.choice([5, 20]), {"x": i}) for i in range(400)]
    rows = [(i, t, k, 5 if k == "a" else 20, d) for i, t, k, _, d in rows]
    df = spark.createDataFrame(rows, "n int, t long, key string, ttl long, extra map<string,int>").repartition(5)
    found = {r.n: (r["first"], r.extra) for r in state.first_in_time(df, ("key",), "t", "n", "ttl", "first").collect()}
    until = {}
    for i, t, k, ttl, d in sorted(rows, key=lambda r: (r[2], r[1], r[0])):
        first = k not in until or t >= until[k]
        if first:
            until[k] = t + ttl
        assert found[i] == (first, d)
