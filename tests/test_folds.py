import base64

from quillstream.operators import client
from quillstream.operators.folds import LineBuffer, Memo, NowPlaying, RateLimit

ART, OTHER = (base64.b64encode(x).decode() for x in (b"one", b"two"))


def song(title="T", artist="A", **more):
    return {"title": title, "artist": artist} | more


def test_first_song_is_shown():
    assert NowPlaying().feed(False, song(artwork=ART))["title"] == "T"


def test_invalid_and_unlisted_players_stop():
    m = NowPlaying(("ok",))
    assert m.feed(False, song(bundle_id="ok"))["title"] == "T"
    assert m.feed(False, song(bundle_id="no")) == {} and m.current is None
    assert m.feed(False, song(title="")) == {}
    assert m.feed(False, song(bundle_id=None))["title"] == "T"


def test_a_new_song_waits_for_its_picture():
    m = NowPlaying()
    m.feed(False, song("one", artwork=ART))
    assert m.feed(False, song("two", artwork=ART)) is None  # still the old picture
    assert m.feed(True, {"elapsed": 1.0}) is None
    shown = m.feed(True, {"artwork": OTHER})
    assert (shown["title"], shown["artwork"]) == ("two", OTHER)
    assert m.feed(False, song("three", artwork=ART))["title"] == "three"  # another picture: no waiting
    assert m.feed(False, song("four")) is None
    assert m.feed(True, {"artwork": ""})["title"] == "four"  # it has none
    assert m.feed(False, song("five")) is None
    assert m.feed(True, {"artwork": "!"})["title"] == "five"
    assert m.feed(False, song("six")) is None
    assert m.feed(True, {"playing": False}) == song("six", album=None, playing=False, bundle_id=None, artwork=None)


def test_updates_of_the_same_song():
    m = NowPlaying()
    assert m.feed(True, {"playing": True}) is None and m.feed(True, {"artwork": ART}) is None
    m.feed(False, song())
    assert m.feed(False, song(playing=True))["playing"] is True
    assert m.feed(True, {"artwork": ART}) is None and m.current["artwork"] == ART
    assert m.feed(True, {"playing": False})["artwork"] == ART


def test_rate_limit_lets_one_more_through_and_forgets_refusals():
    limit = RateLimit(100, 2)
    assert [limit.allow(t) for t in (0, 1, 2, 3, 99, 100, 101, 102)] == [True, True, True, False, False, True, True, True]


def test_category_order(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("阅读代码", "development"), ("学习设计", "work"), (None, "other")], "label string, expected string")
    assert all(r[0] == r.expected for r in rows.select(client.category(F.col("label")), "expected").collect())


def test_a_full_memo_is_cleared():
    m = Memo(2)
    assert [m.knows(k) for k in "abacab"] == [False, False, True, False, False, False]


def test_lines_of_chunks():
    b = LineBuffer(5)
    assert b.feed("one") == [] and b.feed(" \n\n two\nth") == ["one", "two"] and b.feed("ree\n") == ["three"]
    assert b.feed("toolong") == [] and b.feed("x\ny\n") == ["x", "y"]  # the rest of a line that is too long is given up
