import pytest

from quillstream.operators import stats


def history(spark, rows):
    songs = [(1, None if r is None else dict(zip(("title", "artist", "album"), r, strict=True))) for r in rows]
    return spark.createDataFrame([(u, {"music": m}) for u, m in songs], "user_id int, snapshot struct<music:struct<title:string,artist:string,album:string>>")


def test_null_rules(spark):
    rows = [("A", "X", "L"), ("A", "X", None), (None, "X", "L"), ("B", None, "L"), ("", "", ""), None]
    counted = {(r.kind, r.name): r["count"] for r in stats.counts(history(spark, rows)).collect()}
    assert counted == {("track", "A - X"): 2, ("artist", "X"): 3, ("album", "L - X"): 2, ("track", " - "): 1, ("artist", ""): 1, ("album", " - "): 1}


def test_names_that_read_alike_are_one(spark):
    counted = stats.counts(history(spark, [("A - B", "C", None), ("A", "B - C", None)]))
    assert stats.summary(counted).first().asDict() == {"plays": 2, "unique_tracks": 1}


def test_no_rows(spark):
    counted = stats.counts(history(spark, [None]))
    assert stats.summary(counted).first().asDict() == {"plays": 0, "unique_tracks": 0}
    r = stats.response(counted, 3, 0, 1).first()
    assert (r.top_artists, r.top_tracks, r.top_albums, r.cached) == ([], [], [], False)


def test_ties_go_by_name_and_the_list_ends_at_n(spark):
    counted = stats.counts(history(spark, [("t", x, None) for x in "cabcab"] + [("t", "d", None)]))
    assert [r.name for r in stats.top_of(counted, stats.ARTIST, 3).collect()] == ["a", "b", "c"]
    assert [(r.rank, r.name) for r in stats.top(counted, 2, kinds=(stats.ARTIST,)).orderBy("rank").collect()] == [(1, "a"), (2, "b")]


@pytest.mark.parametrize(("asked", "n"), [(-1, 20), (0, 20), (None, 20), (3, 3), (20, 20), (50, 20)])
def test_top_n(asked, n):
    assert stats.top_n(asked) == n


def test_one_scan_and_one_large_shuffle(spark):
    plan = stats.counts(history(spark, [("A", "X", "L")]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
