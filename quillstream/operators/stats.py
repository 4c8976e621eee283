"""Listening statistics (AGG1 to AGG6, TOP1 to TOP5): one scan and one shuffle for artists, tracks and albums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .state import first_in_time
from .windows import Window, ntz

MOST = 20
TRACK, ARTIST, ALBUM = "track", "artist", "album"


def top_n(asked: int | None) -> int:
    """0, negative or none means 20, and 20 is the most."""
    return MOST if not asked or asked <= 0 else min(asked, MOST)


def _both(a: Column, b: Column) -> Column:
    """`a - b`, null if either is. Equal strings are equal names, whatever they were made of."""
    return F.concat(a, F.lit(" - "), b)


def names(music: str = "snapshot.music") -> Column:
    """The (kind, name) pairs that a history row counts for."""
    title, artist, album = (F.col(f"{music}.{c}") for c in ("title", "artist", "album"))
    pairs = ((TRACK, _both(title, artist)), (ARTIST, artist), (ALBUM, _both(album, artist)))
    return F.filter(F.array(*(F.struct(F.lit(k).alias("kind"), n.alias("name")) for k, n in pairs)), lambda x: x["name"].isNotNull())


def counts(history: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., kind, name, count). Rows without music count for nothing."""
    rows = history.where(F.col("snapshot.music").isNotNull()).select(*by, F.explode(names()).alias("x"))
    return rows.groupBy(*by, "x.kind", "x.name").agg(F.count("*").alias("count"))


def _totals() -> list[Column]:
    track = F.col("kind") == TRACK
    return [F.coalesce(F.sum(F.when(track, F.col("count"))), F.lit(0)).cast("long").alias("plays"), F.count(F.when(track, 1)).alias("unique_tracks")]


def summary(counted: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., plays, unique_tracks). Plays are rows with both title and artist."""
    return counted.groupBy(*by).agg(*_totals())


def top(counted: DataFrame, n: int | None, by: tuple[str, ...] = (), kinds: tuple[str, ...] = (TRACK, ARTIST, ALBUM)) -> DataFrame:
    """(by..., kind, rank, name, count): the most frequent names of each kind, ties by name."""
    ranked = W.Window.partitionBy(*by, "kind").orderBy(F.desc("count"), "name")
    kept = counted.where(F.col("kind").isin(*kinds)) if len(kinds) < 3 else counted
    return kept.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top_n(n)).select(*by, "kind", "rank", "name", "count")


def top_of(counted: DataFrame, kind: str, n: int | None) -> DataFrame:
    """(name, count) of one kind, without a window."""
    return counted.where(F.col("kind") == kind).orderBy(F.desc("count"), "name").limit(top_n(n)).select("name", "count")


CHOICES = (3, 5, 10, 20)


def choices(history: DataFrame, windows: dict[int, Window], of: tuple[int, ...] = CHOICES) -> DataFrame:
    """(type, n, kind, rank, name, count) for every window type and length of list: one scan, one shuffle of counts."""
    t = F.col("recorded_at")
    inside = F.filter(F.array(*(F.when((t >= ntz(w.start)) & (t <= ntz(w.end)), F.lit(int(k))) for k, w in windows.items())), lambda x: x.isNotNull())
    rows = history.where((t >= ntz(min(w.start for w in windows.values()))) & (t <= ntz(max(w.end for w in windows.values()))))
    each = rows.select("snapshot", F.explode(inside).alias("type"))
    ranked = top(counts(each, ("type",)), max(of), ("type",))
    return ranked.select("type", F.explode(F.array(*map(F.lit, of))).alias("n"), "kind", "rank", "name", "count").where("rank <= n")


def cache_hits(requests: DataFrame, ttl_seconds: Column) -> DataFrame:
    """requests (user_id, cache_key, at_ms, request_id) with `cached`: whether the answer was stored by an earlier one whose
    time to live isn't over. Hits don't store the answer anew; a stored answer has MOST entries, so that any length fits."""
    found = first_in_time(requests.withColumn("_ttl_ms", ttl_seconds * 1000), ("user_id", "cache_key"), "at_ms", "request_id", "_ttl_ms", "_computed")
    return found.withColumn("cached", ~F.col("_computed")).drop("_ttl_ms", "_computed")


def response(counted: DataFrame, n: int | None, from_ms: int, to_ms: int) -> DataFrame:
    """One row: what the statistics query answers (`cached` where it is computed; see cache_hits)."""
    by_kind = W.Window.partitionBy("kind").orderBy(F.desc("count"), "name")
    ranked = counted.withColumn("rank", F.row_number().over(by_kind))
    item = F.struct(F.col("rank"), F.col("name"), F.col("count"))
    kept = lambda k: F.sort_array(F.collect_list(F.when((F.col("kind") == k) & (F.col("rank") <= top_n(n)), item)))
    lists = [F.transform(kept(k), lambda x: F.struct(x["name"].alias("name"), x["count"].alias("count"))).alias(f"top_{k}s") for k in (ARTIST, TRACK, ALBUM)]
    return ranked.groupBy().agg(*_totals(), *lists).withColumns({"from_ms": F.lit(from_ms), "to_ms": F.lit(to_ms), "cached": F.lit(False)})
