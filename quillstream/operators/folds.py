"""Ordered folds that need a state machine: the now-playing stream, the rate limit, a client's memo, lines of chunks (STR7, STR11, CCH3, SRC9).

The machines are plain Python and serve batch (ordered Arrow batches) and streaming alike.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

LONGEST_LINE = 10_000_000
SONG = ("title", "artist", "album", "playing", "bundle_id", "artwork")


class NowPlaying:
    """Feeds on full and differential records of a player and says what to report.

    feed() returns None for nothing to report, or a dict; an empty dict means that nothing is playing.
    """

    def __init__(self, allowed: tuple[str, ...] = ()):
        self.allowed = allowed
        self.current: dict | None = None
        self.pending: dict | None = None

    def _show(self, song: dict) -> dict:
        self.current, self.pending = song, None
        return dict(song)

    def feed(self, diff: bool, record: dict) -> dict | None:
        return self._diff(record) if diff else self._full(record)

    def _full(self, r: dict) -> dict | None:
        bundle = r.get("bundle_id")
        if not r.get("title") or not r.get("artist") or (bundle is not None and self.allowed and bundle not in self.allowed):
            self.current = self.pending = None
            return {}
        song = {k: r.get(k) for k in SONG} | {"artwork": _art(r.get("artwork"))}
        old = self.current
        if old is None or (old["title"], old["artist"]) == (song["title"], song["artist"]):
            return self._show(song)
        if song["artwork"] and song["artwork"] != old["artwork"]:
            return self._show(song)
        self.pending = song  # no picture yet, or still the one of the song before
        return None

    def _diff(self, r: dict) -> dict | None:
        art, playing = r.get("artwork"), r.get("playing")
        if art is not None:
            picture = _art(art)
            if self.pending is not None:
                return self._show(self.pending | ({"artwork": picture} if picture else {}))
            if picture and self.current is not None:
                self.current = self.current | {"artwork": picture}
            return None
        if playing is not None:
            song = self.pending or self.current
            return None if song is None else self._show(song | {"playing": playing})
        return None


def _art(text: str | None) -> str | None:
    """The text if it is base64 of something; null otherwise."""
    if not text:
        return None
    try:
        base64.b64decode(text, validate=True)
    except ValueError:
        return None
    return text


class RateLimit:
    """A sliding window that lets max + 1 calls through: a call counts unless more than max came before it."""

    def __init__(self, window_ms: int, most: int):
        self.window_ms, self.most, self.calls = window_ms, most, deque()

    def allow(self, now_ms: int) -> bool:
        while self.calls and self.calls[0] <= now_ms - self.window_ms:
            self.calls.popleft()
        if len(self.calls) > self.most:
            return False
        self.calls.append(now_ms)
        return True


class Memo:
    """Keys that were met, cleared wholesale when it is full (CCH3)."""

    def __init__(self, most: int):
        self.most, self.keys = most, set()

    def knows(self, key: str) -> bool:
        """Whether the key is there; from now on it is."""
        if key in self.keys:
            return True
        if len(self.keys) >= self.most:
            self.keys.clear()
        self.keys.add(key)
        return False


class LineBuffer:
    """Chunks of text in, whole lines out (SRC9): without white space around them, blank ones dropped. A rest that is
    longer than `longest` characters is given up."""

    def __init__(self, longest: int = LONGEST_LINE):
        self.longest, self.rest, self.size = longest, [], 0

    def feed(self, chunk: str) -> list[str]:
        first, *more = chunk.split("\n")
        self.rest.append(first)
        self.size += len(first)
        lines = []
        for part in more:
            lines.append("".join(self.rest).strip())
            self.rest, self.size = [part], len(part)
        if self.size > self.longest:
            self.rest, self.size = [], 0
        return [x for x in lines if x]


ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}


def in_order(rows: DataFrame, by: str, order: tuple[str, ...], fields: tuple[str, ...], machine: Callable, step: Callable, result: str) -> DataFrame:
    """What `step(state, by, *order, *fields)` yields (tuples of `result`) for each row, in order, with a machine() for each `by`.

    Rows stream through in Arrow batches; of a key only its machine is held.
    """
    names = (by, *order, *fields)
    columns = [x.split() for x in result.split(", ")]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            out: list[list] = [[] for _ in columns]
            for values in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if state is None or values[0] != current:
                    current, state = values[0], machine()
                for row in step(state, *values):
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, ARROW[t]) for c, (_, t) in zip(out, columns, strict=True)], [n for n, _ in columns])

    return rows.select(*names).repartition(by).sortWithinPartitions(by, *order).mapInArrow(fold, result)


def now_playing(records: DataFrame, allowed: tuple[str, ...] = ()) -> DataFrame:
    """records (user_id, seq, diff, title, artist, album, playing, bundle_id, artwork) → what is reported after
    each one that reports: user_id, seq, stopped, title, artist, playing, artwork."""

    def step(m: NowPlaying, user: int, seq: int, diff: bool, *fields) -> Iterator[tuple]:
        out = m.feed(bool(diff), dict(zip(SONG, fields, strict=True)))
        if out is not None:
            yield user, seq, not out, out.get("title"), out.get("artist"), out.get("playing"), out.get("artwork")

    result = "user_id long, seq long, stopped boolean, title string, artist string, playing boolean, artwork string"
    return in_order(records, "user_id", ("seq",), ("diff", *SONG), lambda: NowPlaying(allowed), step, result)


def rate_limited(calls: DataFrame, window_ms: int, most: int) -> DataFrame:
    """calls (user_id, seq, arrival_ms) with `allowed`."""

    def step(m: RateLimit, user: int, at: int, seq: int) -> Iterator[tuple]:
        yield user, seq, at, m.allow(at)

    return in_order(calls, "user_id", ("arrival_ms", "seq"), (), lambda: RateLimit(window_ms, most), step, "user_id long, seq long, arrival_ms long, allowed boolean")


def remembered(requests: DataFrame, most: int = 100) -> DataFrame:
    """requests (user_id, seq, key) with `known`: whether the client needn't ask for the key again."""

    def step(m: Memo, user: int, seq: int, key: str) -> Iterator[tuple]:
        yield user, seq, key, m.knows(key)

    return in_order(requests, "user_id", ("seq",), ("key",), lambda: Memo(most), step, "user_id long, seq long, key string, known boolean")


def lines_of_chunks(chunks: DataFrame, longest: int = LONGEST_LINE) -> DataFrame:
    """chunks (user_id, seq, chunk) of each user's stream → value, a whole line, and the chunk that ends it."""

    def step(m: LineBuffer, user: int, seq: int, chunk: str | None) -> Iterator[tuple]:
        for line in m.feed(chunk or ""):
            yield user, seq, line

    return in_order(chunks, "user_id", ("seq",), ("chunk",), lambda: LineBuffer(longest), step, "user_id long, seq long, value string")
