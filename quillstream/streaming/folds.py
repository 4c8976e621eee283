"""The state machines of operators.folds on streams, their state kept by user (STR7, STR11)."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import NowPlaying, RateLimit

STATE = T.StructType([T.StructField("text", T.StringType())])


def now_playing(records: DataFrame, allowed: tuple[str, ...] = ()) -> DataFrame:
    """A stream of player records; the same columns in and out as operators.folds.now_playing."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = NowPlaying(allowed)
        if state.exists:
            machine.current, machine.pending = json.loads(state.get[0])
        rows = []
        for r in pd.concat(list(batches)).sort_values("seq").to_dict("records"):
            r = {k: None if v is None or v != v else v for k, v in r.items()}
            out = machine.feed(bool(r["diff"]), r)
            if out is not None:
                rows.append((key[0], r["seq"], not out, out.get("title"), out.get("artist"), out.get("playing"), out.get("artwork")))
        state.update((json.dumps([machine.current, machine.pending]),))
        yield pd.DataFrame(rows, columns=["user_id", "seq", "stopped", "title", "artist", "playing", "artwork"])

    out = "user_id long, seq long, stopped boolean, title string, artist string, playing boolean, artwork string"
    return records.groupBy("user_id").applyInPandasWithState(fold, out, STATE, "append", GroupStateTimeout.NoTimeout)


def rate_limited(calls: DataFrame, window_ms: int, most: int) -> DataFrame:
    """A stream of calls (user_id, seq, arrival_ms) with `allowed`. State holds the calls of one window at most."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        limit = RateLimit(window_ms, most)
        if state.exists:
            limit.calls = deque(json.loads(state.get[0]))
        rows = pd.concat(list(batches)).sort_values(["arrival_ms", "seq"])
        allowed = [limit.allow(int(t)) for t in rows.arrival_ms]
        state.update((json.dumps(list(limit.calls)),))
        yield rows.assign(allowed=allowed)[["user_id", "seq", "arrival_ms", "allowed"]]

    calls = calls.select("user_id", "seq", "arrival_ms")
    return calls.groupBy("user_id").applyInPandasWithState(fold, "user_id long, seq long, arrival_ms long, allowed boolean", STATE, "append", GroupStateTimeout.NoTimeout)
