"""Deduplication and merge of an event stream by user (STR1 to STR4).

State is kept by user: the last acceptance of each key and the merged snapshot. Time is the arrival clock of the events,
so a replay decides as the first run did. Keys go after their time to live: with the next batch of their user, or if there is
none, once the stream's watermark on the arrival clock has passed it (LATE behind the latest arrival).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import schemas
from ..operators.state import MODULES, TTL_MS

STATE = T.StructType([T.StructField("keys", T.MapType(T.StringType(), T.LongType())), T.StructField("snapshot", T.StringType())])
LATE = "1 hour"
OUT = "user_id long, seq long, accepted boolean, has_music boolean, snapshot string"


def decided(events: DataFrame, now_ms: int, ttl_ms: int = TTL_MS) -> DataFrame:
    """A stream of events (user_id, seq, arrival_ms, idempotency_key and modules) → user_id, seq, accepted, event and
    snapshot (as it is after the event; null for duplicates)."""
    import json

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, text = state.get if state.exists else ({}, "{}")
        if state.hasTimedOut:
            state.update(({}, text))
            return
        known, merged = dict(known or {}), json.loads(text)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for r in rows.itertuples():
            name = r.idempotency_key or ""
            if name and name in known and r.arrival_ms - known[name] < ttl_ms:
                out.append((key[0], r.seq, False, False, None))
                continue
            if name:
                known[name] = int(r.arrival_ms)
            event = json.loads(r.event)
            times = [event[m].get("ts") or 0 for m in MODULES if event.get(m)]
            merged = merged | {m: event[m] for m in MODULES if event.get(m)} | {"lastUpdateTs": max(times, default=0) or now_ms}
            out.append((key[0], r.seq, True, bool(event.get("music")), json.dumps(merged)))
        now = max(rows.arrival_ms)
        state.update(({k: t for k, t in known.items() if now - t < ttl_ms}, json.dumps(merged)))
        state.setTimeoutTimestamp(max(int(now) + ttl_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "seq", "accepted", "has_music", "snapshot"])

    sent = events.select("user_id", "seq", "arrival_ms", "idempotency_key", F.to_json(F.struct(*MODULES)).alias("event"), F.timestamp_millis("arrival_ms").alias("arrival")).withWatermark("arrival", LATE)
    found = sent.groupBy("user_id").applyInPandasWithState(fold, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumn("snapshot", F.from_json("snapshot", schemas.SNAPSHOT))


def latest(batch: DataFrame) -> DataFrame:
    """(user_id, snapshot) after a micro-batch of decided(), for an upsert in foreachBatch."""
    return batch.where("accepted").groupBy("user_id").agg(F.max_by("snapshot", "seq").alias("snapshot"))


def subscribed(changes: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Changes (user_id, snapshot) for each subscriber (subscriber_id, user_id): a stream-static join (STR5, JN6)."""
    return changes.join(subscriptions, "user_id")


def bounded(deliveries: DataFrame, queue: int = 256, drain_ms: int = 10_000) -> DataFrame:
    """deliveries (subscriber_id, seq, arrival_ms) with `delivered`, by the rule of a bounded queue that is emptied every
    drain_ms: a message that finds it full is dropped, not an older one. For batches; subscribed() alone loses nothing."""
    of_queue = W.Window.partitionBy("subscriber_id", F.floor(F.col("arrival_ms") / drain_ms)).orderBy("seq")
    return deliveries.withColumn("delivered", F.row_number().over(of_queue) <= queue)
