"""Ingestion as batch folds over arrival order (STR1 to STR4, AGG9, AGG12, JN2, SNK1, SNK2).

Order is always `seq` or the arrival clock, never the modules' own times.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from . import access

TTL_MS = 30_000
MODULES = ("system", "music", "activity")


def last_update_ts(now_ms: int) -> Column:
    """The latest module time of an event; now if there is none."""
    latest = F.greatest(*(F.coalesce(F.col(f"{m}.ts"), F.lit(0).cast("long")) for m in MODULES))
    return F.when(latest == 0, F.lit(now_ms).cast("long")).otherwise(latest)


def with_snapshot(events: DataFrame, now_ms: int) -> DataFrame:
    """events with `snapshot`, what one event alone says."""
    return events.withColumn("snapshot", F.struct(*MODULES, last_update_ts(now_ms).alias("lastUpdateTs")))


def first_in_time(rows: DataFrame, keys: tuple[str, ...], time: str, order: str, ttl: str, out: str, keyed: Column | None = None) -> DataFrame:
    """rows with boolean `out`: whether a row is the first of its keys for `ttl` (a column, as `time`) since the last such one.

    Others don't extend the time; where `keyed` is false a row is always a first. Rows stream through in Arrow batches, in the
    order of keys, time and `order`, whole and untouched: one exchange, and of a key only the last first time is held.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = F.lit(True) if keyed is None else keyed
    # Rows without a key need no order: they are dealt anywhere.
    d = rows.select(F.struct("*").alias("row"), keyed.alias("_keyed"), *(F.col(k).cast("string").alias(n) for k, n in zip(keys, names, strict=True)), F.col(time).cast("long").alias("_time"), F.col(ttl).cast("long").alias("_ttl"), F.col(order).alias("_order"))
    d = d.repartition(*names, F.when(~F.col("_keyed"), F.col("_order"))).sortWithinPartitions(*names, "_time", "_order")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, until = None, None  # the key of the row before, and until when it counts
        for batch in batches:
            of = {n: batch.column(n) for n in ("_keyed", *names, "_time", "_ttl")}
            marks = []
            for is_keyed, t, ttl_ms, *key in zip(*(of[n].to_pylist() for n in ("_keyed", "_time", "_ttl", *names)), strict=True):
                first = not is_keyed or key != before or until is None or t is None or t >= until
                if is_keyed:
                    if first:
                        until = None if t is None else t + ttl_ms
                    before = key
                marks.append(first)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(marks, pa.bool_())], ["row", "first"])

    schema = T.StructType([T.StructField("row", d.schema["row"].dataType), T.StructField("first", T.BooleanType())])
    return d.mapInArrow(decide, schema).select("row.*", F.col("first").alias(out))


def deduplicated(events: DataFrame, ttl_ms: int = TTL_MS) -> DataFrame:
    """events with `accepted`. A key counts for a user for ttl_ms from its last acceptance, which duplicates
    don't extend; events without a key (null or empty) are always accepted."""
    keyed = F.coalesce(F.col("idempotency_key"), F.lit("")) != ""
    found = first_in_time(events.withColumn("_ttl_ms", F.lit(ttl_ms)), ("user_id", "idempotency_key"), "arrival_ms", "seq", "_ttl_ms", "accepted", keyed)
    return found.drop("_ttl_ms")


def counters(decided: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """accepted and deduped events."""
    return decided.groupBy(*by).agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("deduped"))


def merge_latest(events: DataFrame, now_ms: int) -> DataFrame:
    """(user_id, snapshot): each module from the last event that has it; the time from the last event.

    Plain aggregates, so that most of the work is done before the shuffle.
    """
    e = events.withColumn("_ts", last_update_ts(now_ms))
    latest = [F.max_by(m, F.when(F.col(m).isNotNull(), F.col("seq"))).alias(m) for m in MODULES]
    return e.groupBy("user_id").agg(*latest, F.max_by("_ts", "seq").alias("lastUpdateTs")).select("user_id", F.struct(*MODULES, "lastUpdateTs").alias("snapshot"))


def merge_trace(events: DataFrame, now_ms: int) -> DataFrame:
    """(user_id, seq, snapshot): the merged state after each event."""
    w = W.Window.partitionBy("user_id").orderBy("seq").rowsBetween(W.Window.unboundedPreceding, 0)
    merged = [F.last(m, ignorenulls=True).over(w).alias(m) for m in MODULES]
    return events.select("user_id", "seq", *merged, last_update_ts(now_ms).alias("lastUpdateTs")).select("user_id", "seq", F.struct(*MODULES, "lastUpdateTs").alias("snapshot"))


def merge(existing: Column, new: Column) -> Column:
    """A snapshot updated by another: a module that the new one has replaces the old one whole."""
    return F.struct(*(F.coalesce(new[m], existing[m]).alias(m) for m in MODULES), new["lastUpdateTs"].alias("lastUpdateTs"))


def upserted(current: DataFrame, latest: DataFrame) -> DataFrame:
    """current (user_id, snapshot) after a batch's merge_latest is merged into it (SNK1)."""
    both = current.withColumnRenamed("snapshot", "old").join(latest.withColumnRenamed("snapshot", "new"), "user_id", "full")
    return both.select("user_id", F.when(F.col("new").isNull(), F.col("old")).when(F.col("old").isNull(), F.col("new")).otherwise(merge(F.col("old"), F.col("new"))).alias("snapshot"))


def history_rows(events: DataFrame, settings: DataFrame, now_ms: int) -> DataFrame:
    """(seq, user_id, recorded_at, snapshot): events with music, of users who allow it, as they came."""
    return access.authorized(with_snapshot(events.where(F.col("music").isNotNull()), now_ms), settings).select("seq", "user_id", "recorded_at", "snapshot")


def current_or_empty(users: DataFrame, current: DataFrame, now_ms: int) -> DataFrame:
    """Every user with a snapshot; an empty one of now where none is stored (SRC4)."""
    joined = users.join(current.withColumnRenamed("user_id", "id"), "id", "left")
    empty = F.struct(*(F.lit(None).cast(current.schema["snapshot"].dataType[m].dataType).alias(m) for m in MODULES), F.lit(now_ms).cast("long").alias("lastUpdateTs"))
    return joined.withColumn("snapshot", F.coalesce("snapshot", empty))


def process(events: DataFrame, settings: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(decisions, latest states, history rows) of a batch of events (STR3)."""
    decided = deduplicated(events)
    accepted = decided.where("accepted")
    return decided, merge_latest(accepted, now_ms), history_rows(accepted, settings, now_ms)
