"""Readers of event batches, legacy reports, media lines and bot messages (SRC7 to SRC10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import commands
from ..functions.links import BLANKS

LONGEST_LINE = 10_000_000


def event_batches(bodies: DataFrame) -> DataFrame:
    """bodies (user_id, batch_id, body: JSON) → one row for each event: user_id, batch_id, place and the event's
    fields. A malformed body has no events."""
    parsed = bodies.select("user_id", "batch_id", F.from_json("body", schemas.EVENT_BATCH).alias("b"))
    return parsed.select("user_id", "batch_id", F.posexplode("b.events").alias("place", "e")).select("user_id", "batch_id", "place", "e.*")


def legacy_reports(bodies: DataFrame, now_ms: int) -> DataFrame:
    """bodies (report_id, body: JSON {key, type, musicData}) → report_id, key and music. Other types than music are
    dropped; absent fields are empty strings, and without musicData there is no music."""
    r = bodies.select("report_id", F.from_json("body", schemas.LEGACY).alias("r")).where("r.type = 'music'")
    text = lambda c: F.coalesce(F.col(f"r.musicData.{c}"), F.lit("")).alias(c)
    music = F.when(F.col("r.musicData").isNotNull(), F.struct(text("title"), text("artist"), text("album"), F.lit(None).cast("string").alias("coverHash"), F.lit(now_ms).cast("long").alias("ts")))
    return r.select("report_id", F.coalesce("r.key", F.lit("")).alias("key"), music.alias("music"))


def media_lines(lines: DataFrame) -> DataFrame:
    """lines (value) of NDJSON, batch or stream → type, diff and payload. Blank, overlong and malformed lines and
    those without a required field are dropped."""
    line = F.btrim(F.col("value"), F.lit(BLANKS))
    kept = lines.withColumn("_line", line).where((F.col("_line") != "") & (F.length("_line") <= LONGEST_LINE))
    parsed = kept.withColumn("_record", F.from_json("_line", schemas.MEDIA_LINE)).where("_record.type is not null and _record.diff is not null and _record.payload is not null")
    return parsed.drop("value", "_line").select("*", "_record.*").drop("_record")


def read_media_lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    return media_lines((spark.readStream if streaming else spark.read).text(path))


def bot_messages(messages: DataFrame) -> DataFrame:
    """messages (message_id, body: JSON) with `command`, null for a blank text."""
    return messages.select("message_id", commands.parse(commands.message_text(F.col("body"))).alias("command"))


def event_snapshot(now_ms: Column) -> Column:
    """What one event says: its modules and the latest of their times (PRJ2)."""
    latest = F.greatest(*(F.coalesce(F.col(f"{m}.ts"), F.lit(0).cast("long")) for m in ("system", "music", "activity")))
    return F.struct("system", "music", "activity", F.when(latest == 0, now_ms).otherwise(latest).alias("lastUpdateTs"))


def loose_snapshot(text: Column) -> Column:
    """A snapshot from loosely typed JSON: fields of another type are null, module times are dropped (PRJ3)."""
    s = F.from_json(text, schemas.SNAPSHOT)
    without = lambda m, fields: F.when(s[m].isNotNull(), F.struct(*(s[m][f].alias(f) for f in fields)))
    return F.struct(without("system", ("batteryPct", "charging", "cpuPct", "memoryPct")).alias("system"), without("music", ("title", "artist", "album", "coverHash")).alias("music"), without("activity", ("label",)).alias("activity"), s["lastUpdateTs"].alias("lastUpdateTs"))


def wire_ms(seconds: Column) -> Column:
    """Seconds with a fraction as whole milliseconds, truncated (PRJ4)."""
    return (seconds * 1000).cast("long")
