from pyspark.sql import functions as F

from quillstream.operators import folds, state
from quillstream.sources import adapter, ingest
from quillstream.streaming import folds as streaming_folds
from quillstream.streaming import ingest as streaming


def test_stream_decides_and_merges_as_the_batch_does(spark, sf_dir, tmp_path):
    events = adapter.events(spark, sf_dir).where("user_id < 6")
    cut = events.agg(F.percentile_approx("seq", 0.5)).first()[0]
    for i, part in enumerate((events.where(F.col("seq") <= cut), events.where(F.col("seq") > cut))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = streaming.decided(stream, adapter.NOW_MS).writeStream.format("memory").queryName("decided").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        assert query.awaitTermination(120)
        found = spark.table("decided")
        batch = state.deduplicated(events)
        decisions = lambda df: sorted((r.seq, r.accepted) for r in df.select("seq", "accepted").collect())
        assert decisions(found) == decisions(batch)
        states = lambda df: {r.user_id: r.snapshot for r in df.collect()}
        assert states(streaming.latest(found)) == states(state.merge_latest(batch.where("accepted"), adapter.NOW_MS))
    finally:
        query.stop()


def test_media_lines(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text('{"type":"data","diff":false,"payload":{"title":"T"}}\n\n  \nnot json\n{"type":"data"}\n  {"type":"data","diff":true,"payload":{}}\n')
    rows = ingest.read_media_lines(spark, str(tmp_path)).collect()
    assert sorted((r.diff, r.payload.title) for r in rows) == [(False, "T"), (True, None)]


def run_stream(spark, df, make, name, tmp_path):
    """Two micro-batches through `make`, collected."""
    cut = df.agg(F.percentile_approx("seq", 0.5)).first()[0]
    for i, part in enumerate((df.where(F.col("seq") <= cut), df.where(F.col("seq") > cut))):
        part.coalesce(1).write.parquet(str(tmp_path / name / str(i)))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name / "*"))
    query = make(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"{name}-check")).start()
    try:
        assert query.awaitTermination(120)
        return sorted(map(repr, spark.table(name).collect()))
    finally:
        query.stop()


def test_state_machines_on_streams(spark, sf_dir, tmp_path):
    events = adapter.events(spark, sf_dir).where("user_id < 5")
    calls = events.select("user_id", "seq", "arrival_ms")
    batch = sorted(map(repr, folds.rate_limited(calls, 2000, 3).collect()))
    assert run_stream(spark, calls, lambda s: streaming_folds.rate_limited(s, 2000, 3), "calls", tmp_path) == batch
    k = F.col("k")
    records = events.select("user_id", "seq", (k % 3 == 0).alias("diff"), "music.title", "music.artist", "music.album", F.when(k % 2 == 0, k % 5 == 0).alias("playing"), F.lit(None).cast("string").alias("bundle_id"), F.when(k % 4 != 0, F.base64(F.lit("x").cast("binary"))).alias("artwork"))
    batch = sorted(map(repr, folds.now_playing(records).collect()))
    assert run_stream(spark, records, streaming_folds.now_playing, "records", tmp_path) == batch
