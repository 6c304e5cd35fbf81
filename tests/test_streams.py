"""Streaming forms give what batch gives on the same rows."""

import pytest
from pyspark.sql import functions as F

from pixeltide.operators import stats, trackers
from pixeltide.plans.fixtures import fixture
from pixeltide.sources import images
from pixeltide.streaming import stateful


def run(spark, df, tmp_path, build, mode="append"):
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = build(stream).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out"))
    q.awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out"))


def test_rates(spark, sf_dir, tmp_path):
    lat = fixture(spark, sf_dir, "f5_latency").where("seq <= 30")
    try:
        got = run(spark, lat, tmp_path, lambda s: stateful.fps(stateful_ready(spark, s)))
    except Exception as e:
        if "ModuleNotFound" in str(e) or "google.protobuf" in str(e):
            pytest.skip("this Python has no state server")
        raise
    want = {(r.node, r.seq): round(r.mean_ms, 6) for r in stats.fps(lat).collect()}
    assert {(r.node, r.seq): round(r.mean_ms, 6) for r in got.collect()} == want


@pytest.mark.parametrize("latency", ["k * k % 97", "IF(k % 31 < 12, NULL, k * k % 97)"])
def test_rates_of_rows_in_no_order(spark, tmp_path, latency):
    """More rows of a node than come in one table, mixed over all of them; some without a latency."""
    lat = spark.range(25_000).selectExpr("id * 7919 % 25000 AS k").selectExpr("IF(k % 5 = 0, 'b', 'a') AS node", "CAST(k AS INT) AS seq", f"CAST({latency} AS INT) AS elapsed_ms")
    got = run(spark, lat, tmp_path, lambda s: stateful.fps(stateful_ready(spark, s)))
    key = lambda df: sorted((r.node, r.seq, str(r.elapsed_ms), str(r.mean_ms and round(r.mean_ms, 6)), round(r.fps, 6)) for r in df.collect())
    assert key(got) == key(stats.fps(lat))


def stateful_ready(spark, df):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.PROVIDER)
    return df


def test_tracks(spark, sf_dir, tmp_path):
    f = fixture(spark, sf_dir, "f4_stream").where("stream_id < 4").drop("ts")
    try:
        got = run(spark, f, tmp_path, lambda s: stateful.track(stateful_ready(spark, s), "box"))
    except Exception as e:
        if "ModuleNotFound" in str(e) or "google.protobuf" in str(e):
            pytest.skip("this Python has no state server")
        raise
    want = trackers.track(f, "box")
    key = lambda df: sorted((r.stream_id, r.frame_no, r.track_id, round(r.x1, 6)) for r in df.collect())
    assert key(got) == key(want)


def test_sessions(spark, sf_dir, tmp_path):
    f = fixture(spark, sf_dir, "f5_frames")
    got = run(spark, f, tmp_path, lambda s: stateful.recording_sessions(stateful.prepare(s, "1 hour"), "2 hours"))
    assert got.agg(F.sum("frames")).first()[0] <= f.count() and got.count() > 0


def fed(spark, at, batches, schema):
    """A stream that reads each list of rows as a micro-batch."""
    for rows in batches:
        df = spark.createDataFrame(rows, schema)
        df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(at)
    return spark.readStream.schema(spark.read.parquet(at).schema).option("maxFilesPerTrigger", 1).parquet(at)


def stated(spark, at, name):
    return spark.read.format("statestore").option("stateVarName", name).load(at)


def test_intake_counts_late_frames_and_ends_idle_sources(spark, tmp_path):
    day = "2024-01-{:02d} 00:00:00".format
    batches = [
        [(1, 1, day(1)), (1, 2, day(2)), (1, 2, day(2)), (2, 9, day(2))],
        [(1, 4, day(4)), (1, 2, day(2))],  # a repeat
        [(1, 3, day(3)), (1, 5, day(5)), (1, 6, day(1))],  # one late; one behind the watermark of the batch before
        [(1, 7, day(9))],
        [(2, 10, day(10)), (1, 8, day(8))],
    ]
    frames = stateful.prepare(fed(spark, str(tmp_path / "in"), batches, "source_id int, frame_id int, ts string"), "1 day", ["source_id", "frame_id"])
    q = stateful.intake(frames, "2 days").writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out"))
    q.awaitTermination(240)
    rows = spark.read.schema(stateful.INTAKE).parquet(str(tmp_path / "out")).collect()
    kinds = {(r.source_id, r.frame_id): r.kind for r in rows if r.kind != "closed"}
    assert kinds == {(1, 1): "frame", (1, 2): "frame", (2, 9): "frame", (1, 4): "frame", (1, 3): "late", (1, 5): "frame", (1, 7): "frame", (2, 10): "frame", (1, 8): "late"}
    closed = sorted((r.source_id, r.since.day, r.at.day, r.frames, r.late) for r in rows if r.kind == "closed")
    assert closed == [(2, 2, 2, 1, 0)]
    assert stateful.behind(q) >= 1
    left = {r.key.source_id: r.value for r in stated(spark, str(tmp_path / "state"), "source").collect()}
    assert set(left) == {1, 2} and (left[1].frames, left[1].late) == (5, 2) and left[2].frames == 1  # of 2 only what came after


def test_state_of_a_silent_node_is_gone(spark, tmp_path):
    batches = [[("a", k, 10, f"2024-01-01 00:00:{k:02d}") for k in range(3)], [("b", 9, 20, "2024-01-01 05:00:00")], [("b", 10, 20, "2024-01-01 05:00:01"), ("a", 5, 30, "2024-01-01 05:00:01")]]
    rows = stateful.prepare(fed(spark, str(tmp_path / "in"), batches, "node string, seq int, elapsed_ms int, ts string"), "1 minute")
    q = stateful.fps(rows, idle="1 hour").writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out"))
    q.awaitTermination(240)
    means = {(r.node, r.seq): r.mean_ms for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert means[("a", 2)] == 10 and means[("a", 5)] in (30, 15)  # 15: the timer is only seen once the watermark has passed
    assert {r.key.node for r in stated(spark, str(tmp_path / "state"), "last").collect()} <= {"a", "b"}


def test_recordings_to_files_again_and_again(spark, tmp_path):
    """A restart, and a batch that is done twice since its commit was lost, leave each row once."""
    tick = lambda s, k, on: (s, f"2024-01-01 00:00:{k:02d}", on, float(k))
    first = [[tick(1, 0, True), tick(1, 1, True), tick(1, 2, False), tick(2, 0, True)], [tick(1, 3, True), tick(1, 4, False), tick(2, 1, True)]]
    second = [[tick(1, 5, True), tick(1, 4, True), tick(2, 2, False)]]
    schema = "source_id int, ts string, has_frame boolean, payload double"
    stateful.prepare(spark.range(1).withColumn("ts", F.current_timestamp()))
    at, state, out = (str(tmp_path / n) for n in ("in", "state", "out"))
    for batches in (first, second):
        images.stream_frames(stateful.recordings(fed(spark, at, batches, schema)), out, state).awaitTermination(240)
        lost = max((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
        lost.unlink()
        (lost.parent / f".{lost.name}.crc").unlink(missing_ok=True)
    images.stream_frames(stateful.recordings(fed(spark, at, [], schema)), out, state).awaitTermination(240)
    rows = images.read_streamed(spark, out, "source_id int, ts timestamp, payload double, session long").collect()
    assert sorted((r.source_id, r.payload, r.session) for r in rows) == [(1, 0.0, 1), (1, 1.0, 1), (1, 3.0, 2), (1, 4.0, 3), (1, 5.0, 3), (2, 0.0, 1), (2, 1.0, 1)]


def test_spans():
    assert stateful.milliseconds("90 seconds") == 90_000 and stateful.milliseconds(" 2 days") == 172_800_000
    with pytest.raises(ValueError):
        stateful.milliseconds("soon")
