"""Registered queries that go through files, a model or a stream and come back."""

from __future__ import annotations

import os
import struct
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pixeltide.operators import detect
from pixeltide.operators import pixels as P
from pixeltide.operators.rounds import checkpoint
from pixeltide.plans.fixtures import ctes, fixture
from pixeltide.plans.pixel_queries import _resized
from pixeltide.plans.time_queries import streamed
from pixeltide.sources import images, mot
from pixeltide.streaming import stateful

Q, SQL = {}, {}


def put(name, run, sql=None):
    Q[name] = run
    if sql:
        SQL[name] = sql


def place(spark) -> str:
    checkpoint(spark.range(1))
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/files-{uuid.uuid4().hex}"


def brightness_model():
    """A stand-in for a user's model: two scores from a frame's mean."""

    def predict(b: pd.DataFrame) -> pd.DataFrame:
        mean = b.data.map(lambda d: float(sum(d)) / len(d) / 255)
        return pd.concat([pd.DataFrame({"frame_id": b.frame_id, "class_id": k, "score": s}) for k, s in ((0, 1 - mean), (1, mean))])

    return predict


put(
    "infer",
    lambda s, d: detect.infer(P.pixels_to_frames(fixture(s, d, "f1_gray")), brightness_model, "frame_id long, class_id int, score double", "brightness").withColumn("score", F.round("score", 6)),
    f"{ctes('f1_gray')}, m AS (SELECT frame_id, avg(v)/255 AS m FROM f1_gray GROUP BY frame_id) SELECT frame_id, 0 AS class_id, round(1-m, 6) AS score FROM m UNION ALL SELECT frame_id, 1, round(m, 6) FROM m",
)


def written(s, d):
    px = fixture(s, d, "f1_gray").withColumn("source_id", F.col("frame_id") % 4).withColumn("session", F.lit(1))
    images.write_frames(px, at := place(s), 8, 8, (12, 10))
    return s.read.parquet(at).select(F.col("source_id").cast("long").alias("source_id"), "frame_id", "y", "x", "c", "v")


put("write_frames", written, f"{_resized(ctes('f1_gray'), 'f1_gray', 8, 8, 12, 10, 'linear')} SELECT frame_id%4 AS source_id, frame_id, y, x, c, v FROM small")


def bitmap(height: int, width: int, data) -> bytes:
    """A 24-bit BMP of blue, green, red values from the top row down."""
    gap = bytes(-width * 3 % 4)
    rows = np.asarray(data).astype(np.uint8).reshape(height, width * 3)
    body = b"".join(r.tobytes() + gap for r in rows[::-1])
    return struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def image_files(s, d):
    """The colour frames as numbered image files in the shared folder."""
    at = place(s)
    folder = at.removeprefix("file:")

    def save(batches):
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            for n, data in zip(b.frame_id, b.data, strict=True):
                with open(f"{folder}/{n:08d}.bmp", "wb") as f:
                    f.write(bitmap(8, 8, data))
            yield b[["frame_id"]]

    frames = fixture(s, d, "f2_bgr").groupBy("frame_id").agg(F.sort_array(F.collect_list(F.struct("y", "x", "c", "v"))).alias("p"))
    frames.select("frame_id", F.transform("p", lambda p: p["v"]).alias("data")).mapInPandas(save, "frame_id long").count()
    return at


def image_values(df, name):
    return df.select(name, F.posexplode("data").alias("i", "v")).select(F.col(name).cast("long").alias("frame_id"), F.floor(F.col("i") / 24).cast("int").alias("y"), (F.floor(F.col("i") / 3) % 8).cast("int").alias("x"), (F.col("i") % 3).cast("int").alias("c"), F.col("v").cast("int").alias("v"))


IMAGE_SQL = f"{ctes('f2_bgr')} SELECT frame_id, y, x, c, v FROM f2_bgr"
put("read_images", lambda s, d: image_values(images.read_images(s, image_files(s, d)).withColumn("n", F.regexp_extract("source_id", r"(\d+)\.bmp$", 1)), "n"), IMAGE_SQL)
put("read_frame_dir", lambda s, d: image_values(images.read_frame_dir(s, image_files(s, d)), "frame_no"), IMAGE_SQL)


def mot_files(s, d):
    f = fixture(s, d, "f4_stream").withColumn("track_id", F.col("stream_id") * 10 + F.col("det_id"))
    mot.write_mot(f, at := place(s))
    return mot.read_mot(s, at).select("frame", "id", "x1", "y1", "x2", "y2", "score")


put("read_mot", mot_files, f"{ctes('f4_stream')} SELECT frame_no+1 AS frame, CAST(stream_id*10+det_id AS INT) AS id, x1, y1, x2, y2, CAST(-1 AS DOUBLE) AS score FROM f4_stream")


def stream_fps(s, d):
    def run(events):
        s.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.PROVIDER)
        return stateful.fps(events.select(F.col("event_type").alias("node"), F.col("event_id").cast("int").alias("seq"), F.floor("value").cast("int").alias("elapsed_ms")))

    out = streamed(s, d, run, "node string, seq int, elapsed_ms int, mean_ms double, fps double")
    return out.select("node", "seq", "elapsed_ms", F.round("mean_ms", 6).alias("mean_ms"), F.round("fps", 6).alias("fps"))


put("stream_fps", stream_fps, "WITH a AS (SELECT event_type AS node, CAST(event_id AS INT) AS seq, CAST(floor(value) AS INT) AS elapsed_ms FROM events), b AS (SELECT *, avg(elapsed_ms) OVER (PARTITION BY node ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m FROM a) SELECT node, seq, elapsed_ms, round(m, 6) AS mean_ms, round(CASE WHEN m>0 THEN 1000e0/m ELSE 0e0 END, 6) AS fps FROM b")


def stream_skip(s, d):
    def run(events):
        return stateful.skip_frames(events.where("event_type in ('view','click')").select(F.col("user_id").alias("source_id"), F.col("event_id").alias("frame_id"), F.col("event_id").alias("frame_no")), 3)

    return streamed(s, d, run, "source_id long, frame_id long, frame_no long")


put("stream_skip_frames", stream_skip, "SELECT user_id AS source_id, event_id AS frame_id, event_id AS frame_no FROM events WHERE event_type IN ('view','click') AND event_id % 3 = 0")
