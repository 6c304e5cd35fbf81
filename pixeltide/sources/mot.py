"""MOTChallenge text files: detections, ground truth and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DET_SCHEMA = "frame int, id int, left double, top double, w double, h double, conf double, a double, b double, c double"


def read_mot(spark: SparkSession, path: str, min_conf: float | None = None) -> DataFrame:
    """frame, id, x1, y1, x2, y2, score of det.txt files; rows with fewer columns are read as far as they go."""
    raw = spark.read.csv(path, schema=DET_SCHEMA)
    out = raw.select("frame", "id", F.col("left").alias("x1"), F.col("top").alias("y1"), (F.col("left") + F.col("w")).alias("x2"), (F.col("top") + F.col("h")).alias("y2"), F.col("conf").alias("score"))
    return out if min_conf is None else out.where(F.col("score") >= min_conf)


def load_mot_gt(rows: DataFrame, min_conf: float = -1) -> DataFrame:
    """Ground truth or predictions (frame, id, x, y, w, h, conf): from 1-based to 0-based corners, conf >= min_conf."""
    return rows.where(F.col("conf") >= min_conf).withColumn("x", F.col("x") - 1).withColumn("y", F.col("y") - 1)


def mot_rows(tracks: DataFrame) -> DataFrame:
    """The columns of a result file, frames from 1."""
    minus = F.lit(-1)
    return tracks.select((F.col("frame_no") + 1).alias("frame"), F.col("track_id").alias("id"), F.col("x1").alias("left"), F.col("y1").alias("top"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"), minus.alias("conf"), minus.alias("a"), minus.alias("b"), minus.alias("c"))


def write_mot(tracks: DataFrame, path: str) -> None:
    mot_rows(tracks).write.csv(path)
