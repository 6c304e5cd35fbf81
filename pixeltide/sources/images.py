"""Image files and image directories as frames, and frames as partitioned files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pixeltide.operators.resample import resize


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """source_id, height, width, channels, data (bytes as numbers 0..255, blue first); files that are no images are left out."""
    raw = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    data = F.transform(F.split(F.decode("data", "ISO-8859-1"), ""), lambda ch: F.ascii(ch))  # a byte is a character there
    return raw.select(F.col("origin").alias("source_id"), "height", "width", F.col("nChannels").alias("channels"), data.alias("data"))


def read_frame_dir(spark: SparkSession, path: str, length: int | None = None) -> DataFrame:
    """read_images of numbered files, with frame_no from the name; frames after `length` are left out."""
    out = read_images(spark, path).withColumn("frame_no", F.regexp_extract("source_id", r"(\d+)\.[A-Za-z]+$", 1).cast("int"))
    return out if length is None else out.where(F.col("frame_no") <= length)


def write_frames(px: DataFrame, path: str, width: int, height: int, size: tuple[int, int] = (1280, 720), mode: str = "errorifexists") -> None:
    """Pixels (source_id, session, frame_id, y, x, c, v), resized and written as Parquet by source and session."""
    done = px
    if size != (width, height):
        keys = ["source_id", "session", "frame_id"]  # frame_id alone may repeat between sources
        done = resize(px.withColumn("frame_id", F.struct(*keys)), width, height, *size).select(*[F.col(f"frame_id.{k}").alias(k) for k in keys], "y", "x", "c", "v")
    done.select("source_id", "session", "frame_id", "y", "x", "c", "v").write.mode(mode).partitionBy("source_id", "session").parquet(path)


def stream_frames(frames: DataFrame, path: str, checkpoint: str, write: Callable[[DataFrame, str], None] | None = None, trigger: dict | None = None, by: tuple[str, ...] = ()) -> StreamingQuery:
    """Starts writing a stream of rows with source_id and session (`streaming.stateful.recordings` gives them) as files in which
    a recording's rows lie together. by: columns to make folders of, where their values are few; a folder for each recording
    would be as many files as recordings.

    A micro-batch writes a folder of its own, batch=<its number>, and replaces what is there: one that is done again after a
    failure or a restart leaves its rows once. write(rows, folder): another way to write a batch, such as write_frames with
    mode "overwrite" for pixels.
    """

    def put(rows: DataFrame, batch: int) -> None:
        at = f"{path}/batch={batch}"
        if write is None:
            rows.sortWithinPartitions("source_id", "session").write.mode("overwrite").partitionBy(*by).parquet(at)
        else:
            write(rows, at)

    return frames.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_streamed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows that stream_frames has written, with the given columns."""
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    return spark.read.schema(f"{schema}, batch int").parquet(path).select(*names)
