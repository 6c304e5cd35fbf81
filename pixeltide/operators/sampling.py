"""Which frames pass: sampling, seeking, throttling, parameter feeds, sessions and gates.

frames(source_id, frame_no, frame_id, ts, payload); a source's frames are in order of ts.

A busy source is no single task: rows are dealt out by source and bucket of time. What a row needs from before its bucket
(a count, the last row, the last known value) is carried over one row per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixeltide.operators.params import clamp


FULL = 10_000_000
BUCKET = "day"
ORDER = ("ts",)


def _here(order) -> Window:
    return Window.partitionBy("source_id", "_b").orderBy(*order)


def _past() -> Window:
    """Of rows that stand for a bucket each: those before."""
    return Window.partitionBy("source_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)


def carried(rows: DataFrame, ends: Column, past: Column, name: str) -> DataFrame:
    """rows, which have their bucket _b, with `name`: `past` over what the earlier buckets end with, which is the aggregate `ends` AS _e."""
    before = rows.groupBy("source_id", "_b").agg(ends.alias("_e")).select(F.col("source_id").alias("_s"), F.col("_b").alias("_t"), past.over(_past()).alias(name))
    return rows.join(before, F.col("source_id").eqNullSafe(F.col("_s")) & F.col("_b").eqNullSafe(F.col("_t"))).drop("_s", "_t")


def bucketed(rows: DataFrame, bucket: str = BUCKET) -> DataFrame:
    return rows.withColumn("_b", F.date_trunc(bucket, "ts"))


def numbered(rows: DataFrame, name: str, order=ORDER, bucket: str = BUCKET) -> DataFrame:
    """Adds `name`: the row's number in its source, from 1."""
    out = carried(bucketed(rows, bucket), F.count("*"), F.sum("_e"), "_n")
    return out.withColumn(name, F.row_number().over(_here(order)) + F.coalesce("_n", F.lit(0))).drop("_b", "_n")


def previous(rows: DataFrame, column: str, name: str, order=ORDER, bucket: str = BUCKET) -> DataFrame:
    """Adds `name`: the column's value in the source's row before, null in the first."""
    out = carried(bucketed(rows, bucket), F.max_by(F.struct(column), F.struct(*order)), F.last("_e"), "_n")
    local = F.lag(F.struct(column)).over(_here(order))
    return out.withColumn(name, F.coalesce(local, "_n")[column]).drop("_b", "_n")


def running(rows: DataFrame, column: str, name: str, order=ORDER, bucket: str = BUCKET) -> DataFrame:
    """Adds `name`: the sum of the column in the source's rows up to this one."""
    out = carried(bucketed(rows, bucket), F.sum(column), F.sum("_e"), "_n")
    return out.withColumn(name, F.sum(column).over(_here(order)) + F.coalesce("_n", F.lit(0))).drop("_b", "_n")


def skip_frames(frames: DataFrame, rate: int, bucket: str = BUCKET) -> DataFrame:
    """Each rate-th frame of a source."""
    rate = clamp(rate, 1, 10)
    return numbered(frames, "_k", bucket=bucket).where(F.col("_k") % rate == 0).drop("_k")


def places(frames: DataFrame, name: str, bucket: str = BUCKET) -> DataFrame:
    """source_id, frame_id and the frame's place in its source, from 0."""
    return numbered(frames.select("source_id", "ts", "frame_id"), "_k", bucket=bucket).select("source_id", (F.col("_k") - 1).cast("long").alias(name), "frame_id")


def loop_schedule(ticks: DataFrame, frames: DataFrame, rate: int, loop: bool = True, bucket: str = BUCKET) -> DataFrame:
    """The frame that each tick (source_id, tick from 1) shows: number tick * rate - 1, over and over; without loop it ends."""
    rate = clamp(rate, 1, 10)
    totals = frames.groupBy("source_id").agg(F.count("*").alias("total"))
    t = ticks.join(totals, "source_id").withColumn("shown", (F.col("tick") * rate - 1).cast("long"))
    t = t.withColumn("shown", F.col("shown") % F.col("total")) if loop else t.where(F.col("shown") < F.col("total"))
    return t.join(places(frames, "shown", bucket), ["source_id", "shown"]).select("source_id", "tick", "shown", "frame_id")


def seek_frames(requests: DataFrame, frames: DataFrame, bucket: str = BUCKET) -> DataFrame:
    """The frame at seek ten-millionths of its source, for requests(source_id, ts, seek)."""
    totals = frames.groupBy("source_id").agg(F.count("*").alias("total"))
    seek = F.least(F.lit(FULL), F.greatest(F.lit(0), F.col("seek").cast("int")))
    r = requests.join(totals, "source_id").withColumn("pos", F.least(F.col("total") - 1, F.greatest(F.lit(0), F.floor(F.col("total") * seek / FULL))))
    return r.join(places(frames, "pos", bucket), ["source_id", "pos"]).select("source_id", "ts", "pos", "frame_id")


def dedupe_seek(sought: DataFrame, bucket: str = BUCKET) -> DataFrame:
    """Adds `reread`: whether the position differs from the one before."""
    return previous(sought, "pos", "_p", bucket=bucket).withColumn("reread", ~F.col("_p").eqNullSafe(F.col("pos"))).drop("_p")


def throttle_latest(frames: DataFrame, interval: str) -> DataFrame:
    """The newest frame of a source in each interval; also for streams with a watermark on ts."""
    newest = F.max_by(F.struct("frame_id", "ts"), F.col("ts")).alias("f")
    return frames.groupBy("source_id", F.window("ts", interval)).agg(newest).select("source_id", F.col("window.start").alias("start"), "f.frame_id", "f.ts")


def last_known(df: DataFrame, value: str, order: list[str], bucket: str = BUCKET) -> DataFrame:
    """Adds _v: the last value up to each row of a source that isn't null, in the given order (which starts with ts)."""
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order)))
    out = carried(bucketed(df, bucket), last, F.last("_e", ignorenulls=True), "_c")
    here = _here(order).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("_v", F.coalesce(F.last(value, ignorenulls=True).over(here), F.col("_c"))).drop("_b", "_c")


def as_of(left: DataFrame, right: DataFrame, columns: list[str], bucket: str = BUCKET) -> DataFrame:
    """Adds columns of the latest row of right(source_id, ts, ...) that is not after each row of left.

    Both sides meet in windows per source and bucket of time; at equal times the right row applies.
    """
    marked = [F.struct(*[F.col(c) for c in columns]).alias("_r")]
    a = left.withColumn("_r", F.lit(None).cast(right.select(*marked).schema["_r"].dataType)).withColumn("_k", F.lit(1))
    b = right.select("source_id", "ts", *marked, F.lit(0).alias("_k"))
    both = last_known(a.unionByName(b, allowMissingColumns=True), "_r", ["ts", "_k"], bucket)
    return both.where("_k = 1").select(*left.columns, *[F.col(f"_v.{c}").alias(c) for c in columns])


def apply_param_feed(frames: DataFrame, params: DataFrame, low: float, high: float, default: float, digits: int | None = 3) -> DataFrame:
    """Each frame with the parameter then in force: params(source_id, ts, param), within [low, high], floats rounded."""
    value: Column = F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce("param", F.lit(default))))
    return as_of(frames, params, ["param"]).withColumn("param", value.cast("int") if digits is None else F.round(value, digits))


def recording_sessions(ticks: DataFrame, bucket: str = BUCKET) -> DataFrame:
    """Numbers the recordings (from 1) of ticks(source_id, ts, has_frame): one ends at the first missing frame."""
    marked = previous(ticks, "has_frame", "_p", bucket=bucket)
    marked = marked.withColumn("_f", (F.col("has_frame") & ~F.coalesce("_p", F.lit(False))).cast("int"))
    return running(marked, "_f", "session", bucket=bucket).where("has_frame").drop("_p", "_f")


def hold_last(ticks: DataFrame, column: str = "payload") -> DataFrame:
    """A tick without a frame repeats the last one."""
    held = last_known(ticks, column, ["ts"])
    return held.select(*[F.col("_v").alias(c) if c == column else F.col(c) for c in ticks.columns])


def gate(frames: DataFrame, switch: DataFrame) -> DataFrame:
    """Frames that come while switch(source_id, ts, state) is ON, as it is at first."""
    return as_of(frames, switch, ["state"]).where(F.coalesce("state", F.lit("ON")) == "ON").drop("state")
