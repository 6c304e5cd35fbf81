"""Keyed state over streams. Frames of a key are taken in order within each micro-batch; a frame that comes after a later
one was processed in an earlier micro-batch is late: its place in the state is gone. `intake` counts such frames and gives them out
beside the others; the other operators leave them out, as Spark does with anything behind the watermark (`behind` counts that).

State ends with its key: where `idle` is given, an event-time timer runs that long after the newest row of a key, and when
the watermark passes it, the key's state is dropped. Without it a key's state lives as long as the query.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pixeltide.operators.stats import LAST
from pixeltide.operators.trackers import PER_CLASS, SCHEMA, TRACKERS, advance, load, save

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROWS = 50_000  # of a table that is given out at once
_UNIT = {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}


def milliseconds(span: str) -> int:
    """Of a span such as `90 seconds` or `2 hours`."""
    found = re.fullmatch(r"\s*(\d+)\s+(second|minute|hour|day)s?\s*", span)
    if not found:
        raise ValueError(f"no span of time: {span!r}")
    return int(found[1]) * _UNIT[found[2]]


def prepare(df: DataFrame, delay: str = "10 minutes", keys: list[str] | None = None) -> DataFrame:
    """Event time with a zone and its watermark; with keys, rows that repeat them within the watermark are left out."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    timed = df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed if keys is None else timed.dropDuplicatesWithinWatermark(keys)


def behind(query: StreamingQuery) -> int:
    """Rows that operators with state have dropped for being behind the watermark, in the progress that Spark has kept."""
    return sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)


def skip_frames(frames: DataFrame, rate: int) -> DataFrame:
    """Each rate-th frame by its own number; without state, so late frames are no trouble."""
    return frames.where(F.col("frame_no") % rate == 0)


def throttle_latest(frames: DataFrame, interval: str) -> DataFrame:
    newest = F.max_by(F.struct("frame_id", "ts"), F.col("ts")).alias("f")
    return frames.groupBy("source_id", F.window("ts", interval)).agg(newest).select("source_id", F.col("window.start").alias("start"), "f.frame_id", F.col("f.ts").alias("at"))


def recording_sessions(frames: DataFrame, gap: str) -> DataFrame:
    """Frames of a source that are less than `gap` apart."""
    s = frames.groupBy("source_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("frames"))
    return s.select("source_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "frames")


class Keyed(StatefulProcessor):
    """A key's state and, with idle (ms), the timer that ends it. Rows bring `ms_`, their event time."""

    idle: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        """Declares the state."""
        raise NotImplementedError

    def forget(self, key):
        """Drops the key's state; what it yields is given out."""
        raise NotImplementedError

    def awake(self, newest: int) -> None:
        """Puts the timer off to `idle` after the newest row."""
        if self.idle is not None:
            at = newest + self.idle
            old = list(self.handle.listTimers())
            if old and max(old) >= at:
                return
            for t in old:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        return iter(list(self.forget(key) or ()))

    def close(self) -> None:
        pass


def _timed(rows: DataFrame, idle: str | None) -> tuple[DataFrame, str]:
    """Rows with `ms_` where state may end, and the time mode."""
    return (rows, "None") if idle is None else (rows.withColumn("ms_", F.unix_millis("ts")), "EventTime")


INTAKE = "source_id long, kind string, frame_id long, at timestamp, since timestamp, frames long, late long"


class Intake(Keyed):
    def __init__(self, idle: int):
        self.idle = idle

    def open(self, handle):
        self.state = handle.getValueState("source", "first long, last long, frames long, late long")

    def _rows(self, key, kinds, ids, at, since, frames, late) -> pd.DataFrame:
        moment = lambda us: pd.to_datetime(pd.Series(us, dtype="Int64"), unit="us", utc=True)
        n = len(kinds)
        whole = lambda x: pd.array(x if isinstance(x, list) else [x] * n, "Int64")
        return pd.DataFrame({"source_id": whole(int(key[0])), "kind": kinds, "frame_id": whole(ids), "at": moment(at), "since": moment([since] * n), "frames": whole(frames), "late": whole(late)})

    def handleInputRows(self, key, rows, timer):
        first, last, frames, late = self.state.get() or (None, None, 0, 0)
        b = pd.concat(list(rows)).sort_values(["us_", "frame_id"])
        at, ids = b.us_.tolist(), b.frame_id.tolist()
        kinds, before = [], last
        for t in at:
            fresh = before is None or t >= before
            kinds.append("frame" if fresh else "late")
            frames, late = frames + fresh, late + (not fresh)
        last = at[-1] if last is None else max(last, at[-1])
        first = at[0] if first is None else first
        self.state.update((first, last, frames, late))
        self.awake(last // 1000)
        yield self._rows(key, kinds, ids, at, None, None, None)

    def forget(self, key):
        first, last, frames, late = self.state.get()
        self.state.clear()
        yield self._rows(key, ["closed"], [None], [last], first, frames, late)


def intake(frames: DataFrame, idle: str) -> DataFrame:
    """The frames of sources as they come in: kind `frame`, or `late` where a later one of the source came in an earlier micro-batch.

    A source without a new frame for `idle` ends: kind `closed`, with its first (since) and last (at) time and how many frames
    it had, and how many late ones. Its state is dropped then; a frame after that begins anew. frames is from `prepare`.
    """
    rows = frames.select(F.col("source_id").cast("long").alias("source_id"), F.col("frame_id").cast("long").alias("frame_id"), "ts", F.unix_micros("ts").alias("us_"))
    return rows.groupBy("source_id").transformWithStateInPandas(Intake(milliseconds(idle)), INTAKE, "Append", "EventTime")


class Recorder(Keyed):
    """Numbers a source's recordings. This state is one row per source and stays: numbers aren't given twice."""

    def open(self, handle):
        self.state = handle.getValueState("recording", "session long, on boolean, last long")

    def handleInputRows(self, key, rows, timer):
        session, on, last = self.state.get() or (0, False, None)
        b = pd.concat(list(rows)).sort_values("us_", kind="stable")
        if last is not None:
            b = b[b.us_ >= last]
        if len(b):
            has = b.has_frame.fillna(False).astype(bool)
            starts = has & ~has.shift(fill_value=bool(on))
            numbers = session + starts.cumsum()
            self.state.update((int(numbers.iloc[-1]), bool(has.iloc[-1]), int(b.us_.iloc[-1])))
            yield b.assign(session=numbers)[has].drop(columns=["us_", "has_frame"])


def recordings(ticks: DataFrame) -> DataFrame:
    """operators.sampling.recording_sessions over a stream of ticks(source_id, ts, has_frame, …): the ticks with a frame, and `session`."""
    others = [f for f in ticks.schema if f.name != "has_frame"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "session long"])
    rows = ticks.withColumn("us_", F.unix_micros("ts"))
    return rows.groupBy("source_id").transformWithStateInPandas(Recorder(), schema, "Append", "None")


def _means(values: np.ndarray) -> np.ndarray:
    """Of each whole number and the LAST - 1 before it; NaNs don't count, and the mean of nothing else is NaN."""
    there = ~np.isnan(values)
    total, n = (np.concatenate([np.zeros(LAST, np.int64), np.cumsum(v.astype(np.int64))]) for v in (np.where(there, values, 0), there))
    total, n = (v[LAST:] - v[:-LAST] for v in (total, n))
    return np.divide(total, n, out=np.full(len(values), np.nan), where=n > 0)


def _whole(values: np.ndarray) -> pd.Series:
    return pd.Series(values).astype("Int64")


class Rate(Keyed):
    """Mean of the last LAST latencies of a node. The rows of a micro-batch come in order of seq, however they were read."""

    def __init__(self, idle: int | None = None):
        self.idle = idle

    def open(self, handle):
        self.last = handle.getListState("last", "ms int")

    def handleInputRows(self, key, rows, timer):
        parts, newest = [], 0
        for b in rows:  # in no order; only two numbers of each row are held
            parts.append((b.seq.to_numpy(float), b.elapsed_ms.to_numpy(float)))
            if self.idle is not None:
                newest = max(newest, int(b.ms_.max()))
        seq, ms = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.lexsort((ms, seq))
        kept = np.array([r[0] for r in self.last.get()], float)
        for at in range(0, len(order), ROWS):
            own = order[at : at + ROWS]
            window = np.concatenate([kept, ms[own]])
            mean = _means(window)[len(kept) :]
            rate = np.divide(1000, mean, out=np.zeros_like(mean), where=mean > 0)
            whole = {"seq": _whole(seq[own]), "elapsed_ms": _whole(ms[own])}
            yield pd.DataFrame({"node": [key[0]] * len(own), **whole, "mean_ms": mean, "fps": rate})
            kept = window[-LAST:]
        self.last.put([(None if np.isnan(v) else int(v),) for v in kept])
        self.awake(newest)

    def forget(self, key):
        self.last.clear()


def fps(latency: DataFrame, idle: str | None = None) -> DataFrame:
    """operators.stats.fps over a stream. With idle, latency has ts and a watermark, and a node begins anew after so long a silence."""
    rows, mode = _timed(latency, idle)
    processor = Rate(None if idle is None else milliseconds(idle))
    return rows.groupBy("node").transformWithStateInPandas(processor, "node string, seq int, elapsed_ms int, mean_ms double, fps double", "Append", mode)


class Track(Keyed):
    def __init__(self, kind: str, params: dict, idle: int | None = None):
        self.kind, self.params, self.idle = kind, params, idle

    def open(self, handle):
        self.state = handle.getValueState("tracker", "raw binary, last int")

    def handleInputRows(self, key, rows, timer):
        raw = self.state.get()
        stream = int(key[0])
        name = f"{stream}:{int(key[1])}" if PER_CLASS[self.kind] else stream
        tracker, last = (load(bytes(raw[0])), raw[1]) if raw else (TRACKERS[self.kind](name, **self.params), None)
        b = pd.concat(list(rows))
        newest = int(b.pop("ms_").max()) if self.idle is not None else 0
        out, last = advance(tracker, last, b, stream)
        self.state.update((save(tracker), last))
        self.awake(newest)
        yield out

    def forget(self, key):
        self.state.clear()


def track(dets: DataFrame, kind: str, idle: str | None = None, **params) -> DataFrame:
    """operators.trackers.track over a stream; micro-batches are to hold whole frames. With idle, dets has ts and a watermark."""
    keys = ["stream_id", "class_id"] if PER_CLASS[kind] else ["stream_id"]
    rows, mode = _timed(dets, idle)
    return rows.groupBy(*keys).transformWithStateInPandas(Track(kind, params, None if idle is None else milliseconds(idle)), SCHEMA, "Append", mode)
