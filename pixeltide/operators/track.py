"""Pairs, costs, smoothing and housekeeping of tracks, in columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixeltide.functions.assign import sparse
from pixeltide.operators import grid
from pixeltide.operators.detect import BOX, iou
from pixeltide.operators.params import dealt
from pixeltide.operators.trackers import Axis


def iou_pairs(a: DataFrame, b: DataFrame, keys: list[str], eps: float = 1e-7, plus_one: bool = False, only_overlapping: bool = False, axes=grid.AXES) -> DataFrame:
    """IoU of pairs of boxes a(keys, a_id, ...) and b(keys, b_id, ...) with the same keys: of all, or of those that overlap.

    axes: the columns of the lower and upper corner in each dimension, for boxes of any number of them. The pairs that overlap are
    found by grids, so a crowded frame makes no more than these; all pairs are for frames that bound them.
    """
    corners = [c for pair in axes for c in pair]
    score = {n: ["score"] if "score" in d.columns else [] for n, d in (("a", a), ("b", b))}
    if only_overlapping:
        met = grid.overlapping(a.select(*keys, "a_id", *corners, *score["a"]), b.select(*keys, "b_id", *corners, *score["b"]), keys, axes, 1.0 if plus_one else 0.0)
        both = met.select(*keys, "p.a_id", "q.b_id", "p", "q", *[F.col("p.score").alias("a_score") for _ in score["a"]], *[F.col("q.score").alias("b_score") for _ in score["b"]])
    else:
        x = a.select(*keys, "a_id", F.struct(*corners).alias("p"), *[F.col(c).alias(f"a_{c}") for c in score["a"]])
        y = b.select(*keys, "b_id", F.struct(*corners).alias("q"), *[F.col(c).alias(f"b_{c}") for c in score["b"]])
        both = x.join(y, keys)
    return both.withColumn("iou", iou(F.col("p"), F.col("q"), plus_one, eps, axes)).drop("p", "q")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def appearance_pairs(pairs: DataFrame, beta: float = 0.5) -> DataFrame:
    """From pairs(fa, fb, iou): cosine distance (at least 0), angular similarity and their aptitude with the overlap."""
    cos = dot(F.col("fa"), F.col("fb")) / F.sqrt(dot(F.col("fa"), F.col("fa")) * dot(F.col("fb"), F.col("fb")))
    d = pairs.withColumn("cosdist", F.greatest(F.lit(0.0), 1 - cos)).withColumn("similarity", 1 - F.col("cosdist") / 2)
    return d.withColumn("aptitude", F.col("iou") * (beta + (1 - beta) * F.col("similarity")))


def fuse_cost(pairs: DataFrame, gate: str = "gate", weight: float = 0.98) -> DataFrame:
    """From pairs(iou, score, reid, gate): the three fused costs."""
    return pairs.select("*", (1 - F.col("iou") * F.col("score")).alias("by_score"), (1 - F.col("reid") * (1 + F.col("iou")) / 2).alias("by_iou"), (weight * (1 - F.col("iou")) + (1 - weight) * F.col(gate)).alias("by_motion"))


#: The 95 % points of chi-square with 2 and 4 degrees of freedom.
CHI2 = {2: 5.9915, 4: 9.4877}


def gate_pairs(pairs: DataFrame, names: tuple[str, ...] = ("x", "y", "a", "h"), only: bool = True) -> DataFrame:
    """Squared Mahalanobis distance of pairs(x_d, x_var, ...) with independent axes; `only` those inside the 95 % gate."""
    d2 = sum((F.col(f"{n}_d") * F.col(f"{n}_d") / F.col(f"{n}_var") for n in names[1:]), F.col(f"{names[0]}_d") * F.col(f"{names[0]}_d") / F.col(f"{names[0]}_var"))
    out = pairs.withColumn("gate", d2)
    return out.where(F.col("gate") <= CHI2[len(names)]) if only else out


def assign_optimal(pairs: DataFrame, keys: list[str], limit: float) -> DataFrame:
    """The one-to-one pairs of least total cost in each group of pairs(keys, a_id, b_id, cost); pairs over limit are never made."""
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    rows = pairs.where(F.col("cost") <= limit).groupBy(*keys).agg(F.collect_list(F.struct("a_id", "b_id", "cost")).alias("p"))
    parts = rows.select(*keys, *[F.col("p").getField(c).alias(c) for c in ("a_id", "b_id", "cost")])

    @F.pandas_udf(f"array<struct<a_id:{kinds['a_id']},b_id:{kinds['b_id']},cost:double>>")
    def solve(a_ids: pd.Series, b_ids: pd.Series, costs: pd.Series) -> pd.Series:
        out = []
        for x, y, c in zip(a_ids, b_ids, costs, strict=True):
            a, i = np.unique(x, return_inverse=True)
            b, j = np.unique(y, return_inverse=True)
            out.append([{"a_id": a[m], "b_id": b[n], "cost": v} for m, n, v in sparse(i.tolist(), j.tolist(), np.asarray(c, float).tolist(), limit)])
        return pd.Series(out)

    return parts.select(*keys, F.inline(solve("a_id", "b_id", "cost")))


def multi_match(pairs: DataFrame, assigned: DataFrame, keys: list[str], least: float = 0.1, multi: float | None = None) -> DataFrame:
    """From pairs(keys, a_id, b_id, iou) and assigned(keys, a_id, b_id): the assigned pairs of at least `least`, and with multi
    all others of over `multi` whose a_id is assigned (to whatever). Adds `extra`: whether a pair is one of these."""
    own = assigned.select(*keys, "a_id", F.col("b_id").alias("_own"))
    both = pairs.join(own, [*keys, "a_id"]).withColumn("extra", F.col("b_id") != F.col("_own")).drop("_own")
    more = F.col("extra") & (F.col("iou") > multi) if multi is not None and multi < 1 else F.lit(False)
    return both.where((~F.col("extra") & (F.col("iou") >= least)) | more)


def assign_greedy(pairs: DataFrame, keys: list[str], limit: float) -> DataFrame:
    """Cheapest first (a_id, then b_id on ties), each side once, only costs under limit."""
    a = pairs.where(F.col("cost") < limit).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("cost", "a_id", "b_id"))).alias("s"))
    none = F.filter("s", lambda x: F.lit(False))
    kept = F.aggregate("s", none, lambda acc, p: F.when(F.exists(acc, lambda q: (q["a_id"] == p["a_id"]) | (q["b_id"] == p["b_id"])), acc).otherwise(F.concat(acc, F.array(p))))
    return a.select(*keys, F.inline(kept)).select(*keys, "a_id", "b_id", "cost")


LENGTH = 256  # steps of a segment


def _along(rows: DataFrame, keys: list[str], names: list[str], run) -> DataFrame:
    """A filter along each track by frame_no: run(values, lengths) takes the rows of tracks one after the other, and how many each has.

    The rows of a track are together and in order; what is computed for one step is computed for many tracks at once.
    """
    columns = [c for c in rows.columns if c not in [*keys, "frame_no"]]
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in [*keys, "frame_no"])

    def batch(g: pd.DataFrame) -> pd.DataFrame:
        same = (g[keys].to_numpy()[1:] == g[keys].to_numpy()[:-1]).all(1)
        starts = np.append(0, np.flatnonzero(~same) + 1)
        lengths = np.diff(np.append(starts, len(g)))
        made = run(g[columns].to_numpy(float), lengths)
        return pd.concat([g[[*keys, "frame_no"]].reset_index(drop=True), pd.DataFrame(made, columns=names)], axis=1)

    def tracks(batches):
        """Whole tracks: the last one of a batch may go on in the next."""
        held: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            last = (b[keys] == b[keys].iloc[-1]).all(axis=1).to_numpy()
            whole = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            same = held and (held[-1][keys].iloc[-1] == b[keys].iloc[0]).all()
            if held and not same:
                yield batch(pd.concat(held, ignore_index=True))
                held = []
            if whole:
                yield batch(pd.concat([*held, b.iloc[:whole]], ignore_index=True))
                held = []
            held.append(b.iloc[whole:])
        if held:
            yield batch(pd.concat(held, ignore_index=True))

    sorted_ = dealt(rows, *keys).sortWithinPartitions(*rows.columns)
    return sorted_.mapInPandas(tracks, f"{kinds}, {', '.join(f'{n} double' for n in names)}")


def by_steps(values: np.ndarray, lengths: np.ndarray, width: int, step) -> np.ndarray:
    """step(k, state, rows) -> state for the k-th rows of all tracks that have so many; a state is a row of `width` numbers."""
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    longest_first = lengths[order]
    out, state = np.empty((len(values), width)), np.zeros((len(lengths), width))
    for k in range(int(longest_first[0]) if len(lengths) else 0):
        n = int(np.searchsorted(-longest_first, -k, "left"))  # tracks of more than k rows
        state = step(k, state[:n], values[starts[:n] + k])
        out[starts[:n] + k] = state
    return out


def linear_scan(values: np.ndarray, lengths: np.ndarray, gains: np.ndarray, drift: float, length: int = LENGTH) -> np.ndarray:
    """Positions and velocities of z by x' = x + drift v, then x + g (z - x'), v + h (z - x'), with gains (g, h) by the row's number.

    A track's first row is its state. The rest is cut in segments; a segment's step maps are linear, so it is run from
    nothing and from both unit states, which composes them; a pass over the segments gives each its true start.
    """
    first = np.cumsum(lengths) - lengths
    number = np.arange(len(values)) - np.repeat(first, lengths)
    g, h = gains[np.minimum(number, len(gains) - 1)].T
    rest = np.maximum(lengths - 1, 0)
    parts = -(-rest // length)
    owner = np.repeat(np.arange(len(lengths)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = first[owner] + 1 + nth * length
    size = np.minimum(length, first[owner] + lengths[owner] - begin)
    order = np.argsort(-size, kind="stable")
    begin_, size_ = begin[order], size[order]
    out = np.zeros((len(values), 2))
    out[first, 0] = values[first]

    def run(x, v, keep):
        for k in range(int(size_[0]) if len(size_) else 0):
            n = int(np.searchsorted(-size_, -k, "left"))
            at = begin_[:n] + k
            ahead = x[:n] + drift * v[:n]
            off = (values[at][:, None] if keep else values[at][:, None] * np.array([1.0, 0.0, 0.0])) - ahead
            x[:n], v[:n] = ahead + g[at][:, None] * off, v[:n] + h[at][:, None] * off
            if keep:
                out[at] = np.concatenate([x[:n], v[:n]], 1)
        return x, v

    if len(owner) > len(np.unique(owner)):  # some track has several segments
        x, v = run(np.tile([0.0, 1.0, 0.0], (len(size_), 1)), np.tile([0.0, 0.0, 1.0], (len(size_), 1)), False)
        back = np.argsort(order, kind="stable")
        x, v = x[back], v[back]
        start = np.zeros((len(owner), 2))
        for k in range(int(nth.max()) + 1):
            at = np.flatnonzero(nth == k)
            if k:
                sx, sv = start[at - 1].T
                start[at] = np.stack([x[at - 1] @ [1.0, 0, 0] + x[at - 1, 1] * sx + x[at - 1, 2] * sv, v[at - 1] @ [1.0, 0, 0] + v[at - 1, 1] * sx + v[at - 1, 2] * sv], 1)
            else:
                start[at, 0] = values[first[owner[at]]]
        start = start[order]
    else:
        start = np.stack([values[first[owner]], np.zeros(len(owner))], 1)[order]
    run(start[:, :1].copy(), start[:, 1:].copy(), True)
    return out


def settled(step, state: tuple, longest: int) -> np.ndarray:
    """The gains that `step` gives again and again, from the second row on, until they don't change any more."""
    gains = [(0.0, 0.0)]
    while len(gains) < longest:
        state, gain = step(state)
        if len(gains) > 1 and gain == gains[-1]:
            break
        gains.append(gain)
    return np.array(gains)


def kalman_smooth(dets: DataFrame, keys: list[str], model: str = "box") -> DataFrame:
    """Filtered centres and sizes of each track's measurements, one step per measurement. model: box or xyah.

    box: 30 steps a second, centre with velocity, static size; its gains follow from the row's number alone. xyah: one step a
    frame; centre, aspect, height with velocity and noise in shares of the filtered height.
    """
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    third = w.alias("w") if model == "box" else (w / h).alias("r")
    rows = dets.select(*keys, "frame_no", ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"), third, h.alias("h"))
    names = ["cx", "cy", "w", "h", "vcx", "vcy"] if model == "box" else ["cx", "cy", "r", "h", "vcx", "vcy", "vr", "vh"]
    return _along(rows, keys, names, _box_run if model == "box" else _xyah_run)


def _box_run(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    dt, q = 1 / 30, 5000.0

    def moving(state):
        a = Axis(0.0, 0.0, 0.0)
        a.a, a.b, a.c = state
        a.predict(dt, q * dt**4 / 4, q * dt**3 / 2, q * dt**2)
        gain = a.a / (a.a + 0.1), a.b / (a.a + 0.1)
        a.update(0.0, 0.1)
        return (a.a, a.b, a.c), gain

    def still(p):
        p += 10.0
        return p * (1 - p / (p + 1.0)), (p / (p + 1.0), 0.0)

    longest = int(lengths.max(initial=1))
    move, stay = settled(moving, (1000.0, 0.0, 1000.0), longest), settled(still, 1000.0, longest)
    cx, cy = (linear_scan(values[:, k], lengths, move, dt) for k in (0, 1))
    w, h = (linear_scan(values[:, k], lengths, stay, 0.0)[:, 0] for k in (2, 3))
    return np.stack([cx[:, 0], cy[:, 0], w, h, cx[:, 1], cy[:, 1]], 1)


def _xyah_run(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A state: four values, their velocities, and the three numbers of each axis' covariance."""

    def step(k, s, z):
        x, v, a, b, c = s[:, :4], s[:, 4:8], s[:, 8:12], s[:, 12:16], s[:, 16:]
        aspect = np.arange(4) == 2
        if k == 0:
            hh = (z[:, 3] * z[:, 3])[:, None]
            return np.concatenate([z, np.zeros_like(z), np.where(aspect, 1e-4, hh * 0.01), np.zeros_like(z), np.where(aspect, 1e-10, hh * (10 / 160) ** 2)], 1)
        hh, then = (x[:, 3] ** 2)[:, None], ((x[:, 3] + v[:, 3]) ** 2)[:, None]
        a = a + 2 * b + c + np.where(aspect, 1e-4, hh * 0.0025)
        b, c = b + c, c + np.where(aspect, 1e-10, hh * (1 / 160) ** 2)
        total = a + np.where(aspect, 1e-2, then * 0.0025)
        off = z - x - v
        return np.concatenate([x + v + a / total * off, v + b / total * off, a * (1 - a / total), b * (1 - a / total), c - b / total * b], 1)

    return by_steps(values, lengths, 20, step)[:, :8]


def _mean_run(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    keep = np.array([0.8, 0.5, 0.5, 0.5, 0.5])
    return by_steps(values, lengths, 5, lambda k, s, z: z if k == 0 else s * keep + z * (1 - keep))


def smooth_tracks(tracks: DataFrame, keys: list[str], feature: str | None = None) -> DataFrame:
    """Score as .8 old + .2 new, box as half old and half new, class as the most frequent so far (the one seen first on ties).

    feature: a column with an array of numbers, which goes on as .9 old + .1 new; a null leaves it as it is.
    """
    num = _along(tracks.select(*keys, "frame_no", "score", *BOX), keys, ["score", *BOX], _mean_run)
    so_far = Window.partitionBy(*keys).orderBy("frame_no")
    per = tracks.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "class_id").orderBy("frame_no"))).withColumn("_first", F.min("frame_no").over(Window.partitionBy(*keys, "class_id")))
    best = per.withColumn("_b", F.max(F.struct("_n", (-F.col("_first")).alias("f"), "class_id")).over(so_far))
    out = num.join(best.select(*keys, "frame_no", F.col("_b.class_id").alias("class_id")), [*keys, "frame_no"])
    return out if feature is None else out.join(_mean_features(tracks, keys, feature), [*keys, "frame_no"])


def _mean_features(tracks: DataFrame, keys: list[str], feature: str) -> DataFrame:
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("frame_no")
        state, out = None, []
        for x in g[feature]:
            if x is not None:
                new = np.asarray(x, float)
                state = new if state is None else 0.9 * state + 0.1 * new
            out.append(state)
        return g.assign(**{feature: out})

    rows = tracks.select(*keys, "frame_no", F.col(feature).cast("array<double>").alias(feature))
    return dealt(rows, *keys).groupBy(*keys).applyInPandas(run, rows.schema)


def dedupe_tracks(tracked: DataFrame, lost: DataFrame, keys: list[str], limit: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """Of tracked and lost tracks (keys, track_id, age, box) that overlap, keeps the older; the lost one on ties."""
    pairs = iou_pairs(tracked.withColumnRenamed("track_id", "a_id"), lost.withColumnRenamed("track_id", "b_id"), keys, 0.0, only_overlapping=limit <= 1).where(1 - F.col("iou") < limit)
    pairs = pairs.join(tracked.select(*keys, F.col("track_id").alias("a_id"), F.col("age").alias("a_age")), [*keys, "a_id"]).join(lost.select(*keys, F.col("track_id").alias("b_id"), F.col("age").alias("b_age")), [*keys, "b_id"])
    older = F.col("a_age") > F.col("b_age")
    return (
        tracked.join(pairs.where(~older).select(*keys, F.col("a_id").alias("track_id")).distinct(), [*keys, "track_id"], "left_anti"),
        lost.join(pairs.where(older).select(*keys, F.col("b_id").alias("track_id")).distinct(), [*keys, "track_id"], "left_anti"),
    )


def history_sample(tracks: DataFrame, keys: list[str], n: int = 4) -> DataFrame:
    """The detections (frame_no) that stay: the first n, then the oldest makes way once a track is n times as old as it."""
    rows = tracks.groupBy(*keys).agg(F.sort_array(F.collect_list("frame_no")).alias("m"), F.min("frame_no").alias("start"))
    none = F.filter("m", lambda x: F.lit(False))

    def step(acc, f):
        full = F.size(acc) >= n
        turn = (f - F.col("start")) >= (acc[0] - F.col("start")) * n
        return F.when(~full, F.concat(acc, F.array(f))).when(turn, F.concat(F.slice(acc, 2, n - 1), F.array(f))).otherwise(acc)

    return rows.select(*keys, F.explode(F.aggregate("m", none, step)).alias("frame_no"))


def display_ids(tracks: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Dense numbers from 0 by first appearance within `by`."""
    first = tracks.groupBy(*by, "track_id").agg(F.min(F.struct(*order)).alias("f"))
    ids = first.select(*by, "track_id", (F.row_number().over(Window.partitionBy(*by).orderBy("f", "track_id")) - 1).alias("display_id"))
    return tracks.join(ids, [*by, "track_id"])


def namespaced_ids(tracks: DataFrame) -> DataFrame:
    return tracks.withColumn("track_id", F.concat_ws("_", F.col("class_id").cast("string"), F.col("track_id").cast("string")))
