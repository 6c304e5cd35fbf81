"""Resizing by weight tables, letterboxing and panorama views.

A mode is a table (dst, src, weight) per axis; weights are whole numbers of 2048ths, so sums are exact in any order.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixeltide.operators.params import clamp, small_table

ONE = 2048
MODES = ("nearest", "nearest_exact", "linear", "area", "cubic", "lanczos4")


def axis_weights(src: int, dst: int, mode: str) -> list[tuple[int, int, int]]:
    """(dst, src, weight) rows; at most 8 taps a position for interpolation, the covered ones for area."""
    out = []
    scale = src / dst
    for d in range(dst):
        if mode == "nearest":
            taps = {min(src - 1, d * src // dst): 1.0}
        elif mode == "nearest_exact":
            taps = {min(src - 1, int((d + 0.5) * scale)): 1.0}
        elif mode == "area" and scale > 1:
            lo, hi = d * scale, (d + 1) * scale
            taps = {s: (min(hi, s + 1) - max(lo, s)) / scale for s in range(int(lo), min(src, math.ceil(hi)))}
        else:
            at = (d + 0.5) * scale - 0.5
            base = math.floor(at)
            t = at - base
            if mode == "cubic":
                a = -0.75

                def w(x):
                    x = abs(x)
                    return (a + 2) * x**3 - (a + 3) * x**2 + 1 if x <= 1 else a * x**3 - 5 * a * x**2 + 8 * a * x - 4 * a

                raw = [(base + k, w(k - t)) for k in (-1, 0, 1, 2)]
            elif mode == "lanczos4":
                sinc = lambda x: 1.0 if abs(x) < 1e-9 else math.sin(math.pi * x) / (math.pi * x)
                raw = [(base + k, sinc(k - t) * sinc((k - t) / 4)) for k in range(-3, 5)]
            else:
                raw = [(base, 1 - t), (base + 1, t)]
            taps = {}
            for s, x in raw:
                s = min(src - 1, max(0, s))
                taps[s] = taps.get(s, 0.0) + x
        total = sum(taps.values())
        whole = {s: round(x / total * ONE) for s, x in taps.items()}
        top = max(sorted(whole), key=lambda s: whole[s])
        whole[top] += ONE - sum(whole.values())
        out += [(d, s, x) for s, x in sorted(whole.items()) if x]
    return out


def resample(px: DataFrame, wx: list[tuple[int, int, int]], wy: list[tuple[int, int, int]]) -> DataFrame:
    """Columns first, then rows; each is a broadcast join and a sum."""
    tx = small_table(px.sparkSession, wx, "nx int, x int, a long")
    ty = small_table(px.sparkSession, wy, "ny int, y int, b long")
    along = px.join(tx, "x").groupBy("frame_id", "y", F.col("nx").alias("x"), "c").agg(F.sum(F.col("v") * F.col("a")).alias("s"))
    both = along.join(ty, "y").groupBy("frame_id", F.col("ny").alias("y"), "x", "c").agg(F.sum(F.col("s") * F.col("b")).alias("s"))
    v = F.shiftright(F.col("s") + ONE * ONE // 2, 22)
    return both.select("frame_id", "y", "x", "c", F.least(F.lit(255), F.greatest(F.lit(0), v)).cast("int").alias("v"))


def resize(px: DataFrame, width: int, height: int, new_width: int = 960, new_height: int = 540, mode: str = "linear") -> DataFrame:
    new_width, new_height = clamp(new_width, 1, 4096), clamp(new_height, 1, 4096)
    return resample(px, axis_weights(width, new_width, mode), axis_weights(height, new_height, mode))


def letterbox(px: DataFrame, width: int, height: int, to_width: int, to_height: int, fill: int = 114) -> DataFrame:
    """Keeps the shape, fills right and below; boxes are divided by the ratio afterwards."""
    ratio = min(to_height / height, to_width / width)
    small = resize(px, width, height, int(width * ratio), int(height * ratio))
    grid = px.select("frame_id", "c").distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(to_height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(to_width - 1))))
    return grid.join(small, ["frame_id", "y", "x", "c"], "left").select("frame_id", "y", "x", "c", F.coalesce("v", F.lit(fill)).alias("v"))


def view_map(spark: SparkSession, pitch: float, yaw: float, roll: float, imagepoint: float, in_width: int, in_height: int, width: int = 960, height: int = 540, sensor: float = 0.561, viewpoint: float = -1.0) -> DataFrame:
    """y, x, src_y, src_x: where each pixel of a view looks in an equirectangular frame.

    A ray leaves the viewpoint through the sensor's pixel and meets the unit sphere; the point is turned by roll, pitch
    and yaw (degrees) and read as latitude and longitude.
    """
    p, q, r = (math.radians(clamp(a, 0, 359)) for a in (pitch, yaw, roll))
    imagepoint = clamp(imagepoint, -1.0, 3.0, 3)
    aspect = sensor * height / width
    reach = (imagepoint - viewpoint) or 0.1
    grid = spark.range(width * height).select((F.col("id") % width).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y"))
    u = (F.col("x") * (2 * sensor / width) - sensor) / reach
    v = (F.col("y") * (2 * aspect / height) - aspect) / reach
    g = grid.withColumn("u", u).withColumn("w", v)
    uu = F.col("u") * F.col("u") + F.col("w") * F.col("w")
    # |(t, u(t - e), w(t - e))| = 1 for the viewpoint e on the first axis
    a, b, c = 1 + uu, -2 * viewpoint * uu, viewpoint * viewpoint * uu - 1
    g = g.withColumn("t", (-b + F.sqrt(b * b - 4 * a * c)) / (2 * a))
    x, y, z = F.col("t"), F.col("u") * (F.col("t") - viewpoint), F.col("w") * (F.col("t") - viewpoint)
    y, z = y * math.cos(r) + z * math.sin(r), z * math.cos(r) - y * math.sin(r)
    x, z = x * math.cos(p) - z * math.sin(p), x * math.sin(p) + z * math.cos(p)
    x, y = x * math.cos(q) + y * math.sin(q), y * math.cos(q) - x * math.sin(q)
    g = g.select("y", "x", x.alias("px"), y.alias("py"), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), z)).alias("pz"))
    lat = F.asin("pz")
    side = F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("py") / F.cos(lat))))
    lon = F.when(F.col("px") < 0, F.when(F.col("py") > 0, F.lit(math.pi)).when(F.col("py") < 0, F.lit(-math.pi)).otherwise(0.0) - side).otherwise(side)
    return g.select("y", "x", (lat * in_height / math.pi + in_height / 2).alias("src_y"), (lon * in_width / (2 * math.pi) + in_width / 2).alias("src_x"))


def remap(px: DataFrame, at: DataFrame, width: int, height: int) -> DataFrame:
    """Reads frames at fractional places by 4x4 cubic weights; places outside count as 0."""

    def weight(t, k):
        d, a = F.abs(F.lit(k) - t), -0.75
        return F.when(d <= 1, (a + 2) * d**3 - (a + 3) * d**2 + 1).otherwise(a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a)

    taps = [-1, 0, 1, 2]
    m = at.withColumn("by", F.floor("src_y").cast("int")).withColumn("bx", F.floor("src_x").cast("int"))
    ty, tx = F.col("src_y") - F.col("by"), F.col("src_x") - F.col("bx")
    m = m.withColumn("ky", F.explode(F.array(*[F.struct((F.col("by") + k).alias("sy"), weight(ty, k).alias("wy")) for k in taps])))
    m = m.withColumn("kx", F.explode(F.array(*[F.struct((F.col("bx") + k).alias("sx"), weight(tx, k).alias("wx")) for k in taps])))
    m = m.select("y", "x", F.col("ky.sy").alias("sy"), F.col("kx.sx").alias("sx"), (F.col("ky.wy") * F.col("kx.wx")).alias("wt")).where(f"sy between 0 and {height - 1} and sx between 0 and {width - 1}")
    hit = px.select("frame_id", "c", F.col("y").alias("sy"), F.col("x").alias("sx"), "v").join(m, ["sy", "sx"])
    s = hit.groupBy("frame_id", "y", "x", "c").agg(F.sum(F.col("v") * F.col("wt")).alias("s"))
    return s.select("frame_id", "y", "x", "c", F.least(F.lit(255), F.greatest(F.lit(0), F.bround(F.round("s", 6), 0))).cast("int").alias("v"))


def equirect_view(px: DataFrame, pitch: float, yaw: float, roll: float, imagepoint: float, in_width: int, in_height: int, width: int = 960, height: int = 540) -> DataFrame:
    return remap(px, view_map(px.sparkSession, pitch, yaw, roll, imagepoint, in_width, in_height, width, height), in_width, in_height)
