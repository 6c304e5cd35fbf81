"""Statistics of frames and of the nodes that process them."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixeltide.operators.resample import ONE, axis_weights
from pixeltide.operators.stencil import mirror, mscn, normalised, side_of, tiled


def rgb_histogram(px: DataFrame) -> DataFrame:
    """frame_id, c, v, n for all 256 values of each channel; ceiling: a plot's upper end, a 32nd of channel 0's pixels."""
    counts = px.groupBy("frame_id", "c", "v").agg(F.count("*").alias("n"))
    frames = counts.groupBy("frame_id").agg(F.sum(F.when(F.col("c") == 0, F.col("n"))).alias("pixels"), F.collect_set("c").alias("cs"))
    grid = frames.select("frame_id", F.floor(F.coalesce("pixels", F.lit(0)) / 32).alias("ceiling"), F.explode("cs").alias("c")).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(255))))
    return grid.join(counts, ["frame_id", "c", "v"], "left").select("frame_id", "c", "v", F.coalesce("n", F.lit(0)).alias("n"), "ceiling")


def latency_text(ms):
    """Whole milliseconds as text: at least four digits and the unit."""
    text = ms.cast("string")
    return F.concat(F.lpad(text, F.greatest(F.lit(4), F.length(text)), "0"), F.lit("ms"))


def parse_latency(text):
    """The number in a latency text; null where it has no digit."""
    digits = F.regexp_replace(text, r"\D", "")
    return F.when(digits != "", digits.cast("int"))


LAST = 10
BLOCK = 100_000


def _rate(mean):
    return F.when(mean > 0, 1000.0 / mean).otherwise(0.0)


def _rate_text(rate):
    return F.concat(F.lit("FPS:"), F.when(rate > 1, F.lpad(F.floor(rate).cast("string"), F.greatest(F.lit(3), F.length(F.floor(rate).cast("string"))), "0")).otherwise(F.format_string("%.2f", rate)))


def with_halo(latency: DataFrame, rows: int, block: int = BLOCK) -> DataFrame:
    """Adds _b, the block of seq, and to each block of a node the `rows` rows before it, marked by _own false.

    A block's last rows are an array of at most that many; the arrays of as many filled blocks hold what the next one needs.
    """
    own = latency.withColumn("_b", F.floor(F.col("seq") / block)).withColumn("_own", F.lit(True))
    nth = F.row_number().over(Window.partitionBy("node", "_b").orderBy(F.desc("seq")))
    row = F.struct("seq", "elapsed_ms")
    ends = own.withColumn("_r", nth).where(F.col("_r") <= rows).groupBy("node", "_b").agg(F.sort_array(F.collect_list(row)).alias("_e"))
    before = F.flatten(F.collect_list("_e").over(Window.partitionBy("node").orderBy("_b").rowsBetween(-rows, -1)))
    halo = ends.withColumn("_h", before).select("node", "_b", F.inline(F.slice("_h", F.greatest(F.lit(1), F.size("_h") - rows + 1), F.lit(rows))))
    return own.unionByName(halo.withColumn("_own", F.lit(False)), allowMissingColumns=True)


def fps(latency: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per node and tick of latency(node, seq, elapsed_ms): the mean of the last 10, the rate and its text.

    A busy node is dealt out in blocks of seq, each with the rows before it that its first means need.
    """
    last = Window.partitionBy("node", "_b").orderBy("seq").rowsBetween(-(LAST - 1), 0)
    out = with_halo(latency, LAST - 1, block).withColumn("mean_ms", F.avg("elapsed_ms").over(last)).where("_own").drop("_b", "_own")
    out = out.withColumn("fps", _rate(F.col("mean_ms")))
    return out.withColumn("label", F.concat(_rate_text(F.col("fps")), F.lit(" ("), latency_text(F.col("elapsed_ms")), F.lit(")")))


def total_fps(latency: DataFrame) -> DataFrame:
    """seq, total_ms (the nodes' means at that tick), fps, label."""
    total = fps(latency).groupBy("seq").agg(F.round(F.sum("mean_ms"), 6).alias("total_ms"))  # rounded: the order of a sum is open
    return total.withColumn("fps", _rate(F.col("total_ms"))).withColumn("label", _rate_text(F.col("fps")))


def depth_stats(px: DataFrame) -> DataFrame:
    """Per frame: least, most and mean value, and the quartiles."""
    q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return px.groupBy("frame_id").agg(F.min("v").alias("v_min"), F.max("v").alias("v_max"), F.avg("v").alias("v_mean"), q.alias("q")).select("frame_id", "v_min", "v_max", "v_mean", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"))


def mscn_moments(px: DataFrame) -> DataFrame:
    """frame_id, n, mean, mean square and mean size of the normalised luminance."""
    m = mscn(px)
    return m.groupBy("frame_id").agg(F.count("*").alias("n"), F.avg("m").alias("m1"), F.avg(F.col("m") * F.col("m")).alias("m2"), F.avg(F.abs("m")).alias("mabs"))


def _shapes() -> list[tuple[float, float]]:
    """(shape, squared mean size over mean square) of generalised Gaussians, for reading the shape back from moments."""
    g = math.gamma
    return [(a / 1000, g(2000 / a) ** 2 / (g(1000 / a) * g(3000 / a))) for a in range(200, 10001, 5)]


def nearest_shape(r: np.ndarray) -> np.ndarray:
    """The shape whose ratio is nearest, the smaller one on ties; the smallest where r is no finite number."""
    alpha, ratio = np.array(_shapes()).T  # the ratio rises with the shape
    i = np.clip(np.searchsorted(ratio, r), 1, len(ratio) - 1)
    i = np.where(np.abs(ratio[i] - r) < np.abs(ratio[i - 1] - r), i, i - 1)
    return alpha[np.where(np.isfinite(r), i, 0)]


def _shape(r: pd.Series) -> pd.Series:
    return pd.Series(nearest_shape(r.to_numpy()))


REACH = 4  # a neighbour, and what its normalised value needs


@lru_cache(1024)
def _halves(n: int, first: int, size: int) -> tuple[int, int, list[tuple[int, int, int]]]:
    """Along an axis of n at half size: the first position whose pixels begin in a tile, how many do, and (row, source, weight)
    for them and REACH more on each side, mirrored."""
    m = max(1, n // 2)
    taps: dict[int, list] = {}
    for d, s, weight in axis_weights(n, m, "area"):
        taps.setdefault(d, []).append((s, weight))
    own = [d for d in range(m) if first <= taps[d][0][0] < first + size]
    rows = range(own[0] - REACH, own[-1] + 1 + REACH) if own else []
    return own[0] if own else 0, len(own), [(k, s, weight) for k, d in enumerate(rows) for s, weight in taps[mirror(d, m)]]


def _scene_sums(block: np.ndarray, border: int, y0: int, x0: int, h: int, w: int, height: int, width: int) -> np.ndarray:
    """Of each block: for the normalised values and their products with the right, lower, lower right and upper right neighbour
    the number, sums of squares and of sizes, and number and sum of squares of the negative and of the positive ones."""
    m = normalised(block[:, border - REACH : border + h + REACH, border - REACH + 1 : border + w + REACH], h + 2, w + 1)
    own = m[:, 1 : h + 1, :w]
    right, down, up = w - (x0 + w >= width), h - (y0 + h >= height), int(y0 == 0)  # the frame ends there
    products = [
        own,
        own[:, :, :right] * m[:, 1 : h + 1, 1 : right + 1],
        own[:, :down] * m[:, 2 : down + 2, :w],
        own[:, :down, :right] * m[:, 2 : down + 2, 1 : right + 1],
        own[:, up:, :right] * m[:, up:h, 1 : right + 1],
    ]
    out = []
    for p in products:
        sq, less, more = p * p, p < 0, ~(p <= 0)
        over = lambda a: a.sum((1, 2), dtype=float)
        out.append(np.stack([over(np.ones(p.shape)), over(sq), over(np.abs(p)), over(less), over(np.where(less, sq, 0)), over(more), over(np.where(more, sq, 0))], 1))
    return np.stack(out, 1)


def brisque_features(px: DataFrame, width: int = 8, height: int = 8, ranges: DataFrame | None = None, tile: int | None = None) -> DataFrame:
    """frame_id, feature (1..36), value: natural-scene statistics of gray frames (1..18), and of them at half size (19..36).

    The first two of a scale are the shape and variance of the normalised luminance; then for each of the four neighbour
    products the shape, mean, and the left and right variance of its asymmetric fit. Tiles give sums at both scales, in one
    exchange of the pixels. ranges(feature, low, high) scales the features to -1..1, as a score model wants them.
    """
    side = side_of(REACH, tile)
    border = REACH if max(width, height) <= side else 3 * REACH  # a tile's border at half size takes more of the frame
    names = ["n", "m2", "mabs", "ln", "lv", "rn", "rv"]

    def run(blocks, y0, x0, h, w):
        (top, rows, ys), (left, columns, xs) = _halves(height, y0, h), _halves(width, x0, w)
        sums = [_scene_sums(blocks, border, y0, x0, h, w, height, width)]
        if rows and columns:
            down, along = np.zeros((rows + 2 * REACH, blocks.shape[1])), np.zeros((columns + 2 * REACH, blocks.shape[2]))
            for table, taps, first in ((down, ys, y0), (along, xs, x0)):
                for i, s, weight in taps:
                    table[i, s - first + border] = weight
            total = down @ np.nan_to_num(blocks) @ along.T  # whole numbers, as resize has them
            small = np.clip(np.floor((total + ONE * ONE // 2) / (ONE * ONE)), 0, 255)
            sums.append(_scene_sums(small, REACH, top, left, rows, columns, max(1, height // 2), max(1, width // 2)))
        s = np.concatenate(sums, 1)
        flat = s.reshape(-1, len(names))
        return np.repeat(np.arange(len(s)), s.shape[1]), {"k": np.tile(np.arange(s.shape[1]), len(s))} | {c: flat[:, i] for i, c in enumerate(names)}

    sums = tiled(px, "v", "float64", run, "k int, " + ", ".join(f"{c} double" for c in names), width, height, border, border, side)
    g = sums.groupBy("frame_id", "k").agg(*[F.sum(c).alias(c) for c in names]).where("n > 0")
    zero = F.lit(0.0)
    mean = lambda s, n: F.when(F.col(n) > 0, F.col(s) / F.col(n)).otherwise(zero).alias(s)
    g = g.select("frame_id", (F.col("k") % 5).alias("k"), F.when(F.col("k") < 5, 0).otherwise(18).alias("shift"), mean("m2", "n"), mean("mabs", "n"), mean("lv", "ln"), mean("rv", "rn"))
    ratio = F.when(F.col("m2") > 0, F.col("mabs") ** 2 / F.col("m2")).otherwise(zero)
    gam = F.when(F.col("rv") > 0, F.sqrt(F.col("lv") / F.col("rv"))).otherwise(F.lit(1.0))
    skewed = ratio * (gam**3 + 1) * (gam + 1) / (gam**2 + 1) ** 2
    g = g.withColumn("alpha", F.pandas_udf(_shape, "double")(F.when(F.col("k") == 0, ratio).otherwise(skewed)))
    at = lambda i: (F.col("shift") + i).cast("int").alias("feature")
    rows = F.when(F.col("k") == 0, F.array(F.struct(at(1), F.col("alpha").alias("value")), F.struct(at(2), F.col("m2").alias("value")))).otherwise(
        F.array(*[F.struct(at(F.col("k") * 4 - 1 + i), v.alias("value")) for i, v in enumerate((F.col("alpha"), F.sqrt("rv") - F.sqrt("lv"), F.col("lv"), F.col("rv")))])
    )
    features = g.select("frame_id", F.inline(rows))
    if ranges is None:
        return features
    span = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low"))
    return features.join(ranges, "feature").select("frame_id", "feature", (-1 + 2 * (F.col("value") - F.col("low")) / span).alias("value"))
