"""Frames put together: blended, tiled, interpolated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixeltide.operators.params import clamp, saturate
from pixeltide.operators.resample import resize

AT = ["frame_id", "y", "x", "c"]


def alpha_blend(a: DataFrame, b: DataFrame, alpha: float = 1.0, beta: float = 0.3, gamma: float = 0.0, sizes: tuple[int, int, int, int] | None = None) -> DataFrame:
    """a * alpha + b * beta + gamma; sizes (width and height of a, of b) resizes b; a frame without a partner passes."""
    alpha, beta, gamma = clamp(alpha, 0.0, 1.0, 3), clamp(beta, 0.0, 1.0, 3), clamp(gamma, 0.0, 255.0, 3)
    if sizes and sizes[:2] != sizes[2:]:
        b = resize(b, sizes[2], sizes[3], sizes[0], sizes[1])
    j = a.join(b.select(*AT, F.col("v").alias("w")), AT, "full")
    v, w = F.col("v"), F.col("w")
    return j.select(*AT, F.when(w.isNull(), v).when(v.isNull(), w).otherwise(saturate(v * alpha + w * beta + gamma)).alias("v"))


SHAPES = {1: (1, 1), 2: (2, 2), 3: (2, 2), 4: (2, 2), 5: (3, 2), 6: (3, 2), 7: (3, 3), 8: (3, 3), 9: (3, 3)}


def concat_grid(slots: list[DataFrame | None], size: tuple[int, int], sizes: list[tuple[int, int]] | None = None) -> DataFrame | None:
    """Up to nine slots in a grid of cells of one size, the last slot first; frames that a slot lacks are black."""
    n = len(slots)
    present = [s for s in slots if s is not None]
    if not present:
        return None
    columns, rows = SHAPES[n]
    w, h = size
    top = h // 2 if n == 2 else 0  # two slots stand in the middle of two rows
    parts = []
    for k, s in enumerate(reversed(slots)):
        if s is None:
            continue
        own = sizes[n - 1 - k] if sizes else size
        if own != size:
            s = resize(s, *own, *size)
        parts.append(s.select("frame_id", (F.col("y") + k // columns * h + top).alias("y"), (F.col("x") + k % columns * w).alias("x"), "c", "v"))
    tiles = reduce(DataFrame.unionByName, parts)
    canvas = tiles.select("frame_id", "c").distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(rows * h - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(columns * w - 1))))
    return canvas.join(tiles, AT, "left").select(*AT, F.coalesce("v", F.lit(0)).alias("v"))


def interpolate_frames(px: DataFrame, alpha: float) -> DataFrame:
    """(1 - alpha) * frame + alpha * the next one of px(source_id, frame_id, y, x, c, v)."""
    w = Window.partitionBy("source_id", "y", "x", "c").orderBy("frame_id")
    out = px.withColumn("_n", F.lead("v").over(w)).where("_n is not null")
    return out.select("source_id", *AT, saturate(F.col("v") * (1 - alpha) + F.col("_n") * alpha).alias("v"))
