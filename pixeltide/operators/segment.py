"""Segmentation planes (frame_id, class_id, y, x, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixeltide.operators.params import small_table

AT = ["frame_id", "y", "x"]


def mask_argmax(planes: DataFrame) -> DataFrame:
    """One-hot planes: 1 for a pixel's best class (the lowest on ties)."""
    best = planes.groupBy(*AT).agg(F.max(F.struct("v", (-F.col("class_id")).alias("k"))).alias("b"), F.sort_array(F.collect_set("class_id")).alias("cs"))
    return best.select(*AT, (-F.col("b.k")).alias("best"), F.explode("cs").alias("class_id")).select("frame_id", "class_id", "y", "x", (F.col("class_id") == F.col("best")).cast("int").alias("v"))


def mask_threshold(planes: DataFrame, th: float) -> DataFrame:
    return planes.withColumn("v", (F.col("v") > th).cast("int"))


def mask_area(masks: DataFrame) -> DataFrame:
    """Pixels and share of the frame that each class covers."""
    return masks.groupBy("frame_id", "class_id").agg(F.sum("v").alias("area"), F.avg("v").alias("share"))


def class_palette(n: int) -> list[tuple[int, int, int, int]]:
    """(class_id, b, g, r): the bits of class_id + 1 dealt in threes, from the top bit of each channel down."""
    rows = []
    for i in range(1, n + 1):
        bits = [[(i >> (3 * j + c)) & 1 for j in range(8)] for c in range(3)]
        r, g, b = (sum(bit << (7 - j) for j, bit in enumerate(x)) for x in bits)
        rows.append((i - 1, b, g, r))
    return rows


def segmentation_overlay(px: DataFrame, planes: DataFrame, th: float, n_classes: int) -> DataFrame:
    """Class by class in order: where the class is over th its colour, else the image, blended half and half plus 1.

    A pixel without planes stays as it is.
    """
    colors = small_table(px.sparkSession, [(k, c, v) for k, *bgr in class_palette(n_classes) for c, v in enumerate(bgr)], "class_id int, c int, color int")
    layers = planes.join(colors, "class_id").groupBy(*AT, "c").agg(F.sort_array(F.collect_list(F.struct("class_id", (F.col("v") > th).alias("on"), "color"))).alias("layers"))
    both = px.join(layers, [*AT, "c"], "left")
    blend = F.aggregate("layers", F.col("v").cast("double"), lambda acc, k: F.least(F.lit(255.0), F.bround(acc * 0.5 + F.when(k["on"], k["color"].cast("double")).otherwise(acc) * 0.5 + 1.0, 0)))
    return both.select(*AT, "c", F.when(F.col("layers").isNull(), F.col("v")).otherwise(blend.cast("int")).alias("v"))
