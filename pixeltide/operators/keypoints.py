"""Landmarks (frame_id, obj_id, kp_id, x, y, score) and what is read off them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixeltide.operators.params import small_table

OBJ = ["frame_id", "obj_id"]


def scale_keypoints(kp: DataFrame, width: int, height: int, clamp: bool = True) -> DataFrame:
    """Shares of the sides to whole pixels, at most the last one."""
    x, y = (F.col("x") * width).cast("int"), (F.col("y") * height).cast("int")
    return kp.withColumn("x", F.least(x, F.lit(width - 1)) if clamp else x).withColumn("y", F.least(y, F.lit(height - 1)) if clamp else y)


def unpack_multipose(poses: DataFrame, width: int, height: int) -> DataFrame:
    """From poses(frame_id, obj_id, values array of 56): 17 points as (y, x, score), then box and score at 51..55."""
    v = F.col("values")
    points = F.array(*[F.struct(F.lit(k).alias("kp_id"), (v[3 * k + 1] * width).cast("int").alias("x"), (v[3 * k] * height).cast("int").alias("y"), v[3 * k + 2].alias("score")) for k in range(17)])
    box = [(v[52] * width).cast("int").alias("x1"), (v[51] * height).cast("int").alias("y1"), (v[54] * width).cast("int").alias("x2"), (v[53] * height).cast("int").alias("y2"), v[55].alias("box_score")]
    return poses.select(*OBJ, *box, F.inline(points))


#: The hand points around the palm.
PALM = [0, 1, 5, 9, 13, 17]


def palm_moment(kp: DataFrame) -> DataFrame:
    """Centroid (whole pixels) of the polygon of the palm points; (0, 0) if it has no area."""
    ring = kp.where(F.col("kp_id").isin(PALM))
    w = Window.partitionBy(*OBJ).orderBy("kp_id")
    whole = Window.partitionBy(*OBJ).orderBy("kp_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = F.coalesce(F.lead("x").over(w), F.first("x").over(whole)), F.coalesce(F.lead("y").over(w), F.first("y").over(whole))
    e = ring.select(*OBJ, "x", "y", nx.alias("nx"), ny.alias("ny")).withColumn("k", F.col("x") * F.col("ny") - F.col("nx") * F.col("y"))
    s = e.groupBy(*OBJ).agg(F.sum("k").alias("a"), F.sum((F.col("x") + F.col("nx")) * F.col("k")).alias("mx"), F.sum((F.col("y") + F.col("ny")) * F.col("k")).alias("my"))
    part = lambda m: F.when(F.col("a") == 0, 0).otherwise((F.col(m) / (3.0 * F.col("a"))).cast("int"))
    return s.select(*OBJ, part("mx").alias("cx"), part("my").alias("cy"))


def chain(*points: int) -> list[tuple[int, int]]:
    return list(zip(points, points[1:], strict=False))


#: The edges of each skeleton, as pairs of landmark ids.
EDGES = {
    "movenet": [(0, 1), (0, 2), (1, 3), (2, 4), (5, 6), *chain(5, 7, 9), *chain(6, 8, 10), (11, 12), *chain(5, 11, 13, 15), *chain(6, 12, 14, 16)],
    "hand": [*chain(2, 3, 4), *chain(5, 6, 7, 8), *chain(9, 10, 11, 12), *chain(13, 14, 15, 16), *chain(17, 18, 19, 20), *chain(0, 1, 2, 5, 9, 13, 17, 0)],
    "blazepose": [*chain(1, 2, 3), *chain(4, 5, 6), (9, 10), (11, 12), *chain(11, 13, 15), *chain(12, 14, 16), *chain(15, 17, 19, 21, 15), *chain(16, 18, 20, 22, 16), *chain(11, 23, 25, 27, 29, 31), *chain(12, 24, 26, 28, 30, 32), (23, 24)],
    "face_mesh": [
        *chain(55, 65, 52, 53, 46),
        *chain(285, 295, 282, 283, 276),
        *chain(133, 173, 157, 158, 159, 160, 161, 246, 163, 144, 145, 153, 154, 155, 133),
        *chain(362, 398, 384, 385, 386, 387, 388, 466, 390, 373, 374, 380, 381, 382, 362),
        *chain(308, 415, 310, 311, 312, 13, 82, 81, 80, 191, 78, 95, 88, 178, 87, 14, 317, 402, 318, 324, 308),
    ],
}


def skeleton_edges(kp: DataFrame, model: str, th: float | None) -> DataFrame:
    """frame_id, obj_id, a, b and both ends, for edges whose ends both score over th (all edges if th is None)."""
    edges = small_table(kp.sparkSession, EDGES[model], "a int, b int")
    own = kp if th is None else kp.where(F.col("score") > th)
    end = lambda n: own.select(*OBJ, F.col("kp_id").alias(n), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y"))
    return end("a").join(edges, "a").join(end("b"), [*OBJ, "b"]).select(*OBJ, "a", "b", "ax", "ay", "bx", "by")


def visible_points(kp: DataFrame, th: float) -> DataFrame:
    return kp.where(F.col("score") >= th)
