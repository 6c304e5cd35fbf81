"""Annotation records (frame_id, kind, x1, y1, x2, y2, text, b, g, r, thickness) of results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixeltide.operators.detect import score_filter

COLUMNS = ["frame_id", "kind", "x1", "y1", "x2", "y2", "text", "b", "g", "r", "thickness"]


def class_color(i: Column) -> list[Column]:
    t = F.abs(i + 35) * 3
    return [(29 * t % 255).cast("int").alias("b"), (17 * t % 255).cast("int").alias("g"), (37 * t % 255).cast("int").alias("r")]


def with_labels(df: DataFrame, labels: DataFrame, by: str = "class_id", name: str = "name") -> DataFrame:
    """A left join with labels(class_id, name), which Spark broadcasts while they are small."""
    return df.join(labels.select(F.col("class_id").alias(by), F.col("name").alias(name)), by, "left")


def _record(df: DataFrame, kind: str, x1, y1, x2, y2, text, color, thickness: int) -> DataFrame:
    whole = lambda e: (e if isinstance(e, Column) else F.lit(e)).cast("int")
    return df.select("frame_id", F.lit(kind).alias("kind"), whole(x1).alias("x1"), whole(y1).alias("y1"), whole(x2).alias("x2"), whole(y2).alias("y2"), (text if isinstance(text, Column) else F.lit(text).cast("string")).alias("text"), *color, F.lit(thickness).alias("thickness"))


def green() -> list[Column]:
    return [F.lit(0).alias("b"), F.lit(255).alias("g"), F.lit(0).alias("r")]


def _corner(c: str) -> Column:
    return F.col(c).cast("int")


def _tag(cid: str, name: str, score: str) -> Column:
    return F.format_string("%d:%s(%.2f)", cid, name, score)


def annotate_detections(det: DataFrame, labels: DataFrame, th: float) -> DataFrame:
    """A box and its label 12 above it, in the class's colour."""
    d = with_labels(score_filter(det, th), labels)
    x1, y1, x2, y2 = map(_corner, ("x1", "y1", "x2", "y2"))
    color = class_color(F.col("class_id"))
    return _record(d, "box", x1, y1, x2, y2, None, color, 3).unionByName(_record(d, "text", x1, y1 - 12, x1, y1 - 12, _tag("class_id", "name", "score"), color, 3))


def annotate_classes(top: DataFrame, labels: DataFrame) -> DataFrame:
    """A line for each ranked class, 35 apart."""
    d = with_labels(top, labels)
    y = 30 + (F.col("rank") - 1) * 35
    return _record(d, "text", 15, y, 15, y, _tag("class_id", "name", "score"), green(), 3)


def annotate_crop_classes(det: DataFrame, labels: DataFrame, crop_labels: DataFrame, th: float) -> DataFrame:
    """Box, detection line and classification line of det(..., crop_class, crop_score)."""
    d = with_labels(with_labels(score_filter(det, th), labels), crop_labels, "crop_class", "crop_name")
    x1, y1, x2, y2 = map(_corner, ("x1", "y1", "x2", "y2"))
    color = class_color(F.col("class_id"))
    one = F.concat(F.lit("Detection("), _tag("class_id", "name", "score"), F.lit(")"))
    two = F.concat(F.lit("Classification("), _tag("crop_class", "crop_name", "crop_score"), F.lit(")"))
    parts = [_record(d, "box", x1, y1, x2, y2, None, color, 3), _record(d, "text", x1, y1 - 36, x1, y1 - 36, one, color, 3), _record(d, "text", x1, y1 - 12, x1, y1 - 12, two, color, 3)]
    return reduce(DataFrame.unionByName, parts)


def annotate_tracks(tracks: DataFrame, labels: DataFrame) -> DataFrame:
    """Box, track line and class line of tracks(frame_id, display_id, ...), in the track's colour."""
    d = with_labels(tracks, labels)
    x1, y1, x2, y2 = map(_corner, ("x1", "y1", "x2", "y2"))
    color = class_color(F.col("display_id"))
    one, two = F.format_string("TID:%d(%.2f)", "display_id", "score"), F.format_string("CID:%d(%s)", "class_id", "name")
    parts = [_record(d, "box", x1, y1, x2, y2, None, color, 2), _record(d, "text", x1, y1 - 36, x1, y1 - 36, one, color, 2), _record(d, "text", x1, y1 - 12, x1, y1 - 12, two, color, 2)]
    return reduce(DataFrame.unionByName, parts)


def annotate_text(frames: DataFrame, text: str, elapsed: Column | None = None) -> DataFrame:
    """A user's text, and the elapsed time in the next line (the first if there is no text)."""
    parts = [_record(frames, "text", 15, 30, 15, 30, text, green(), 2)] if text else []
    if elapsed is not None:
        y = 60 if text else 30
        parts.append(_record(frames, "text", 15, y, 15, y, F.concat(F.lit("Elapsed time: "), elapsed), green(), 2))
    return reduce(DataFrame.unionByName, parts) if parts else _record(frames.limit(0), "text", 0, 0, 0, 0, None, green(), 2)


def annotate_points(points: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Landmarks as points and skeleton edges as lines."""
    out = _record(points, "point", F.col("x"), F.col("y"), F.col("x"), F.col("y"), None, green(), 5)
    return out if edges is None else out.unionByName(_record(edges, "line", F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), None, green(), 2))


def annotate(**results: DataFrame) -> DataFrame:
    """All records of several results: any of the above by keyword, united."""
    return reduce(DataFrame.unionByName, [df.select(*COLUMNS) for df in results.values()])
