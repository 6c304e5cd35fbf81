"""Which boxes overlap, by grids: only boxes that share a cell meet.

A box belongs to the grid whose cells are at least as wide as its longest side, so it lies in few cells there. Two boxes meet in the
grid of the larger one, in the cell that holds the lower corner of what they share: each pair once, whatever the sizes are.
Boxes with a missing or non-finite side overlap nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixeltide.operators.rounds import checkpoint

AXES = (("x1", "x2"), ("y1", "y2"))


def side(axes, touch: float) -> Column:
    """The longest side."""
    sides = [F.col(hi) - F.col(lo) + touch for lo, hi in axes]
    return F.greatest(*sides) if len(sides) > 1 else sides[0]


def usable(boxes: DataFrame, axes) -> DataFrame:
    numbers = [F.col(c).cast("double") for pair in axes for c in pair]
    return boxes.where(F.forall(F.array(*numbers), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))


def scale(boxes: DataFrame, axes, touch: float) -> tuple[float, list[int]]:
    """Width of the finest cells, the mean side, and the levels (each twice as wide as the one before) that boxes have."""
    base = boxes.agg(F.avg(F.when(side(axes, touch) > 0, side(axes, touch)))).first()[0] or 1.0
    levels = sorted(r[0] for r in boxes.select(level(axes, touch, base).alias("l")).distinct().collect())  # 1,100 at most: powers of two of a double
    return base, levels


def level(axes, touch: float, base: float) -> Column:
    s = side(axes, touch)
    return F.greatest(F.lit(0), F.ceil(F.log2(F.when(s > base, s / base).otherwise(F.lit(1.0))))).cast("int")


def dealt(boxes: DataFrame, axes, touch: float, base: float, levels: list[int]) -> DataFrame:
    """Each box once for each cell it lies in, in the grid of its level and in the coarser ones that are used.

    Adds _level (the box's), _grid and _c0, _c1, … (the cell).
    """
    out = boxes.withColumn("_level", level(axes, touch, base))
    used = F.array(*[F.lit(k) for k in levels]) if levels else F.array().cast("array<int>")
    out = out.withColumn("_grid", F.explode(F.filter(used, lambda k: k >= F.col("_level"))))
    width = F.lit(base) * F.pow(F.lit(2.0), F.col("_grid"))
    for k, (lo, hi) in enumerate(axes):
        first, last = F.floor(F.col(lo) / width), F.floor((F.col(hi) + touch) / width)
        out = out.withColumn(f"_c{k}", F.explode(F.sequence(first, F.greatest(first, last))))
    return out


def meets(a: str, b: str, axes, touch: float, base: float) -> Column:
    """Of rows dealt to the same cell, with their boxes in the structs a and b: whether they overlap, and this is their cell."""
    width = F.lit(base) * F.pow(F.lit(2.0), F.col("_grid"))
    ok = F.greatest(F.col(f"{a}._level"), F.col(f"{b}._level")) == F.col("_grid")
    for k, (lo, hi) in enumerate(axes):
        low = F.greatest(F.col(f"{a}.{lo}"), F.col(f"{b}.{lo}"))
        ok &= (F.least(F.col(f"{a}.{hi}"), F.col(f"{b}.{hi}")) - low + touch > 0) & (F.floor(low / width) == F.col(f"_c{k}"))
    return ok


FEW = 32  # boxes of b with the same keys that meet all of a without a grid


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], axes=AXES, touch: float = 0.0) -> DataFrame:
    """keys, p, q: the rows of a and b (as structs) with the same keys whose boxes share more than an edge (with touch 1: a pixel).

    Where b has FEW boxes at most, all pairs are fewer rows than the cells that both lie in; crowded keys go by grids.
    """
    a, b = usable(a, axes), usable(b, axes)
    crowd = checkpoint(b.groupBy(*keys).count().where(F.col("count") > FEW).select(*keys))
    if crowd.isEmpty():
        return _by_pairs(a, b, keys, axes, touch)
    many = _by_grids(a.join(crowd, keys, "left_semi"), b.join(crowd, keys, "left_semi"), keys, axes, touch)
    return many.unionByName(_by_pairs(a.join(crowd, keys, "left_anti"), b.join(crowd, keys, "left_anti"), keys, axes, touch))


def _by_pairs(a: DataFrame, b: DataFrame, keys: list[str], axes, touch: float) -> DataFrame:
    met = a.select(*keys, F.struct(*a.columns).alias("p")).join(b.select(*keys, F.struct(*b.columns).alias("q")), keys)
    for lo, hi in axes:
        met = met.where(F.least(F.col(f"p.{hi}"), F.col(f"q.{hi}")) - F.greatest(F.col(f"p.{lo}"), F.col(f"q.{lo}")) + touch > 0)
    return met.select(*keys, "p", "q")


def _by_grids(a: DataFrame, b: DataFrame, keys: list[str], axes, touch: float) -> DataFrame:
    corners = [c for pair in axes for c in pair]
    base, levels = scale(a.select(*corners).union(b.select(*corners)), axes, touch)
    cells = ["_grid", *[f"_c{k}" for k in range(len(axes))]]

    def packed(rows: DataFrame, name: str) -> DataFrame:
        out = dealt(rows, axes, touch, base, levels)
        return out.select(*keys, *cells, F.struct(*rows.columns, "_level").alias(name))

    met = packed(a, "p").join(packed(b, "q"), [*keys, *cells])
    plain = lambda name, rows: F.struct(*[F.col(f"{name}.{c}").alias(c) for c in rows.columns]).alias(name)
    return met.where(meets("p", "q", axes, touch, base)).select(*keys, plain("p", a), plain("q", b))
