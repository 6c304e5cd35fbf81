"""Neighbourhood operators. Borders are mirrored without the edge pixel (… 2 1 | 0 1 2 … n-1 | n-2 …).

A frame is dealt out in tiles; a pixel goes to its tile and to those whose border it is in, in one exchange, and a tile is one
array. So the work spreads over a large frame too, and no pixel is multiplied by the size of a kernel. Tiles at the same place
of many frames are worked on together, so small frames cost no call each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixeltide.operators.params import clamp, saturate, small_table
from pixeltide.operators.rounds import checkpoint, joined


def mirror(i: int, n: int) -> int:
    """The source of position i outside 0..n-1, folded as often as needed."""
    while n > 1 and not 0 <= i < n:
        i = -i if i < 0 else 2 * (n - 1) - i
    return i if n > 1 else 0


TILE = 64


def side_of(reach: int, tile: int | None) -> int:
    """A tile's side: wide enough that its borders are the smaller part."""
    return tile or max(TILE, 4 * reach)


def sources(t: int, n: int, before: int, after: int, tile: int) -> np.ndarray:
    """For each place along an axis of tile t, border included: the position whose value it has, a mirrored one beyond the frame."""
    return np.array([mirror(i, n) for i in range(t * tile - before, min(n, (t + 1) * tile) + after)])


def places(spark, axis: str, n: int, before: int, after: int, tile: int) -> DataFrame:
    """For each position along an axis: the tiles (`_t` + axis) that need it, and its place (`_` + axis) among what they need."""
    rows = []
    for t in range(-(-n // tile)):
        need = sources(t, n, before, after, tile)
        rows += [(p, t, p - int(need.min())) for p in sorted(set(need.tolist()))]
    return small_table(spark, rows, f"{axis} int, _t{axis} int, _{axis} int")


LOT = 1 << 18  # so many values of blocks are worked on at once
_KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def tiled(px: DataFrame, value: str, kind: str, fn, out: str, width: int, height: int, before: int, after: int, tile: int, by_channel: bool = True) -> DataFrame:
    """fn over the tiles of frames with their borders, in one exchange of the pixels.

    fn(blocks, y0, x0, h, w): blocks is an array of tiles at the same place of their frames, each with `before` and `after`
    values more on each side; y0, x0 the first own pixel and h, w the size; gives for each row of the result which block it
    is of, and a dict of columns for `out`. Pixels that a frame lacks are 0. Small frames go by many in a call.
    """
    spark = px.sparkSession
    keys = ["frame_id", "c"] if by_channel else ["frame_id"]
    v = F.col(value).cast("double" if kind == "float64" else "long").alias("v")
    at = px.select(*keys, "y", "x", v).join(places(spark, "y", height, before, after, tile), "y").join(places(spark, "x", width, before, after, tile), "x")
    held = at.groupBy(*keys, "_ty", "_tx").agg(F.collect_list(F.struct("_y", "_x", "v")).alias("p"))
    columns = [c.split() for c in out.split(", ")]

    def lot(b, ty, tx, rows):
        """The result for some rows of a batch, all of the tile ty, tx."""
        y, x = sources(ty, height, before, after, tile), sources(tx, width, before, after, tile)
        lists = [b.column(c).take(pa.array(rows)) for c in ("_y", "_x", "v")]
        which = np.repeat(np.arange(len(rows)), pc.list_value_length(lists[0]).to_numpy())
        raw = np.zeros((len(rows), np.ptp(y) + 1, np.ptp(x) + 1), kind)
        at_y, at_x, v = (c.flatten().to_numpy(zero_copy_only=False) for c in lists)
        raw[which, at_y, at_x] = v
        blocks = raw[:, (y - y.min())[:, None], x - x.min()]
        of, made = fn(blocks, ty * tile, tx * tile, min(tile, height - ty * tile), min(tile, width - tx * tile))
        mine = [b.column(k).take(pa.array(rows[of])) for k in keys]
        return pa.RecordBatch.from_arrays(mine + [made[c] if isinstance(made[c], pa.Array) else pa.array(made[c], _KINDS[k]) for c, k in columns], keys + [c for c, _ in columns])

    def run(batches):
        for b in batches:
            at = np.stack([b.column(c).to_numpy() for c in ("_ty", "_tx")], 1)
            for ty, tx in np.unique(at, axis=0).tolist():
                rows = np.flatnonzero((at == (ty, tx)).all(1))
                many = max(1, LOT // ((min(tile, height) + before + after) * (min(tile, width) + before + after)))
                for i in range(0, len(rows), many):
                    yield lot(b, ty, tx, rows[i : i + many])

    kinds = ", ".join(f"{k} {px.schema[k].dataType.simpleString()}" for k in keys)
    return held.select(*keys, "_ty", "_tx", *[F.col(f"p.{c}").alias(c) for c in ("_y", "_x", "v")]).mapInArrow(run, f"{kinds}, {out}")


def _pixels(n: int, y0: int, x0: int, h: int, w: int, **columns) -> tuple[np.ndarray, dict]:
    """Rows for all pixels of n tiles."""
    y, x = np.mgrid[y0 : y0 + h, x0 : x0 + w]
    return np.repeat(np.arange(n), h * w), {"y": np.tile(y.ravel(), n), "x": np.tile(x.ravel(), n)} | {c: a.ravel() for c, a in columns.items()}


def box_blur(px: DataFrame, k: int, width: int, height: int, tile: int | None = None) -> DataFrame:
    """Mean over k x k: differences of running sums along both axes."""
    k = clamp(k, 1, 128)
    before, after = k // 2, k - 1 - k // 2

    def mean(block, y0, x0, h, w):
        s = np.zeros((len(block), block.shape[1] + 1, block.shape[2] + 1), np.int64)
        s[:, 1:, 1:] = block.cumsum(1).cumsum(2)
        total = s[:, k:, k:] - s[:, :-k, k:] - s[:, k:, :-k] + s[:, :-k, :-k]
        return _pixels(len(block), y0, x0, h, w, v=np.rint(total / (k * k)).astype(int))

    return tiled(px, "v", "int64", mean, "y int, x int, v int", width, height, before, after, side_of(before, tile)).select("frame_id", "y", "x", "c", "v")


def around(block: np.ndarray, kernel, h: int, w: int) -> np.ndarray:
    """Sums of neighbours times weights, for h x w places in the middle of a block, or of each of several."""
    n = len(kernel)
    y, x = (block.shape[-2] - h - n + 1) // 2, (block.shape[-1] - w - n + 1) // 2
    return sum(weight * block[..., y + dy : y + dy + h, x + dx : x + dx + w] for dy, line in enumerate(kernel) for dx, weight in enumerate(line) if weight)


def correlate(px: DataFrame, kernel: list[list[float]], width: int, height: int, value: str = "v", tile: int | None = None) -> DataFrame:
    """Sums of neighbours times weights, unrounded, in the column s."""
    reach = len(kernel) // 2

    def run(block, y0, x0, h, w):
        return _pixels(len(block), y0, x0, h, w, s=around(block, kernel, h, w) + np.zeros((len(block), h, w)))

    return tiled(px, value, "float64", run, "y int, x int, s double", width, height, reach, reach, side_of(reach, tile)).select("frame_id", "y", "x", "c", "s")


def filter3x3(px: DataFrame, kernel: list[list[float]], gain: float, width: int, height: int, tile: int | None = None) -> DataFrame:
    gain = clamp(gain, 0.0, 10.0, 3)
    kernel = [[clamp(w, -1.0, 1.0, 3) * gain for w in line] for line in kernel]
    return correlate(px, kernel, width, height, tile=tile).select("frame_id", "y", "x", "c", saturate(F.col("s")).alias("v"))


SOBEL_X = [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]
SOBEL_Y = [[-1, -2, -1], [0, 0, 0], [1, 2, 1]]


_ROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]


def candidates(block: np.ndarray, lo: int, hi: int, y0: int, x0: int, h: int, w: int, width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a tile and one pixel around it: which are largest across their edge and over lo, and of these which over hi.

    block has three pixels more on each side; beyond the frame there are no gradients.
    """
    h, w = h + 4, w + 4  # the gradients of two pixels around
    gx, gy = around(block, SOBEL_X, h, w), around(block, SOBEL_Y, h, w)
    y, x = np.ogrid[y0 - 2 : y0 - 2 + h, x0 - 2 : x0 - 2 + w]
    inside = (y >= 0) & (y < height) & (x >= 0) & (x < width)
    m = np.where(inside, np.abs(gx) + np.abs(gy), 0)
    near = {(dy, dx): m[1 + dy : h - 1 + dy, 1 + dx : w - 1 + dx] for dy, dx in [*_ROUND, (0, 0)]}
    gx, gy, inside = gx[1:-1, 1:-1], gy[1:-1, 1:-1], inside[1:-1, 1:-1]
    ax, ay = np.abs(gx), np.abs(gy)
    flat, steep = ay * 1000 < ax * 414, ay * 1000 > ax * 2414  # tangents of 22.5 and 67.5 degrees
    same = (gx >= 0) == (gy >= 0)
    along = [flat, steep, same]
    before = np.select(along, [near[0, -1], near[-1, 0], near[-1, -1]], near[-1, 1])
    after = np.select(along, [near[0, 1], near[1, 0], near[1, 1]], near[1, -1])
    on = inside & (near[0, 0] > lo) & (near[0, 0] > before) & (near[0, 0] >= after)
    return on, on & (near[0, 0] > hi)


def labelled(on: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The least code of each place's 8-connected part of `on`; -1 where it is off."""
    big = np.iinfo(np.int64).max
    label = np.full((on.shape[0] + 2, on.shape[1] + 2), big)
    label[1:-1, 1:-1] = np.where(on, codes, big)
    inner = label[1:-1, 1:-1]
    while True:
        least = inner.copy()
        for dy, dx in _ROUND:
            np.minimum(least, label[1 + dy : label.shape[0] - 1 + dy, 1 + dx : label.shape[1] - 1 + dx], out=least)
        least = np.where(on, least, big)
        # a part's own code may have a smaller label already: take it over, so that long chains need few turns
        at = np.flatnonzero(on.ravel())
        order = np.argsort(codes.ravel()[at])
        known, value = codes.ravel()[at][order], least.ravel()[at][order]
        least.ravel()[at] = value[np.searchsorted(known, least.ravel()[at])]
        if (least == inner).all():
            return np.where(on, inner, -1)
        inner[:] = least


EDGES = "y int, x int, label long, strong boolean, other long"


def edge_parts(gray: DataFrame, lo: int, hi: int, width: int, height: int, tile: int | None = None) -> DataFrame:
    """frame_id, y, x, label, strong: edge candidates by the part of their tile they are in; and, where `other` isn't null, that a
    part meets the candidate of that code (y * width + x) in another tile."""
    lo, hi = clamp(lo, 1, 254), clamp(hi, 2, 255)
    if lo > hi:
        lo = hi - 1

    def parts(block, y0, x0, h, w):
        on, strong = candidates(block, lo, hi, y0, x0, h, w, width, height)
        y, x = np.mgrid[y0 - 1 : y0 + h + 1, x0 - 1 : x0 + w + 1]
        codes = y.astype(np.int64) * width + x
        label = np.full(on.shape, -1)
        label[1:-1, 1:-1] = labelled(on[1:-1, 1:-1], codes[1:-1, 1:-1])
        ring = on.copy()
        ring[1:-1, 1:-1] = False
        met = set()
        for i, j in zip(*np.nonzero(ring)):
            for dy, dx in _ROUND:
                if 0 <= i + dy < on.shape[0] and 0 <= j + dx < on.shape[1] and label[i + dy, j + dx] >= 0:
                    met.add((label[i + dy, j + dx], codes[i, j]))
        at = label >= 0
        n, k = int(at.sum()), len(met)
        met = np.array(sorted(met), np.int64).reshape(-1, 2)
        rows = {"y": y[at], "x": x[at], "label": label[at], "strong": strong[at], "other": np.zeros(n, np.int64)}
        more = {"y": np.zeros(k, int), "x": np.zeros(k, int), "label": met[:, 0], "strong": np.zeros(k, bool), "other": met[:, 1]}
        return {c: np.append(rows[c], more[c]) for c in rows} | {"none": np.arange(n + k) < n}

    def run(blocks, y0, x0, h, w):
        made = [parts(block, y0, x0, h, w) for block in blocks]
        whole = {c: np.concatenate([m[c] for m in made]) for c in made[0]}
        of = np.repeat(np.arange(len(made)), [len(m["y"]) for m in made])
        return of, whole | {"other": pa.array(whole["other"], pa.int64(), mask=whole["none"])}

    return tiled(gray, "v", "int64", run, EDGES, width, height, 3, 3, side_of(3, tile), by_channel=False)


def canny(gray: DataFrame, lo: int, hi: int, width: int, height: int, tile: int | None = None) -> DataFrame:
    """Edges: strong candidates and all candidates that a chain of 8-neighbours joins to one; 255, and 0 elsewhere.

    Tiles find candidates and join them to parts; parts of different tiles that touch are joined as a graph. So a frame of any
    size is spread, and only parts at seams are in the graph.
    """
    found = checkpoint(edge_parts(gray, lo, hi, width, height, tile))
    parts = found.where("other is null")
    code = (F.col("y") * F.lit(width).cast("long") + F.col("x")).alias("other")
    seams = found.where("other is not null").select("frame_id", "label", "other").join(parts.select("frame_id", code, F.col("label").alias("b")), ["frame_id", "other"])
    whole = joined(seams.select("frame_id", F.col("label").alias("a"), "b"), "frame_id")
    named = parts.join(whole.select("frame_id", F.col("node").alias("label"), "root"), ["frame_id", "label"], "left").withColumn("root", F.coalesce("root", "label"))
    lit = named.where("strong").select("frame_id", "root").distinct()
    edges = named.join(lit, ["frame_id", "root"], "left_semi").select("frame_id", "y", "x", F.lit(255).alias("e"))
    return gray.select("frame_id", "y", "x", "c").join(edges, ["frame_id", "y", "x"], "left").select("frame_id", "y", "x", "c", F.coalesce("e", F.lit(0)).alias("v"))


def gaussian(n: int = 7, sigma: float = 7 / 6) -> list[float]:
    w = [math.exp(-((i - n // 2) ** 2) / (2 * sigma * sigma)) for i in range(n)]
    return [x / sum(w) for x in w]


def normalised(block: np.ndarray, h: int, w: int, floor: float = 1.0) -> np.ndarray:
    """What mscn gives, of blocks with three values more on each side."""
    wt = gaussian()
    reach = len(wt) // 2

    def smooth(block):
        rows = sum(weight * block[..., i : i + w] for i, weight in enumerate(wt))
        return sum(weight * rows[..., i : i + h, :] for i, weight in enumerate(wt))

    mu, sq = smooth(block), smooth(block * block)
    sd = np.sqrt(np.maximum(0.0, sq - mu * mu))
    return (block[..., reach : reach + h, reach : reach + w] - mu) / (sd + floor)


def mscn(px: DataFrame, width: int = 8, height: int = 8, floor: float = 1.0, tile: int | None = None) -> DataFrame:
    """m: each value less its 7x7 Gaussian mean, over the local deviation plus `floor`."""
    reach = len(gaussian()) // 2

    def run(blocks, y0, x0, h, w):
        return _pixels(len(blocks), y0, x0, h, w, m=normalised(blocks, h, w, floor))

    return tiled(px, "v", "float64", run, "y int, x int, m double", width, height, reach, reach, side_of(reach, tile)).select("frame_id", "y", "x", "c", "m")
