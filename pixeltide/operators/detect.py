"""Decoding and cleaning of detector output: detections (frame_id, det_id, x1, y1, x2, y2, score, class_id)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import mul

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixeltide.operators import grid as cells
from pixeltide.operators.params import dealt, small_table
from pixeltide.operators.rounds import checkpoint

BOX = ["x1", "y1", "x2", "y2"]
_MODELS: dict = {}


def infer(frames: DataFrame, factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str, key: str) -> DataFrame:
    """Runs a user's model batch by batch. factory() is called once per worker and key (model and device)."""

    def run(batches):
        if key not in _MODELS:
            _MODELS[key] = factory()
        for b in batches:
            yield _MODELS[key](b)

    return frames.mapInPandas(run, schema)


def pivot_raw(raw: DataFrame, n_classes: int) -> DataFrame:
    """frame_id, anchor_id, a0..a4, and classes: an array of the class values."""
    at = lambda k: F.max(F.when(F.col("attr") == k, F.col("val")))
    wide = raw.groupBy("frame_id", "anchor_id").agg(*[at(k).alias(f"a{k}") for k in range(5)], *[at(5 + k).alias(f"k{k}") for k in range(n_classes)])
    return wide.select("frame_id", "anchor_id", *[f"a{k}" for k in range(5)], F.array(*[f"k{k}" for k in range(n_classes)]).alias("classes"))


def grid(spark, size: tuple[int, int], strides=(8, 16, 32)) -> DataFrame:
    """anchor_id, gx, gy, stride: levels in order, row by row."""
    rows, at = [], 0
    for s in strides:
        w, h = size[0] // s, size[1] // s
        for i in range(w * h):
            rows.append((at + i, i % w, i // w, s))
        at += w * h
    return small_table(spark, rows, "anchor_id int, gx int, gy int, stride int")


def _per_class(boxes: DataFrame, score: Callable[[Column], Column], ratio: float) -> DataFrame:
    cx, cy, w, h = (F.col(c) for c in ("cx", "cy", "w", "h"))
    return boxes.select(
        "frame_id", "anchor_id", ((cx - w / 2) / ratio).alias("x1"), ((cy - h / 2) / ratio).alias("y1"), ((cx + w / 2) / ratio).alias("x2"), ((cy + h / 2) / ratio).alias("y2"),
        F.posexplode(F.transform("classes", score)).alias("class_id", "score"),
    )


def decode_yolox(raw: DataFrame, n_classes: int, size: tuple[int, int], strides=(8, 16, 32), ratio: float = 1.0) -> DataFrame:
    """One row per anchor and class: centre (p + grid) * stride, size exp(p) * stride, score objectness * class."""
    g = pivot_raw(raw, n_classes).join(grid(raw.sparkSession, size, strides), "anchor_id")
    boxes = g.select("frame_id", "anchor_id", ((F.col("a0") + F.col("gx")) * F.col("stride")).alias("cx"), ((F.col("a1") + F.col("gy")) * F.col("stride")).alias("cy"), (F.exp("a2") * F.col("stride")).alias("w"), (F.exp("a3") * F.col("stride")).alias("h"), "a4", "classes")
    return _per_class(boxes, lambda k: k * F.col("a4"), ratio)


def decode_freeyolo(raw: DataFrame, n_classes: int, size: tuple[int, int], strides=(8, 16, 32), ratio: float = 1.0, score_th: float = 0.05) -> DataFrame:
    """As decode_yolox with half-cell centres and score sqrt(objectness * class); scores over score_th."""
    g = pivot_raw(raw, n_classes).join(grid(raw.sparkSession, size, strides), "anchor_id")
    s = F.col("stride")
    boxes = g.select("frame_id", "anchor_id", ((F.col("gx") + 0.5) * s + F.col("a0") * s).alias("cx"), ((F.col("gy") + 0.5) * s + F.col("a1") * s).alias("cy"), (F.exp("a2") * s).alias("w"), (F.exp("a3") * s).alias("h"), "a4", "classes")
    return _per_class(boxes, lambda k: F.sqrt(k * F.col("a4")), ratio).where(F.col("score") > score_th)


#: Anchor sizes by level, the levels' steps, and the variances of centres and sizes.
MIN_SIZES = [[10, 16, 24], [32, 48], [64, 96], [128, 192, 256]]
STEPS = [8, 16, 32, 64]
VARIANCE = (0.1, 0.2)


def priors(width: int, height: int) -> list[tuple[int, float, float, float, float]]:
    """anchor_id, centre and size as shares of the input."""
    rows = []
    w, h = (width + 1) // 2 // 2, (height + 1) // 2 // 2
    for sizes, step in zip(MIN_SIZES, STEPS, strict=True):
        w, h = w // 2, h // 2
        for i in range(h):
            for j in range(w):
                rows += [(len(rows) + n, (j + 0.5) * step / width, (i + 0.5) * step / height, m / width, m / height) for n, m in enumerate(sizes)]
    return rows


def decode_ssd_priors(raw: DataFrame, width: int, height: int) -> DataFrame:
    """From raw(frame_id, anchor_id, loc array of 14, cls, iou): x, y, w, h, score and five landmarks lx1, ly1, …"""
    p = raw.join(small_table(raw.sparkSession, priors(width, height), "anchor_id int, pcx double, pcy double, pw double, ph double"), "anchor_id")
    loc = lambda i: F.col("loc")[i]
    x = lambda i: (F.col("pcx") + loc(i) * VARIANCE[0] * F.col("pw")) * width
    y = lambda i: (F.col("pcy") + loc(i) * VARIANCE[0] * F.col("ph")) * height
    w, h = F.col("pw") * F.exp(loc(2) * VARIANCE[0]) * width, F.col("ph") * F.exp(loc(3) * VARIANCE[1]) * height
    score = F.sqrt(F.col("cls") * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("iou"))))
    marks = [e.alias(n) for k in range(5) for e, n in ((x(4 + 2 * k), f"lx{k + 1}"), (y(5 + 2 * k), f"ly{k + 1}"))]
    return p.select("frame_id", "anchor_id", (x(0) - w / 2).alias("x"), (y(1) - h / 2).alias("y"), w.alias("w"), h.alias("h"), score.alias("score"), *marks)


def class_argmax(scored: DataFrame, keys: list[str]) -> DataFrame:
    """The best class of each key; the lowest class on ties."""
    best = scored.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("class_id")).alias("k"))).alias("b"))
    return best.select(*keys, (-F.col("b.k")).alias("class_id"), F.col("b.score").alias("score"))


def iou(a, b, plus_one: bool = False, eps: float = 0.0, axes=cells.AXES) -> Column:
    """Intersection over union of two structs of corners, in as many dimensions as there are axes."""
    one = 1.0 if plus_one else 0.0
    shared = [F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]) + one) for lo, hi in axes]
    size = lambda s: reduce(mul, [s[hi] - s[lo] + one for lo, hi in axes])
    both = reduce(mul, shared)
    return both / (size(a) + size(b) - both + eps)


def nms(det: DataFrame, th: float = 0.45, plus_one: bool = False, class_aware: bool = False, score_th: float | None = None, eps: float = 0.0) -> DataFrame:
    """Greedy suppression per frame: by falling score (det_id on ties), drops a box that overlaps a kept one by over th.

    A frame's boxes are one array; nms_crowded is for frames that can hold very many.
    """
    if score_th is not None:
        det = det.where(F.col("score") > score_th)
    keys = ["frame_id", "class_id"] if class_aware else ["frame_id"]
    item = F.struct((-F.col("score")).alias("o"), "det_id", *BOX, F.col("score"), "class_id")
    groups = det.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("a"))
    none = F.filter("a", lambda x: F.lit(False))
    kept = F.aggregate("a", none, lambda acc, b: F.when(F.exists(acc, lambda k: iou(k, b, plus_one, eps) > th), acc).otherwise(F.concat(acc, F.array(b))))
    out = groups.select("frame_id", F.inline(kept)).drop("o")
    return out.select("frame_id", "det_id", *BOX, "score", "class_id")


CROWD = 1000
_UNDECIDED, _KEPT = 0, 1
_BLOCKED, _CLEAR, _FINAL, _GONE = 0, 1, 2, 3


def _settled(g: pd.DataFrame, th: float, one: float, eps: float) -> np.ndarray:
    """What a tile tells of its boxes, which are in order: gone for a better kept one, kept for good (if all of the box is
    here), clear of better ones here, or blocked by a better one that isn't settled."""
    x1, y1, x2, y2 = (g[c].to_numpy(float) for c in BOX)
    area = (x2 - x1 + one) * (y2 - y1 + one)
    alone, kept = (g["_tiles"] == 1).to_numpy(), (g["_state"] == _KEPT).to_numpy()
    told, gone, blocked = np.zeros(len(g), int), np.zeros(len(g), bool), np.zeros(len(g), bool)
    for i in range(len(g)):
        if gone[i]:
            told[i] = _GONE
            continue
        w = np.maximum(0.0, np.minimum(x2[i + 1 :], x2[i]) - np.maximum(x1[i + 1 :], x1[i]) + one)
        h = np.maximum(0.0, np.minimum(y2[i + 1 :], y2[i]) - np.maximum(y1[i + 1 :], y1[i]) + one)
        with np.errstate(invalid="ignore", divide="ignore"):
            over = w * h / (area[i] + area[i + 1 :] - w * h + eps) > th
        if kept[i] or alone[i] and not blocked[i]:
            told[i] = _FINAL
            gone[i + 1 :] |= over
        else:
            told[i] = _BLOCKED if blocked[i] else _CLEAR
            blocked[i + 1 :] |= over
    return told


PAIRS = 4_000_000  # pairs of boxes that are compared at once


def _settled_lot(lot: pd.DataFrame, starts: np.ndarray, th: float, one: float, eps: float) -> np.ndarray:
    """`_settled` of many small tiles that lie one after the other, which begin at `starts`: all pairs at once, then as many
    steps as boxes that overlap follow on each other."""
    n = len(lot)
    x1, y1, x2, y2 = (lot[c].to_numpy(float) for c in BOX)
    area = (x2 - x1 + one) * (y2 - y1 + one)
    end = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    count = end - np.arange(n) - 1
    i = np.repeat(np.arange(n), count)
    j = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + i + 1
    both = np.maximum(0.0, np.minimum(x2[j], x2[i]) - np.maximum(x1[j], x1[i]) + one)
    both *= np.maximum(0.0, np.minimum(y2[j], y2[i]) - np.maximum(y1[j], y1[i]) + one)
    with np.errstate(invalid="ignore", divide="ignore"):
        over = both / (area[i] + area[j] - both + eps) > th
    i, j = i[over], j[over]
    free = (lot["_tiles"] == 1).to_numpy()
    kept = (lot["_state"] == _KEPT).to_numpy()
    told, gone, blocked, done = np.zeros(n, int), np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
    while True:
        waits = np.zeros(n, bool)
        waits[j] = True
        now = ~waits & ~done
        final = kept | free & ~blocked
        told[now] = np.where(gone, _GONE, np.where(final, _FINAL, np.where(blocked, _BLOCKED, _CLEAR)))[now]
        done |= now
        if not len(i):
            return told
        out = now[i]
        says = told[i[out]]
        gone[j[out][says == _FINAL]] = True
        blocked[j[out][says < _FINAL]] = True
        i, j = i[~out], j[~out]


def _tiles(batches, keys: list[str], th: float, one: float, eps: float, name: list[str]):
    """What tiles tell of their boxes, which come in order, tile by tile: small ones in lots, large ones by themselves."""
    held: list[pd.DataFrame] = []

    def lots(rows: pd.DataFrame):
        at = rows[keys].to_numpy()
        starts = np.append(0, np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1)
        sizes = np.diff(np.append(starts, len(rows)))
        cost = sizes.astype(float) ** 2 / 2
        k = 0
        while k < len(starts):
            last = max(k + 1, int(np.searchsorted(np.cumsum(cost[k:]), PAIRS, "right")) + k)
            lot = rows.iloc[starts[k] : starts[last] if last < len(starts) else len(rows)]
            told = _settled(lot, th, one, eps) if cost[k] > PAIRS else _settled_lot(lot, starts[k:last] - starts[k], th, one, eps)
            yield lot[name].assign(_told=told)
            k = last

    for b in batches:
        if not len(b):
            continue
        own = (b[keys].to_numpy() == b[keys].iloc[-1].to_numpy()).all(1)
        whole = 0 if own.all() else int(np.flatnonzero(~own)[-1]) + 1
        if whole or held and (held[-1][keys].iloc[-1].to_numpy() != b[keys].iloc[0].to_numpy()).any():
            yield from lots(pd.concat([*held, b.iloc[:whole]], ignore_index=True))
            held = []
        held.append(b.iloc[whole:])
    if held:
        yield from lots(pd.concat(held, ignore_index=True))


def nms_crowded(det: DataFrame, th: float = 0.45, plus_one: bool = False, class_aware: bool = False, score_th: float | None = None, eps: float = 0.0, crowd: int = CROWD) -> DataFrame:
    """What nms gives, for frames of any number of boxes.

    Frames with more than `crowd` boxes are dealt out in tiles, of about so many boxes and twice as wide as boxes are on the mean.
    A tile settles the boxes that lie in it alone, in order; one that lies in several is kept once it is clear of better
    ones in each. What is open then goes on to a next round, with the tiles shifted, so that other boxes lie across their
    borders. The best of the open ones is always settled.
    """
    if score_th is not None:
        det = det.where(F.col("score") > score_th)
    keys = ["frame_id", "class_id"] if class_aware else ["frame_id"]
    name = ["frame_id", "det_id"]
    out = det.select("frame_id", "det_id", *BOX, "score", "class_id")
    one = 1.0 if plus_one else 0.0
    size = F.avg(cells.side(cells.AXES, one))
    room = (F.max("x2") - F.min("x1") + 1) * (F.max("y2") - F.min("y1") + 1)
    per = out.groupBy(*keys).agg(F.count("*").alias("_n"), F.greatest(F.lit(1.0), 2 * size, F.sqrt(room * crowd / F.count("*"))).alias("_side"))
    few = out.join(per.where(F.col("_n") <= crowd).select(*keys), keys, "left_semi")
    many = checkpoint(out.join(per.where(F.col("_n") > crowd).select(*keys, "_side"), keys))
    usable = cells.usable(many, cells.AXES)
    odd = many.join(usable.select(*name), name, "left_anti")  # they overlap nothing
    kept = [odd.drop("_side")]
    left = usable.withColumn("_state", F.lit(_UNDECIDED))
    kinds = ", ".join(f"{c} {out.schema[c].dataType.simpleString()}" for c in name)

    tile = [*keys, "_t0", "_t1"]
    settle = lambda batches: _tiles(batches, tile, th, one, eps, name)
    turn = 0
    while not left.where(F.col("_state") == _UNDECIDED).isEmpty():
        off = F.col("_side") * (int(f"{turn:b}"[::-1], 2) / (1 << turn.bit_length()) if turn else 0.0)  # 0, 1/2, 1/4, 3/4, ...
        spans = [(F.floor((F.col(lo) + off) / F.col("_side")), F.floor((F.col(hi) + one + off) / F.col("_side"))) for lo, hi in cells.AXES]
        spread = left.withColumn("_tiles", reduce(mul, [b - a + 1 for a, b in spans]))
        for k, (a, b) in enumerate(spans):
            spread = spread.withColumn(f"_t{k}", F.explode(F.sequence(a, F.greatest(a, b))))
        order = [*tile, F.desc("score"), "det_id"]
        told = dealt(spread.select(*tile, "score", "det_id", *BOX, "_tiles", "_state"), *tile).sortWithinPartitions(*order).mapInPandas(settle, f"{kinds}, _told int")
        word = F.struct(F.max("_told").alias("most"), F.min("_told").alias("least"))
        now = left.join(told.groupBy(*name).agg(word.alias("_w")), name)
        state = F.when(F.col("_w.most") == _GONE, F.lit(None)).when((F.col("_w.most") == _FINAL) | (F.col("_w.least") == _CLEAR), _KEPT).otherwise(_UNDECIDED)
        now = checkpoint(now.select(*left.columns[:-1], F.col("_state").alias("_old"), state.cast("int").alias("_state")))
        new = now.where((F.col("_old") == _UNDECIDED) & (F.col("_state") == _KEPT))
        kept.append(new.select(*out.columns))
        left = now.where((F.col("_state") == _UNDECIDED) | (F.col("_state") == _KEPT) & (F.col("_old") == _UNDECIDED)).drop("_old")
        turn += 1
    return reduce(DataFrame.unionByName, kept, nms(few, th, plus_one, class_aware, eps=eps))


def nms_boxes(boxes: DataFrame, score_th: float, th: float, topk: int, keep: int) -> DataFrame:
    """For boxes(frame_id, det_id, x, y, w, h, score): scores over score_th, the topk best of a frame, greedy, then the keep best."""
    best = Window.partitionBy("frame_id").orderBy(F.desc("score"), "det_id")
    own = boxes.where(F.col("score") > score_th).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= topk)
    det = own.select("frame_id", "det_id", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"), "score", F.lit(0).alias("class_id"))
    left = nms(det, th).select("frame_id", "det_id", "score").withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= keep)
    return boxes.join(left.select("frame_id", "det_id"), ["frame_id", "det_id"], "left_semi")


def clip_boxes(det: DataFrame, width: float, height: float) -> DataFrame:
    for c, top in (("x1", width), ("y1", height), ("x2", width), ("y2", height)):
        det = det.withColumn(c, F.least(F.lit(float(top)), F.greatest(F.lit(0.0), F.col(c))))
    return det


def score_filter(det: DataFrame, th: float) -> DataFrame:
    return det.where(F.col("score") >= round(th, 3))


def top_k_classes(scores: DataFrame, k: int = 5, keys: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """The k best classes of each key with their rank; the lowest class first on ties."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "class_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


TILE = 16


def crop_by_box(px: DataFrame, det: DataFrame) -> DataFrame:
    """The pixels of each box, from the box's own corner: frame_id, det_id, y, x, c, v.

    A range join dealt out by tiles: boxes go to the tiles they touch, pixels to their own, so a large frame or a large
    box is spread over many keys.
    """
    b = det.select("frame_id", "det_id", *[F.greatest(F.lit(0), F.col(c).cast("int")).alias(c) for c in BOX]).where("x2 > x1 and y2 > y1")
    b = b.withColumn("ty", F.explode(F.sequence(F.floor(F.col("y1") / TILE), F.floor((F.col("y2") - 1) / TILE)))).withColumn("tx", F.explode(F.sequence(F.floor(F.col("x1") / TILE), F.floor((F.col("x2") - 1) / TILE))))
    p = px.withColumn("ty", F.floor(F.col("y") / TILE)).withColumn("tx", F.floor(F.col("x") / TILE))
    inside = "y >= y1 and y < y2 and x >= x1 and x < x2"
    hit = p.join(b, ["frame_id", "ty", "tx"]).where(inside)
    return hit.select("frame_id", "det_id", (F.col("y") - F.col("y1")).alias("y"), (F.col("x") - F.col("x1")).alias("x"), "c", "v")


SPAN, SHARES = 64, 16  # side of a tile of crop_sums, and in how many shares its boxes are dealt out


def crop_sums(px: DataFrame, det: DataFrame) -> DataFrame:
    """crop_by_box, with the pixels of each box summed up where they are cut out: frame_id, det_id, n, total (of v), bottom and
    right (the last y and x), and moment (of v * (x + y)); boxes without pixels are left out.

    The same range join with larger tiles: boxes go to the tiles they touch, pixels to their own, and each box is cut out of
    the tile's arrays, counted from the box's own corner. Only a row per box and tile leaves the task. Tiles and their boxes
    meet in sorted batches; of a crowded tile the boxes are in several shares.
    """
    b = det.select("frame_id", "det_id", *[F.greatest(F.lit(0), F.col(c).cast("int")).alias(c) for c in BOX]).where("x2 > x1 and y2 > y1")
    for axis in "yx":
        b = b.withColumn(f"t{axis}", F.explode(F.sequence(F.floor(F.col(f"{axis}1") / SPAN), F.floor((F.col(f"{axis}2") - 1) / SPAN))))
    key = ["frame_id", "ty", "tx", "share"]
    b = b.withColumn("share", F.pmod(F.hash("det_id"), F.lit(SHARES)))
    place = (F.pmod("y", F.lit(SPAN)) * SPAN + F.pmod("x", F.lit(SPAN))).cast("int")
    tiles = px.groupBy("frame_id", F.floor(F.col("y") / SPAN).alias("ty"), F.floor(F.col("x") / SPAN).alias("tx")).agg(F.collect_list(F.struct(place.alias("at"), F.col("v").cast("long").alias("v"))).alias("p"))
    tiles = tiles.select("frame_id", "ty", "tx", "p.at", "p.v").mapInPandas(_packed, f"frame_id {px.schema['frame_id'].dataType.simpleString()}, ty long, tx long, at binary, v binary")
    tiles = tiles.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    both = tiles.withColumn("kind", F.lit(0)).unionByName(b.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    kinds = ", ".join(f"{c} {det.schema[c].dataType.simpleString()}" for c in ("frame_id", "det_id"))
    out = dealt(both, *key).sortWithinPartitions(*key, "kind").mapInPandas(_crop_sums, f"{kinds}, {', '.join(f'{c} long' for c in SUMS)}")
    sums = out.groupBy("frame_id", "det_id").agg(*[(F.max if c in ("bottom", "right") else F.sum)(c).alias(c) for c in SUMS])
    return sums.select("frame_id", "det_id", "n", "total", *[F.col(c).cast("int").alias(c) for c in ("bottom", "right")], "moment")


SUMS = ["n", "total", "bottom", "right", "moment"]


_WIDTHS = {np.dtype(k).itemsize: np.dtype(k) for k in ("u1", "i2", "i4", "i8")}


def _narrow(v) -> bytes:
    """Whole numbers in the least width that holds them all."""
    v = np.asarray(v, np.int64)
    kind = next(k for k in _WIDTHS.values() if np.iinfo(k).min <= v.min() and v.max() <= np.iinfo(k).max)
    return v.astype(kind).tobytes()


def _packed(batches):
    """Places and values of a tile's pixels as bytes, which cost nothing in the rows of boxes."""
    for b in batches:
        yield b.assign(at=[np.asarray(p, np.uint16).tobytes() for p in b["at"]], v=[_narrow(p) for p in b["v"]])


def _crop_sums(batches):
    now, tile = None, None
    for b in batches:
        if not len(b):
            continue
        at, kind = b[["frame_id", "ty", "tx", "share"]].to_numpy(), b["kind"].to_numpy()
        boxes = [b[c].fillna(0).to_numpy(np.int64) for c in BOX]
        made = np.zeros((len(SUMS), len(b)), np.int64)
        starts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist(), len(b)]
        for i, j in zip(starts, starts[1:], strict=False):
            key = tuple(at[i].tolist())
            if key != now:
                now, tile = key, None
            if kind[i] == 0:
                tile = _Tile(b["at"].iloc[i], b["v"].iloc[i], key[1] * SPAN, key[2] * SPAN)
                i += 1
            if tile is not None and i < j:
                made[:, i:j] = tile.cut(*(p[i:j] for p in boxes))
        hit = made[0] > 0
        yield b.loc[hit, ["frame_id", "det_id"]].assign(**dict(zip(SUMS, made[:, hit], strict=True)))


class _Tile:
    """A tile's pixels as arrays, in layers where a place has several (channels)."""

    def __init__(self, at: bytes, v: bytes, y0: int, x0: int):
        self.y0, self.x0 = y0, x0
        at = np.frombuffer(at, np.uint16).astype(np.int64)
        v = np.frombuffer(v, _WIDTHS[len(v) // len(at)])
        order = np.argsort(at, kind="stable")
        at, v = at[order], v[order]
        layer = np.arange(len(at)) - np.searchsorted(at, at)
        self.v = np.zeros((layer.max() + 1, SPAN * SPAN), np.int64)
        self.v[layer, at] = v
        self.there = np.zeros(self.v.shape, np.int64)
        self.there[layer, at] = 1
        self.v, self.there = (p.reshape(-1, SPAN, SPAN) for p in (self.v, self.there))
        self.h, self.w = int(at.max()) // SPAN + 1, int((at % SPAN).max()) + 1
        self.whole = bool(self.there[:, : self.h, : self.w].all())

    def cut(self, x1, y1, x2, y2) -> list[np.ndarray]:
        """Each box's pixels v[:, y1:y2, x1:x2], which are summed by its own rows and columns: SUMS."""
        y, bottom, x, right = (np.clip(p - q, 0, most) for p, q, most in ((y1, self.y0, self.h), (y2, self.y0, self.h), (x1, self.x0, self.w), (x2, self.x0, self.w)))
        spans = list(zip(y.tolist(), bottom.tolist(), x.tolist(), right.tolist(), strict=True))
        rows, columns = _by_side(self.v, spans)
        if self.whole:
            n = len(self.v) * (bottom - y) * (right - x)
        else:
            counts = _by_side(self.there, spans)
            n = counts[0].sum(1)
            bottom, right = (p + SPAN - (q[:, ::-1] > 0).argmax(1) for p, q in ((y, counts[0]), (x, counts[1])))
        down, across = y + self.y0 - y1, x + self.x0 - x1  # of the first pixel from the box's corner
        steps, total = np.arange(SPAN), rows.sum(1)
        moment = rows @ steps + columns @ steps + (down + across) * total
        return [n, total, bottom - 1 - y + down, right - 1 - x + across, moment]


def _by_side(v: np.ndarray, spans: list) -> tuple[np.ndarray, np.ndarray]:
    """The sums of each cut's rows, and of its columns."""
    rows, columns = np.zeros((2, len(spans), SPAN), np.int64)
    add = np.add.reduce
    for k, (top, bottom, left, right) in enumerate(spans):
        crop = v[:, top:bottom, left:right]
        rows[k, : bottom - top] = add(crop, (0, 2))
        columns[k, : right - left] = add(crop, (0, 1))
    return rows, columns


def classify_crops(px: DataFrame, det: DataFrame, score: Callable[[DataFrame], DataFrame], th: float = 0.0, crops: Callable[[DataFrame, DataFrame], DataFrame] = crop_by_box) -> DataFrame:
    """score(crops) gives (frame_id, det_id, class_id, score); each kept box gets the best class as crop_class, crop_score.

    crops: crop_by_box, or crop_sums for a score that needs no more than sums of the pixels.
    """
    kept = score_filter(det, th)
    best = class_argmax(score(crops(px, kept)), ["frame_id", "det_id"])
    return kept.join(best.select("frame_id", "det_id", F.col("class_id").alias("crop_class"), F.col("score").alias("crop_score")), ["frame_id", "det_id"])
