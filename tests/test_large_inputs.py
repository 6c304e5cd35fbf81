"""Steps that have to stay cheap on large tables: the cheap way gives what the plain one gives, and doesn't go through it."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pixeltide.functions import assign
from pixeltide.operators import detect, grid, resample, stats, stencil, trackers
from pixeltide.plans import detect_queries, pipeline
from pixeltide.sources import images
from pixeltide.streaming import stateful
from tests.conftest import DATA

KINDS = [("point", {}), ("point", {"distance": "corners", "limit": 20.0, "period": 2}), ("score", {}), ("score", {"crowded": True}), ("box", {}), ("box", {"motion": "acceleration"}), ("box", {"beta": 0.5})]


def moving(frames, objects=3, noise=True):
    rng = np.random.default_rng(3)
    n, k = (a.ravel() for a in np.mgrid[0:frames, 0:objects])
    x, y = 60 * k + n % 40 + (rng.integers(-9, 9, len(n)) if noise else 0), 30.0 * k + n % 20
    rows = pd.DataFrame({"frame_no": n, "det_id": k, "x1": x.astype(float), "y1": y, "x2": x + 40.0, "y2": y + 60.0, "score": (3 + (n + k) % 7) / 10, "class_id": k})
    rows["feature"] = list(rng.random((len(n), 4)))
    return rows[(n + k) % 7 != 0]


@pytest.mark.parametrize("kind, options", KINDS)
def test_frames_of_few_boxes_are_stepped_with_plain_numbers(monkeypatch, kind, options):
    rows = moving(3000)
    begin = time.perf_counter()
    got, _ = trackers.advance(trackers.TRACKERS[kind]("s", **options), None, rows, 1)
    assert time.perf_counter() - begin < 2.5  # 0.3 s; with arrays for each pair of lists 5 s and more
    for module in (trackers, assign):
        monkeypatch.setattr(module, "SMALL", 0)
    few = rows[rows.frame_no < 400]
    with_arrays, _ = trackers.advance(trackers.TRACKERS[kind]("s", **options), None, few, 1)
    assert len(with_arrays) > 100 and got[got.frame_no < 400].values.tolist() == with_arrays.values.tolist()


def crowd(n, room, seed=5):
    rng = np.random.default_rng(seed)
    x, y = rng.integers(0, room, (2, n)).astype(float)
    return pd.DataFrame({"x1": x, "y1": y, "x2": x + rng.integers(20, 70, n), "y2": y + rng.integers(20, 70, n), "score": rng.random(n).round(2), "_tiles": rng.integers(1, 3, n), "_state": rng.integers(0, 6, n) == 0})


def test_tiles_are_settled_in_lots(monkeypatch):
    """Tiles that lie one after the other, in batches of any size, give what each gives by itself, in few steps."""
    rows = pd.concat([crowd(1 + k % 90, 150, k).assign(frame_id=k // 4, _t0=k % 2, _t1=k // 2 % 2) for k in range(400)], ignore_index=True)
    rows["det_id"], rows["_state"] = rows.index, rows["_state"].astype(int)
    rows = rows.sort_values(["frame_id", "_t0", "_t1", "score", "det_id"], ascending=[True, True, True, False, True])
    tile = ["frame_id", "_t0", "_t1"]
    want = pd.concat([g[["det_id"]].assign(_told=detect._settled(g, 0.45, 1.0, 0.0)) for _, g in rows.groupby(tile)])
    for size, pairs in ((10_000, detect.PAIRS), (37, detect.PAIRS), (1000, 2000)):
        monkeypatch.setattr(detect, "PAIRS", pairs)
        batches = (rows.iloc[i : i + size] for i in range(0, len(rows), size))
        got = pd.concat(detect._tiles(batches, tile, 0.45, 1.0, 0.0, ["det_id"]))
        assert got.values.tolist() == want.values.tolist()


def test_tiled_frames_are_suppressed_as_whole_ones(spark):
    d = pd.concat([crowd(200, 300, k).assign(frame_id=k, det_id=range(200), class_id=0) for k in range(2)]).drop(columns=["_tiles", "_state"])
    det = spark.createDataFrame(d)
    got, want = (x.select("frame_id", "det_id").collect() for x in (detect.nms_crowded(det, 0.45, plus_one=True, crowd=60), detect.nms(det, 0.45, plus_one=True)))
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_pairs_of_small_frames_go_without_a_grid(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 90, (2, 400)).astype(float)
    d = pd.DataFrame({"frame_id": rng.integers(0, 40, 400), "a_id": range(400), "x1": x, "y1": y, "x2": x + 30, "y2": y + rng.integers(1, 99, 400)})
    d.loc[d.index[:200], "frame_id"] = 77  # a crowded one
    a, b = spark.createDataFrame(d), spark.createDataFrame(d.rename(columns={"a_id": "b_id"}))
    pairs = lambda: sorted((r.p.a_id, r.q.b_id) for r in grid.overlapping(a, b, ["frame_id"]).collect())
    got = pairs()
    for few in (0, 10**6):
        monkeypatch.setattr(grid, "FEW", few)
        assert pairs() == got
    assert len(got) > 1000
    monkeypatch.setattr(grid, "FEW", 32)
    small = spark.createDataFrame(d.iloc[200:])
    met = grid.overlapping(small, small.withColumnRenamed("a_id", "b_id"), ["frame_id"])
    assert "_c0" not in met._jdf.queryExecution().toString()


def test_user_code_frame_by_frame(spark):
    def fn(frame):
        n = int(frame.n.iloc[0])
        frame["n"] = n + 100  # in place: an error still gives the frame as it was
        if n == 1:
            raise ValueError("one")
        return frame[["v"]] if n == 2 else pd.concat([frame, frame]) if n == 3 else frame.iloc[:0] if n == 4 else frame.assign(more=1)

    rows = spark.createDataFrame([(n, n / 2, f"s{n}") for n in range(6)], "n long, v double, s string").coalesce(1)
    got = sorted((r.n, r.v, r.s, (r.error or "")[:8]) for r in pipeline.apply_user_code(rows, fn).collect())
    assert got == [(1, 0.5, "s1", "ValueErr"), (2, 1.0, "s2", "KeyError"), (100, 0.0, "s0", ""), (103, 1.5, "s3", ""), (103, 1.5, "s3", ""), (105, 2.5, "s5", "")]


def test_user_code_costs_little_more_than_its_calls(spark):
    """Of 20,000 frames: 0.2 ms each, where building a table of each result took 1 ms."""
    rows = spark.range(20_000, numPartitions=1).selectExpr("id AS frame_id", "CAST(id AS DOUBLE) AS payload")
    pipeline.apply_user_code(rows.limit(1), lambda f: f).collect()
    begin = time.perf_counter()
    assert pipeline.apply_user_code(rows, lambda f: f).where("error IS NULL").count() == 20_000
    assert time.perf_counter() - begin < 10


def test_sums_of_crops_without_their_pixels(spark):
    """As summed up from crop_by_box, over tiles, channels, holes and boxes beyond the frame; the boxes' pixels aren't made."""
    rng = np.random.default_rng(2)
    px = pd.DataFrame([(f, y, x, c, int(rng.integers(0, 256))) for f in (1, 2) for y in range(70) for x in range(90) for c in (0, 1) if f == 1 or rng.random() < 0.3], columns=["frame_id", "y", "x", "c", "v"])
    x, y = rng.integers(-5, 95, (2, 300)).astype(float)
    det = pd.DataFrame({"frame_id": rng.integers(1, 4, 300), "det_id": range(300), "x1": x, "y1": y, "x2": x + rng.integers(0, 60, 300), "y2": y + rng.integers(0, 60, 300)})
    p, d = spark.createDataFrame(px), spark.createDataFrame(det)
    want = detect.crop_by_box(p, d).groupBy("frame_id", "det_id").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.max("y").alias("bottom"), F.max("x").alias("right"), F.sum(F.col("v") * (F.col("x") + F.col("y"))).alias("moment"))
    got = sorted(map(tuple, detect.crop_sums(p, d).collect()))
    assert len(got) > 100 and got == sorted(map(tuple, want.collect()))
    plan = detect_queries.Q["crop_by_box"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan


@pytest.mark.parametrize(("holes", "layers"), [(False, 1), (False, 2), (True, 2)])
def test_each_box_is_cut_out_of_its_tile(holes, layers):
    """One cut for each box, of just its pixels; their sums are those of the pixels counted from the box's corner."""
    rng, cuts = np.random.default_rng(3), []
    y0, x0, h, w = 128, 64, 40, 64
    pixels = [(y, x, int(rng.integers(-9, 256))) for _ in range(layers) for y in range(h) for x in range(w) if not holes or rng.random() < 0.2]
    y, x, v = (np.array(p) for p in zip(*pixels, strict=True))
    tile = detect._Tile((y * 64 + x).astype(np.uint16).tobytes(), detect._narrow(v), y0, x0)

    class Seen(np.ndarray):
        def __getitem__(self, key):
            cuts.append(key)
            return np.asarray(self)[key]

    tile.v = tile.v.view(Seen)
    x1, y1 = rng.integers(0, 120, (2, 60)) + [[x0 - 30], [y0 - 30]]
    x2, y2 = x1 + rng.integers(1, 60, 60), y1 + rng.integers(1, 60, 60)
    got = np.array(tile.cut(x1, y1, x2, y2)).T.tolist()
    whole = lambda a, b, first, most: slice(*(min(max(int(p) - first, 0), most) for p in (a, b)))
    assert cuts == [(slice(None), whole(y1[k], y2[k], y0, h), whole(x1[k], x2[k], x0, w)) for k in range(60)]
    for k in range(60):
        own = [(p + y0 - y1[k], q + x0 - x1[k], value) for p, q, value in pixels if y1[k] <= p + y0 < y2[k] and x1[k] <= q + x0 < x2[k]]
        if own:
            assert got[k] == [len(own), sum(o[2] for o in own), max(o[0] for o in own), max(o[1] for o in own), sum(o[2] * (o[0] + o[1]) for o in own)]
        else:
            assert got[k][0] == 0


def test_values_of_tiles_keep_their_width():
    for low, high, width in ((0, 255, 1), (-1, 255, 2), (0, 256, 2), (-40_000, 1, 4), (1, 1 << 40, 8)):
        tile = detect._Tile(np.arange(2, dtype=np.uint16).tobytes(), raw := detect._narrow([low, high]), 0, 0)
        assert len(raw) == 2 * width and tile.v[0, 0, :2].tolist() == [low, high]


def test_recordings_make_no_folder_each(spark, tmp_path):
    rows = spark.range(2000).selectExpr("id AS source_id", "timestamp_seconds(id) AS ts", "true AS has_frame", "1.0D AS payload")
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    stateful.prepare(spark.range(1).withColumn("ts", F.current_timestamp()))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    images.stream_frames(stateful.recordings(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(240)
    assert len(list((tmp_path / "out").rglob("*.parquet"))) <= 16
    assert images.read_streamed(spark, str(tmp_path / "out"), "source_id long, session long").where("session = 1").count() == 2000


def frames(spark, n, height, width, partitions=2):
    at = spark.range(0, n * height * width, 1, partitions).selectExpr("id", f"id % {width} AS x", f"id div {width} % {height} AS y")
    return at.selectExpr(f"id div {height * width} AS frame_id", "CAST(y AS INT) AS y", "CAST(x AS INT) AS x", "0 AS c", "CAST(pmod(xxhash64(id), 256) AS INT) AS v")


def test_small_frames_go_by_many(spark):
    """Also tiles at the same place of larger frames; each comes once, with the pixels of its frame."""
    many = lambda blocks, y0, x0, h, w: (np.arange(len(blocks)), {"n": np.full(len(blocks), len(blocks)), "total": blocks[:, :h, :w].sum((1, 2))})
    for height, width, tile, tiles in ((8, 8, 64, 1), (9, 20, 8, 6)):
        px = frames(spark, 2000, height, width)
        got = stencil.tiled(px, "v", "int64", many, "n long, total long", width, height, 0, 0, tile)
        assert got.agg(F.min("n")).first()[0] > 10 and got.count() == 2000 * tiles
        assert got.groupBy("frame_id").agg(F.sum("total")).exceptAll(px.groupBy("frame_id").agg(F.sum("v"))).isEmpty()


def test_scene_features_cost_little_per_frame(spark):
    """20,000 frames: 8 s; with calls and a scan of all shapes for each frame, the 2,000 of sf0.1 took 30 s."""
    stats.brisque_features(frames(spark, 10, 8, 8)).collect()
    begin = time.perf_counter()
    assert stats.brisque_features(frames(spark, 20_000, 8, 8, 8)).agg(F.count("value")).first()[0] == 36 * 20_000
    assert time.perf_counter() - begin < 30


@pytest.mark.parametrize("height, width", [(40, 67), (33, 9), (64, 35)])
def test_scene_features_of_tiles_and_of_a_half_size_frame(spark, height, width):
    """Tiles don't show, and the second scale is the first of the frame that resize makes."""
    px = frames(spark, 2, height, width)
    values = lambda df: sorted((r.frame_id, r.feature, round(r.value, 9)) for r in df.collect())
    want = values(stats.brisque_features(px, width, height))
    assert len(want) == 72 and values(stats.brisque_features(px, width, height, tile=16)) == want
    half = resample.resize(px, width, height, width // 2, height // 2, "area")
    assert [(f, k + 18, v) for f, k, v in values(stats.brisque_features(half, width // 2, height // 2)) if k <= 18] == [r for r in want if r[1] > 18]


def test_the_nearest_shape_is_that_of_a_scan():
    table = np.array(stats._shapes())
    assert (np.diff(table[:, 1]) > 0).all()
    r = np.concatenate([np.random.default_rng(4).random(3000) * 1.2, table[:200, 1], (table[1:200, 1] + table[:199, 1]) / 2, [0.0, 5.0, np.nan, np.inf]])
    want = [table[np.argmin(np.abs(table[:, 1] - x)), 0] if np.isfinite(x) else 0.2 for x in r]
    assert stats.nearest_shape(r).tolist() == want
