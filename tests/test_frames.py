"""Hand values, properties, plans and edge cases of the frame operators."""

import math
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixeltide.functions.assign import greedy, optimal, sparse, within
from pixeltide.operators import annotate, detect, fuse, keypoints, motmetrics, pixels, resample, sampling, segment, stats, stencil, track, trackers
from pixeltide.operators.params import clamp
from pixeltide.operators.rounds import joined
from pixeltide.plans import pipeline
from pixeltide.plans.fixtures import fixture
from pixeltide.sources import images, mot

PX = "frame_id long, y int, x int, c int, v int"


def gray(spark, rows, frame=1):
    return spark.createDataFrame([(frame, y, x, 0, v) for y, r in enumerate(rows) for x, v in enumerate(r)], PX)


def grid(px):
    rows = {(r.y, r.x): r.v for r in px.collect()}
    h, w = max(y for y, _ in rows) + 1, max(x for _, x in rows) + 1
    return [[rows[y, x] for x in range(w)] for y in range(h)]


NINE = [[1, 2, 3], [4, 5, 6], [7, 8, 9]]


def mirrored(a, k):
    return np.pad(np.array(a), k, mode="reflect")


def test_box_blur_mirrors_borders(spark):
    p = mirrored(NINE, 1)
    want = [[round(p[y : y + 3, x : x + 3].sum() / 9) for x in range(3)] for y in range(3)]
    assert grid(stencil.box_blur(gray(spark, NINE), 3, 3, 3)) == want


def test_blur_of_one_pixel_and_of_a_kernel_larger_than_the_frame(spark):
    assert grid(stencil.box_blur(gray(spark, [[7]]), 5, 1, 1)) == [[7]]
    idx = [stencil.mirror(i, 3) for i in range(-4, 8)]
    assert idx == [0, 1, 2, 1, 0, 1, 2, 1, 0, 1, 2, 1]
    assert len(grid(stencil.box_blur(gray(spark, NINE), 9, 3, 3))) == 3


def test_filter_is_a_correlation(spark):
    right = [[0, 0, 0], [0, 0, 1], [0, 0, 0]]
    assert grid(stencil.filter3x3(gray(spark, NINE), right, 1.0, 3, 3)) == [[2, 3, 2], [5, 6, 5], [8, 9, 8]]


def test_flip_twice_and_both_axes(spark):
    g = gray(spark, NINE)
    once = pixels.flip(g, True, True, 3, 3)
    assert grid(once) == [[9, 8, 7], [6, 5, 4], [3, 2, 1]]
    assert grid(pixels.flip(once, True, True, 3, 3)) == NINE


COLORS = [((255, 0, 0), (120, 255, 255)), ((0, 255, 0), (60, 255, 255)), ((0, 0, 255), (0, 255, 255)), ((255, 255, 255), (0, 0, 255)), ((0, 0, 0), (0, 0, 0)), ((128, 128, 128), (0, 0, 128))]


@pytest.mark.parametrize("bgr,hsv", COLORS)
def test_hsv_of_pure_colors(spark, bgr, hsv):
    px = spark.createDataFrame([(1, 0, 0, c, v) for c, v in enumerate(bgr)], PX)
    there = pixels.bgr_to_hsv(px)
    assert {r.c: r.v for r in there.collect()} == dict(enumerate(hsv))
    assert {r.c: r.v for r in pixels.hsv_to_bgr(there).collect()} == dict(enumerate(bgr))


def test_round_trip_of_frames(spark, sf_dir):
    px = fixture(spark, sf_dir, "f2_bgr")
    back = pixels.frames_to_pixels(pixels.pixels_to_frames(px))
    assert back.exceptAll(px.select(back.columns)).isEmpty() and px.count() == back.count()


def test_histogram_sums_to_the_pixels_and_has_empty_bins(spark):
    h = stats.rgb_histogram(gray(spark, NINE))
    assert h.count() == 256 and h.agg(F.sum("n")).first()[0] == 9


def test_point_operators_have_no_exchange(spark, sf_dir):
    px = spark.createDataFrame([], PX)
    for df in (pixels.brightness(px, 3), pixels.contrast(px, 1.5), pixels.threshold(px, "binary", 10), pixels.crop(px, 0, 1, 0, 1, 8, 8), pixels.flip(px, True, False, 8, 8)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    plan = pixels.gamma(fixture(spark, sf_dir, "f2_bgr"), 2.0)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_empty_frames(spark):
    none = spark.createDataFrame([], PX)
    for df in (pixels.grayscale(none), pixels.otsu(none), stencil.box_blur(none, 3, 3, 3), resample.resize(none, 3, 3, 4, 4), stats.rgb_histogram(none), stencil.canny(none, 50, 100, 3, 3)):
        assert df.count() == 0


def test_otsu_of_a_flat_and_a_two_valued_frame(spark):
    assert grid(pixels.otsu(gray(spark, [[5, 5]]))) == [[0, 0]]
    assert grid(pixels.otsu(gray(spark, [[5, 200, 5, 200]]))) == [[0, 255, 0, 255]]


def test_weights_sum_to_one():
    for mode in resample.MODES:
        for src, dst in ((8, 13), (64, 24), (3, 3), (1, 4)):
            sums = {}
            for d, _, w in resample.axis_weights(src, dst, mode):
                sums[d] = sums.get(d, 0) + w
            assert set(sums) == set(range(dst)) and set(sums.values()) == {resample.ONE}


def test_canny_follows_weak_edges(spark):
    step = [[0] * 4 + [60] * 4 for _ in range(4)] + [[0] * 4 + [30] * 4 for _ in range(4)]
    e = np.array(grid(stencil.canny(gray(spark, step), 80, 200, 8, 8)))
    assert e.max() == 255 and (e[6] == 255).any() and not e[:, 0].any()


A, B, C = (0.0, 0.0, 10.0, 10.0), (4.0, 0.0, 14.0, 10.0), (8.0, 0.0, 18.0, 10.0)


def boxes(spark, *items):
    return spark.createDataFrame([(1, i, *b, s, 0) for i, (b, s) in enumerate(items)], "frame_id long, det_id int, x1 double, y1 double, x2 double, y2 double, score double, class_id int")


def test_nms_keeps_what_only_a_dropped_box_overlaps(spark):
    kept = detect.nms(boxes(spark, (A, 0.9), (B, 0.8), (C, 0.7)), 0.3)
    assert sorted(r.det_id for r in kept.collect()) == [0, 2]


def test_nms_ties_go_to_the_lower_id_and_empty_input(spark):
    assert [r.det_id for r in detect.nms(boxes(spark, (A, 0.5), (A, 0.5)), 0.3).collect()] == [0]
    assert detect.nms(boxes(spark, (A, 0.5)).limit(0), 0.3).count() == 0


def test_nms_property(spark, sf_dir):
    det = fixture(spark, sf_dir, "f3_det").limit(400)
    kept = detect.nms(det, 0.45)
    k = kept.withColumnRenamed("det_id", "a_id")
    pairs = track.iou_pairs(k, kept.withColumnRenamed("det_id", "b_id"), ["frame_id"], 0.0).where("a_id < b_id")
    assert pairs.where("iou > 0.45").count() == 0
    gone = det.join(kept, ["frame_id", "det_id"], "left_anti").withColumnRenamed("det_id", "b_id")
    why = track.iou_pairs(k, gone, ["frame_id"], 0.0).where("iou > 0.45 and a_score >= b_score").select("frame_id", "b_id").distinct()
    assert why.count() == gone.count()


def test_greedy_and_optimal_differ():
    cost = np.array([[1.0, 2.0, 9.0], [1.5, 9.0, 9.0], [9.0, 9.0, 1.0]])
    assert sorted(greedy(cost, 10)) == [(0, 0), (1, 1), (2, 2)]
    assert optimal(cost) == [(0, 1), (1, 0), (2, 2)]
    assert within(np.array([[5.0, 1.0], [1.0, 9.0]]), 3.0) == [(0, 1), (1, 0)]


def test_optimal_equals_brute_force():
    from itertools import permutations

    rng = np.random.default_rng(1)
    for n, m in ((3, 3), (2, 5), (5, 2), (4, 4)):
        c = rng.random((n, m))
        got = sum(c[i, j] for i, j in optimal(c))
        small, large = (c, m) if n <= m else (c.T, n)
        best = min(sum(small[i, p[i]] for i in range(len(small))) for p in permutations(range(large), len(small)))
        assert abs(got - best) < 1e-12


@pytest.mark.parametrize("kind", sorted(trackers.TRACKERS))
def test_a_steady_object_keeps_its_name(spark, kind):
    rows = [(1, n, 0, 100.0 + n, 50.0, 140.0 + n, 110.0, 0.9, 0) for n in range(40) if n % 9 != 8]
    det = spark.createDataFrame(rows, "stream_id long, frame_no int, det_id int, x1 double, y1 double, x2 double, y2 double, score double, class_id int")
    out = trackers.track(det, kind).toPandas()
    assert out.track_id.nunique() == 1
    last = out[out.frame_no == out.frame_no.max()].iloc[0]
    assert abs(last.x1 - (100 + last.frame_no)) < 8


def test_new_tracks_count_as_missed_once():
    t = trackers.BoxTracker(1)
    t.step(0, [(0, 0, 0, 10, 10, 0.9, 0)])
    assert t.tracks[0].stale == 1


def test_state_goes_on_where_it_was(spark, sf_dir):
    f = fixture(spark, sf_dir, "f4_stream").where("stream_id < 3").toPandas()
    for kind in trackers.TRACKERS:
        key = ["stream_id", "class_id"] if trackers.PER_CLASS[kind] else ["stream_id"]
        for k, g in f.groupby(key):
            whole, _ = trackers.advance(trackers.TRACKERS[kind]("s"), None, g, int(k[0]))
            t, last, parts = trackers.TRACKERS[kind]("s"), None, []
            for part in (g[g.frame_no < 20], g[g.frame_no >= 20]):
                out, last = trackers.advance(t, last, part, int(k[0]))
                t = trackers.load(trackers.save(t))
                parts += out.values.tolist()
            assert parts == whole.values.tolist()


def test_crop_bounds_that_cross(spark):
    assert pixels.crop(gray(spark, NINE), 0.9, 0.5, 0.0, 1.0, 3, 3).count() == 0
    assert clamp(9.1234, 0, 5.0, 3) == 5.0 and clamp(7, 0, 5) == 5


def test_blend_passes_a_lone_frame(spark):
    assert grid(fuse.alpha_blend(gray(spark, NINE), gray(spark, NINE).limit(0))) == NINE
    assert grid(fuse.alpha_blend(gray(spark, [[100]]), gray(spark, [[100]]), 1.0, 0.3, 0.0)) == [[130]]


def test_grid_puts_the_last_slot_first(spark):
    out = grid(fuse.concat_grid([gray(spark, [[1]]), gray(spark, [[2]]), gray(spark, [[3]])], (1, 1)))
    assert out == [[3, 2], [1, 0]]
    assert fuse.concat_grid([None, None], (1, 1)) is None


def test_class_palette_deals_bits():
    assert segment.class_palette(3) == [(0, 0, 0, 128), (1, 0, 128, 0), (2, 0, 128, 128)]


def test_palm_without_area(spark):
    kp = spark.createDataFrame([(1, 0, k, 5, 5, 1.0) for k in keypoints.PALM], "frame_id long, obj_id int, kp_id int, x int, y int, score double")
    assert keypoints.palm_moment(kp).collect()[0][2:] == (0, 0)
    square = dict(zip(keypoints.PALM, [(0, 0), (6, 0), (6, 3), (6, 6), (3, 6), (0, 6)], strict=True))
    kp = spark.createDataFrame([(1, 0, k, x, y, 1.0) for k, (x, y) in square.items()], kp.schema)
    assert keypoints.palm_moment(kp).collect()[0][2:] == (3, 3)
    assert len(keypoints.EDGES["movenet"]) == 16 and len(keypoints.EDGES["blazepose"]) == 29 and len(keypoints.EDGES["hand"]) == 21


def test_latency_texts(spark):
    df = spark.createDataFrame([(7,), (12345,)], "ms int").select(stats.latency_text(F.col("ms")).alias("t"))
    assert [r.t for r in df.collect()] == ["0007ms", "12345ms"]
    assert df.select(stats.parse_latency(F.lit("ms")).alias("n")).first().n is None


def test_as_of_takes_the_row_of_the_same_time(spark):
    import datetime

    t = datetime.datetime(2024, 1, 1)
    left = spark.createDataFrame([(1, t, 5)], "source_id long, ts timestamp, k int")
    right = spark.createDataFrame([(1, t, "OFF")], "source_id long, ts timestamp, state string")
    assert sampling.as_of(left, right, ["state"]).first().state == "OFF"
    assert sampling.gate(left, right).count() == 0


DOC = {
    "node_list": ["1:Image", "2:Blur", "3:Int", "4:Blur"],
    "link_list": [["1:Image:Image:Output01", "2:Blur:Image:Input01"], ["3:Int:Int:Output01", "2:Blur:Image:Input01"], ["2:Blur:Image:Output01", "4:Blur:Image:Input01"], ["1:Image:Image:Output01", "4:Blur:Image:Input01"]],
    **{n: {"id": n[0], "name": n[2:], "setting": {"ver": "0.0.1", "pos": [0, 0], f"{n}:Float:Input02Value": 1.5}} for n in ("1:Image", "2:Blur", "3:Int", "4:Blur")},
}


def test_documents(spark):
    import json

    docs = spark.createDataFrame([(1, json.dumps(DOC)), (2, '{"node_list": [], "link_list": []}')], "pipeline_id long, doc string")
    nodes, links = pipeline.parse_nodes(docs), pipeline.parse_links(docs)
    assert [(r.node_id, r.node_tag, r.ver) for r in nodes.orderBy("pos").collect()] == [(1, "Image", "0.0.1"), (2, "Blur", "0.0.1"), (3, "Int", "0.0.1"), (4, "Blur", "0.0.1")]
    assert nodes.where("node_id = 2").first().settings == {"2:Blur:Float:Input02Value": "1.5"}
    valid = pipeline.validate_links(links, ["pos"], ["dst", "dst_port"])
    assert sorted((r.src, r.dst) for r in valid.collect()) == [(1, 2), (2, 4)]
    levels = pipeline.pipeline_levels(nodes, valid)
    assert sorted((r.node_id, r.level) for r in levels.collect()) == [(1, 0), (2, 1), (3, 0), (4, 2)]


def test_a_cycle_is_reported(spark):
    nodes = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "pipeline_id long, node_id int")
    links = spark.createDataFrame([(1, 1, 2), (1, 2, 1)], "pipeline_id long, src int, dst int")
    assert {r.node_id: r.level for r in pipeline.pipeline_levels(nodes, links).collect()} == {1: None, 2: None, 3: 0}
    with pytest.raises(ValueError, match="cycle"):
        pipeline.run_pipeline({"node_list": ["1:A", "2:A"], "link_list": [["1:A:I:o", "2:A:I:i"], ["2:A:I:o", "1:A:I:i"]]}, {}, {})


def test_mot_files(spark, tmp_path):
    (tmp_path / "det.txt").write_text("1,3,794.2,47.5,71.2,174.8,0.67,-1,-1,-1\n1,4,1,2,3,4,0.1,-1,-1,-1\n")
    r = mot.read_mot(spark, str(tmp_path / "det.txt"), 0.5).collect()
    assert len(r) == 1 and r[0].id == 3 and math.isclose(r[0].x2, 865.4) and math.isclose(r[0].y2, 222.3)
    t = spark.createDataFrame([(0, 7, 1.0, 2.0, 4.0, 6.0)], "frame_no int, track_id int, x1 double, y1 double, x2 double, y2 double")
    mot.write_mot(t, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == "1,7,1.0,2.0,3.0,4.0,-1,-1,-1,-1"


def png(rows):
    """A true-colour PNG from rows of (r, g, b)."""
    raw = b"".join(b"\0" + bytes(v for p in r for v in p) for r in rows)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_images(spark, tmp_path):
    (tmp_path / "000002.png").write_bytes(png([[(200, 128, 1), (0, 255, 10)]]))
    (tmp_path / "000001.png").write_bytes(png([[(1, 2, 3), (4, 5, 6)]]))
    (tmp_path / "000003.png").write_bytes(b"no image")
    got = {r.frame_no: (r.height, r.width, r.channels, r.data) for r in images.read_frame_dir(spark, str(tmp_path)).collect()}
    assert got == {1: (1, 2, 3, [3, 2, 1, 6, 5, 4]), 2: (1, 2, 3, [1, 128, 200, 10, 255, 0])}
    assert images.read_frame_dir(spark, str(tmp_path), 1).count() == 1


def test_write_frames(spark, tmp_path):
    px = gray(spark, NINE).withColumn("source_id", F.lit("a")).withColumn("session", F.lit(1))
    images.write_frames(px, str(tmp_path / "o"), 3, 3, (6, 6))
    assert spark.read.parquet(str(tmp_path / "o")).where("source_id = 'a' and session = 1").count() == 36


def test_write_frames_of_sources_that_share_numbers(spark, tmp_path):
    px = spark.createDataFrame([(src, s, 7, y, x, 0, v) for src, s, v in (("a", 1, 10), ("b", 1, 20), ("b", 2, 30)) for y in range(3) for x in range(3)], "source_id string, session int, frame_id long, y int, x int, c int, v int")
    images.write_frames(px, str(tmp_path / "o"), 3, 3, (6, 6))
    got = spark.read.parquet(str(tmp_path / "o")).groupBy("source_id", "session").agg(F.min("v"), F.max("v"), F.count("*"))
    assert sorted(map(tuple, got.collect())) == [("a", 1, 10, 10, 36), ("b", 1, 20, 20, 36), ("b", 2, 30, 30, 36)]


def test_overlay_passes_frames_without_planes(spark):
    px = spark.createDataFrame([(f, 0, 0, c, 100) for f in (1, 2) for c in range(3)], "frame_id long, y int, x int, c int, v int")
    planes = spark.createDataFrame([(1, 0, 0, 0, 0.9)], "frame_id long, class_id int, y int, x int, v double")
    got = {(r.frame_id, r.c): r.v for r in segment.segmentation_overlay(px, planes, 0.5, 1).collect()}
    assert got == {(1, 0): 51, (1, 1): 51, (1, 2): 115, (2, 0): 100, (2, 1): 100, (2, 2): 100}


def test_values_are_carried_over_days(spark):
    import datetime

    t = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    ticks = spark.createDataFrame([(1, t(0), None), (1, t(1), 5.0), (1, t(30), None), (1, t(31), 6.0), (1, t(32), None), (1, t(200), None), (2, t(40), None), (None, t(3), 9.0), (None, t(60), None)], "source_id long, ts timestamp, payload double")
    got = {(r.source_id, (r.ts - t(0)).total_seconds() / 3600): r.payload for r in sampling.hold_last(ticks).collect()}
    assert got == {(1, 0): None, (1, 1): 5.0, (1, 30): 5.0, (1, 31): 6.0, (1, 32): 6.0, (1, 200): 6.0, (2, 40): None, (None, 3): 9.0, (None, 60): 9.0}
    feed = ticks.where("payload is not null").withColumnRenamed("payload", "param")
    got = {(r.source_id, (r.ts - t(0)).total_seconds() / 3600): r.param for r in sampling.as_of(ticks, feed, ["param"]).collect()}
    assert got[1, 30] == 5.0 and got[1, 200] == 6.0 and got[1, 0] is None and got[2, 40] is None and len(got) == 9


DET = "stream_id long, frame_no int, det_id int, x1 double, y1 double, x2 double, y2 double, score double, class_id int"


@pytest.mark.parametrize("kind", sorted(trackers.TRACKERS))
def test_trackers_over_wide_gaps(kind):
    """A gap, of time stamps as frame numbers say, costs no more than its tracks last; what follows is as if each frame was stepped."""
    seen = [*range(30), *range(33, 60), *range(400, 430)]
    rows = lambda frames: pd.DataFrame([(n, 1, 10.0 + i, 10.0, 60.0 + i, 90.0, 0.9, 0) for i, n in enumerate(frames)], columns=["frame_no", *trackers.FIELDS])
    got, last = trackers.advance(trackers.TRACKERS[kind]("s"), None, rows(seen), 1)
    one, want = trackers.TRACKERS[kind]("s"), []
    by_frame = {n: (1, 10.0 + i, 10.0, 60.0 + i, 90.0, 0.9, 0) for i, n in enumerate(seen)}
    for n in range(430):
        want += [(n, *t) for t in one.step(n, [by_frame[n]] if n in by_frame else [])]
    assert last == 429 and len(want) > 40 and list(got.drop(columns="stream_id").itertuples(index=False, name=None)) == want
    far = 1_700_000_000_000
    got, last = trackers.advance(trackers.TRACKERS[kind]("s"), None, rows([*range(30), *range(far, far + 30)]), 1)
    assert last == far + 29 and got.frame_no.max() == last


def test_box_tracker_step_by_step():
    """By hand: born at frame 0, shown from its third step on, gone after the fifth frame missed in a row (each hit makes good three)."""
    t = trackers.BoxTracker(1)
    det = [(0, 0.0, 0.0, 10.0, 10.0, 0.8, 2)]
    assert [len(t.step(n, det)) for n in range(4)] == [0, 0, 1, 1] and t.tracks[0].stale == 0
    assert t.step(4, [(0, 0.0, 0.0, 10.0, 10.0, 0.3, 2)])[0][5:] == (pytest.approx(0.8 * 0.8 + 0.2 * 0.3), 2)
    assert [len(t.step(n, [])) for n in range(5, 11)] == [1, 1, 1, 1, 0, 0] and not t.tracks
    # two detections that overlap one track strongly both count as its hits; a third far away is a new one
    t = trackers.BoxTracker(1)
    t.step(0, det)
    t.step(1, [det[0], (1, 0.0, 0.0, 10.0, 10.2, 0.8, 2), (2, 50.0, 50.0, 60.0, 60.0, 0.8, 2)])
    assert [(x.name, x.hits) for x in t.tracks] == [("1:0:0", 3), ("1:1:2", 1)]


def test_box_tracker_options():
    # a track without a velocity stays half way between its boxes
    t = trackers.BoxTracker(1, motion="none")
    t.step(0, [(0, 0.0, 0.0, 10.0, 10.0, 0.8, 0)])
    t.step(1, [(0, 2.0, 0.0, 12.0, 10.0, 0.8, 0)])
    assert t.tracks[0].box() == [1.0, 0.0, 11.0, 10.0]
    # constant acceleration: after many steps it foretells x = n^2 / 8, which constant velocity lags behind
    ahead = {}
    for motion in ("acceleration", "velocity"):
        t = trackers.BoxTracker(1, motion=motion)
        for n in range(30):
            t.step(n, [(0, n * n / 8, 0.0, n * n / 8 + 40, 40.0, 0.8, 0)])
        t.tracks[0].predict()
        ahead[motion] = abs(t.tracks[0].box()[0] - 30 * 30 / 8)
    assert ahead["acceleration"] < 0.1 * ahead["velocity"] < 1
    # likeness decides between two equal overlaps, once tracks have a feature
    for beta, name in ((0.0, "b"), (None, "a")):
        t = trackers.BoxTracker(1, beta=beta)
        a, b = [1.0, 0.0], [0.0, 1.0]
        two = [(0, 0.0, 0.0, 10.0, 10.0, 0.8, 0, a), (1, 0.0, 4.0, 10.0, 14.0, 0.8, 0, b)]
        t.step(0, two)
        t.step(1, two)
        assert [np.allclose(x.feature, f) for x, f in zip(t.tracks, (a, b), strict=True)] == [True, True]
        m = trackers.overlap([x.box() for x in t.tracks], [two[0][1:5], two[1][1:5]], 1e-7)
        swapped = t.aptitude(m, [(*two[0][:7], b), (*two[1][:7], a)])
        assert ("b" if swapped[0, 0] < 0.6 * m[0, 0] else "a") == name and np.allclose(t.aptitude(m, [two[0][:7], two[1]]), m)


def test_score_tracker_step_by_step():
    """By hand: tracks of the first frame are sure at once, later ones after a match; a low score goes on with a track but starts none."""
    t = trackers.ScoreTracker("s")
    box = lambda x, score, i=0: (i, x, 0.0, x + 40, 80.0, score, 1)
    assert [r[0] for r in t.step(0, [box(0, 0.9), box(500, 0.3, 1)])] == ["s:0:0"]
    assert [r[0] for r in t.step(1, [box(1, 0.3)])] == ["s:0:0"]
    assert [r[0] for r in t.step(2, [box(2, 0.9), box(300, 0.9, 1)])] == ["s:0:0"] and len(t.tracked) == 2
    assert [r[0] for r in t.step(3, [box(2, 0.9), box(300, 0.9, 1)])] == ["s:0:0", "s:2:1"]
    assert t.step(4, []) == [] and len(t.lost) == 2
    assert [r[0] for r in t.step(20, [box(3, 0.9)])] == ["s:0:0"]
    assert t.step(60, []) == [] and not t.lost
    # overlap 0.6 with score 0.3 over the high threshold: 1 - 0.18 is over the limit, 1 - 0.6 is not
    for crowded, same in ((False, False), (True, True)):
        t = trackers.ScoreTracker("s", high=0.2, crowded=crowded)
        t.step(0, [box(0, 0.9)])
        assert ([r[0] for r in t.step(1, [box(10, 0.31)])] == ["s:0:0"]) is same


def test_point_tracker_step_by_step():
    """By hand: the counter starts at 11, a hit makes 1 (2 less the step's 1), and a track counts over 17, so from its eighth frame on."""
    t = trackers.PointTracker("p")
    det = [(0, 0.0, 0.0, 10.0, 10.0, 0.8, 0)]
    shown = [len(t.step(n, det)) for n in range(9)]
    assert shown == [0] * 7 + [1, 1] and t.tracks[0].hits == 19
    assert [len(t.step(9 + n, [])) for n in range(11)] == [1] * 10 + [0]
    # with period 2 a hit makes 3: 12, 15, 18
    t = trackers.PointTracker("p", period=2)
    assert [len(t.step(n, det)) for n in range(4)] == [0, 0, 1, 1] and t.tracks[0].POINT_MOST == 7
    # corners (3, 4) away: 5 on average, 7.07 in all coordinates
    away = [(0, 3.0, 4.0, 13.0, 14.0, 0.8, 0)]
    for distance, one in (("euclidean", False), ("corners", True), (trackers.DISTANCES["corners"], True)):
        t = trackers.PointTracker("p", limit=6.0, distance=distance)
        t.step(0, det)
        t.step(1, away)
        assert (len(t.tracks) == 1) is one


def test_tracks_of_streams_that_come_in_many_batches(spark, sf_dir):
    f = fixture(spark, sf_dir, "f4_stream").where("stream_id < 6")
    want = {k: sorted(map(str, trackers.track(f, k).collect())) for k in trackers.TRACKERS}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {k: sorted(map(str, trackers.track(f, k).collect())) for k in trackers.TRACKERS}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and all(want.values())


def test_mot_metrics_by_hand(spark):
    """Two truths in three frames; one track goes from the first truth to the second, one is a false alarm."""
    box = lambda x: (x, 0.0, x + 10.0, 10.0)
    kind = "seq long, frame_no int, id int, x1 double, y1 double, x2 double, y2 double"
    truth = spark.createDataFrame([(1, n, i, *box(100.0 * i)) for n in range(3) for i in (0, 1)], kind)
    found = [(1, 0, 7, *box(0.0)), (1, 0, 8, *box(100.0)), (1, 1, 7, *box(0.0)), (1, 2, 9, *box(0.0)), (1, 2, 8, *box(102.0)), (1, 2, 5, *box(500.0))]
    r = motmetrics.mot_metrics(truth, spark.createDataFrame(found, kind)).where("seq = 1").first()
    assert (r.n_truth, r.n_pred, r.tp, r.fp, r.fn, r.switches) == (6, 6, 5, 1, 1, 1)
    assert r.mota == pytest.approx(1 - 3 / 6) and r.motp == pytest.approx((1 - 80 / 120) / 5) and r.idf1 == pytest.approx(2 * 4 / 12)


def test_mot_metrics_in_parts_and_batches(spark, monkeypatch):
    """A sequence cut in the parts that its pairs join, and read in small batches, gives the pairs and scores of the whole."""
    rng = np.random.default_rng(6)
    kind = "seq long, frame_no int, id int, x1 double, y1 double, x2 double, y2 double"
    rows = [[], []]
    for seq in (1, 2):
        at = rng.uniform(0, 400, (25, 2))
        for n in range(12):
            at += rng.uniform(-3, 3, at.shape)
            for out, off in zip(rows, (0.0, 2.0), strict=True):
                for i, (x, y) in enumerate(at + rng.uniform(-off, off, at.shape)):
                    if rng.random() < 0.9:
                        out.append((seq, n, int(i if not off else 3 * i + n // 6), float(x), float(y), float(x) + 40, float(y) + 40))
    truth, tracks = (spark.createDataFrame(r, kind).repartition(3) for r in rows)

    def plain():
        """Pairs frame by frame, by the dense solver."""
        out = []
        for seq in (1, 2):
            before = {}
            for n in range(12):
                t, p = ([r for r in own if r[:2] == (seq, n)] for own in rows)
                cost = {}
                for a in t:
                    for b in p:
                        w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
                        both = w * h if w > 0 and h > 0 else 0.0
                        if 1 - both / (3200 - both) <= 0.5:
                            cost[a[2], b[2]] = 1 - both / (3200 - both)
                now = {a: b for a, b in before.items() if (a, b) in cost}
                rest = {k: c for k, c in cost.items() if k[0] not in now and k[1] not in now.values()}
                ts, ps = sorted({k[0] for k in rest}), sorted({k[1] for k in rest})
                made = within(np.array([[rest.get((a, b), 9.0) for b in ps] for a in ts]), 0.5) if rest else []
                now |= {ts[i]: ps[j] for i, j, *_ in made}
                before |= now
                out += [(seq, n, a, b) for a, b in now.items()]
        return sorted(out)

    want, scores = plain(), []
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for size in (motmetrics.WHOLE, 0):
            monkeypatch.setattr(motmetrics, "WHOLE", size)
            pairs = motmetrics.pairs_of(truth, tracks)
            assert (pairs.select("seq", "part").distinct().count() > 10) == (size == 0)
            assert sorted((r.seq, r.frame_no, r.t_id, r.p_id) for r in motmetrics.matches_of(pairs).collect()) == want
            got = motmetrics.mot_metrics(truth, tracks).drop("motp").collect()  # a sum of fractions in any order
            scores.append(sorted(map(str, got)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert scores[0] == scores[1] and len(scores[0]) == 3


def test_smoothed_features(spark):
    rows = [(1, n, 0.5, 0.0, 0.0, 1.0, 1.0, 0, f) for n, f in enumerate([None, [1.0, 0.0], [0.0, 1.0], None])]
    df = spark.createDataFrame(rows, "t long, frame_no int, score double, x1 double, y1 double, x2 double, y2 double, class_id int, feature array<double>")
    got = {r.frame_no: r.feature for r in track.smooth_tracks(df, ["t"], "feature").collect()}
    assert got[0] is None and got[1] == [1.0, 0.0] and got[2] == pytest.approx([0.9, 0.1]) and got[3] == got[2]


def test_models_are_built_once_per_worker(spark):
    def factory():
        return lambda b: b.assign(v=b.v + 1)

    px = gray(spark, NINE)
    assert grid(detect.infer(px, factory, PX, "plus one")) == [[v + 1 for v in r] for r in NINE]


def test_annotation_of_nothing(spark):
    frames = spark.createDataFrame([(1,)], "frame_id long")
    assert annotate.annotate_text(frames, "").count() == 0
    assert [r.y1 for r in annotate.annotate_text(frames, "", F.lit("5ms")).collect()] == [30]


def test_optimal_assignment_in_columns(spark):
    cost = [[1.0, 2.0, 9.0], [1.5, 9.0, 9.0], [9.0, 9.0, 1.0]]
    pairs = spark.createDataFrame([(1, i, j, c) for i, r in enumerate(cost) for j, c in enumerate(r)], "frame_id long, a_id int, b_id int, cost double")
    one = track.assign_optimal(pairs, ["frame_id"], 5.0)
    assert sorted((r.a_id, r.b_id) for r in one.collect()) == [(0, 1), (1, 0), (2, 2)]
    two = track.assign_greedy(pairs, ["frame_id"], 5.0)
    assert sorted((r.a_id, r.b_id) for r in two.collect()) == [(0, 0), (2, 2)]


# --- busy sources, crowded frames, large frames


def window_keys(df):
    """The windows in the plan."""
    text = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in text.split("\n") if "Window [" in line]


@pytest.mark.parametrize("bucket", ["day", "hour", "month"])
def test_numbers_run_on_over_buckets(spark, sf_dir, bucket):
    f = fixture(spark, sf_dir, "f5_frames")
    by = Window.partitionBy("source_id").orderBy("ts")
    want = f.withColumn("k", F.row_number().over(by)).withColumn("p", F.lag("frame_id").over(by)).withColumn("s", F.sum("frame_no").over(by))
    got = sampling.running(sampling.previous(sampling.numbered(f, "k", bucket=bucket), "frame_id", "p", bucket=bucket), "frame_no", "s", bucket=bucket)
    columns = ["frame_id", "k", "p", "s"]
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))


def test_previous_value_may_be_null(spark):
    rows = [(1, f"2024-01-0{d} 00:00:0{s}", v) for d, s, v in ((1, 1, 5), (1, 2, None), (3, 1, 7), (4, 1, None), (4, 2, 8))]
    f = spark.createDataFrame(rows, "source_id int, ts string, v int").withColumn("ts", F.col("ts").cast("timestamp"))
    got = sampling.previous(f, "v", "p").orderBy("ts").collect()
    assert [r.p for r in got] == [None, 5, None, 7, None]


def test_no_window_of_raw_rows_is_keyed_by_the_source_alone(spark, sf_dir):
    f = fixture(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), F.col("event_id").alias("frame_id"), F.col("event_id").alias("frame_no"), "ts")
    for df in (sampling.numbered(f, "k"), sampling.previous(f, "frame_id", "k"), sampling.running(f, "frame_no", "k"), sampling.recording_sessions(f.withColumn("has_frame", F.lit(True)))):
        lines = window_keys(df)
        raw = [x for x in lines if "_b#" not in x.split("windowspecdefinition(")[1].split(" ASC")[0] and "_e#" not in x]
        assert lines and not raw, raw


def test_means_run_on_over_blocks(spark, sf_dir):
    lat = fixture(spark, sf_dir, "f5_latency").where("seq % 7 <> 3")
    w = Window.partitionBy("node").orderBy("seq").rowsBetween(-9, 0)
    want = {(r.node, r.seq): r.m for r in lat.withColumn("m", F.avg("elapsed_ms").over(w)).collect()}
    for block in (1, 4, 50, 100_000):
        got = stats.fps(lat, block)
        assert {(r.node, r.seq): r.mean_ms for r in got.collect()} == want and got.count() == len(want)


def crowd(n, room, seed=0, giants=0):
    rng = np.random.default_rng(seed)
    xy, wh = rng.integers(0, room, (n, 2)), rng.integers(10, 60, (n, 2))
    wh[:giants] *= 20
    score = rng.integers(0, n // 2, n) / n  # with ties
    return pd.DataFrame({"frame_id": 1, "det_id": range(n), "x1": xy[:, 0] * 1.0, "y1": xy[:, 1] * 1.0, "x2": (xy + wh)[:, 0] * 1.0, "y2": (xy + wh)[:, 1] * 1.0, "score": score, "class_id": rng.integers(0, 2, n)})


def nms_by_hand(d, th):
    d = d.sort_values(["score", "det_id"], ascending=[False, True])
    b = d[["x1", "y1", "x2", "y2"]].to_numpy()
    left, kept = np.arange(len(d)), []
    while len(left):
        i, rest = left[0], left[1:]
        kept.append(i)
        w = np.maximum(0, np.minimum(b[rest, 2], b[i, 2]) - np.maximum(b[rest, 0], b[i, 0]))
        h = np.maximum(0, np.minimum(b[rest, 3], b[i, 3]) - np.maximum(b[rest, 1], b[i, 1]))
        area = lambda x: (x[..., 2] - x[..., 0]) * (x[..., 3] - x[..., 1])
        left = rest[~(w * h / (area(b[rest]) + area(b[i]) - w * h) > th)]
    return sorted(d.det_id.iloc[kept])


@pytest.mark.parametrize("n, room, giants", [(3000, 300, 20), (20000, 4000, 5)])
def test_crowded_frames(spark, n, room, giants):
    d = crowd(n, room, giants=giants)
    got = detect.nms_crowded(spark.createDataFrame(d), 0.45, crowd=500)
    assert sorted(r.det_id for r in got.collect()) == nms_by_hand(d, 0.45)


def test_crowded_frames_with_odd_boxes(spark):
    d = crowd(60, 50)
    d.loc[3, "x1"] = float("nan")
    d.loc[4, "y2"] = float("inf")
    got = {r.det_id for r in detect.nms_crowded(spark.createDataFrame(d), 0.45, crowd=10).collect()}
    assert {3, 4} <= got and got - {3, 4} == set(nms_by_hand(d.drop([3, 4]), 0.45))
    assert detect.nms_crowded(spark.createDataFrame(d).limit(0), 0.45).count() == 0


@pytest.mark.parametrize("touch", [False, True])
def test_overlapping_pairs_are_those_of_all_pairs(spark, touch):
    d = spark.createDataFrame(crowd(300, 2000, giants=6)).withColumn("z1", F.col("score") * 10).withColumn("z2", F.col("z1") + 1)
    a, b = d.withColumnRenamed("det_id", "a_id"), d.withColumnRenamed("det_id", "b_id")
    for axes in ((("x1", "x2"), ("y1", "y2")), (("x1", "x2"), ("y1", "y2"), ("z1", "z2")), (("x1", "x2"),)):
        every = track.iou_pairs(a, b, ["frame_id"], plus_one=touch, axes=axes).where("iou > 0")
        met = track.iou_pairs(a, b, ["frame_id"], plus_one=touch, axes=axes, only_overlapping=True)
        key = lambda df: sorted((r.a_id, r.b_id, round(r.iou, 9)) for r in df.collect())
        assert key(met) == key(every)


def test_sparse_assignment_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n, m, limit = *rng.integers(1, 5, 2), float(rng.choice([0, 3, 10]))
        cost = {(i, j): float(rng.integers(-6, 12)) for i in range(n) for j in range(m) if rng.random() < 0.6}
        got = sparse([i for i, _ in cost], [j for _, j in cost], list(cost.values()), limit)
        assert len({i for i, *_ in got}) == len({j for _, j, _ in got}) == len(got) and all(cost[i, j] == c <= limit for i, j, c in got)

        def best(i, used):
            if i == n:
                return 0.0
            return min([best(i + 1, used), *(cost[i, j] - limit + best(i + 1, used | {j}) for j in range(m) if j not in used and cost.get((i, j), limit + 1) <= limit)])

        assert sum(c - limit for *_, c in got) == pytest.approx(best(0, frozenset()))


def test_a_sequence_with_many_names(spark):
    n = 10_000
    rows = [(1, i, (i + k) % n, abs(k) + 0.5) for i in range(n) for k in (-1, 0, 1)]
    got = track.assign_optimal(spark.createDataFrame(rows, "g int, a_id int, b_id int, cost double"), ["g"], 5.0)
    assert got.agg(F.count("*"), F.sum("cost")).first() == (n, n / 2)


def test_extra_matches(spark):
    pairs = spark.createDataFrame([(1, 0, 0, 0.9), (1, 0, 1, 0.8), (1, 1, 1, 0.05), (1, 2, 0, 0.85)], "g int, a_id int, b_id int, iou double")
    own = spark.createDataFrame([(1, 0, 0), (1, 1, 1)], "g int, a_id int, b_id int")
    key = lambda df: sorted((r.a_id, r.b_id, r.extra) for r in df.collect())
    assert key(track.multi_match(pairs, own, ["g"])) == [(0, 0, False)]
    assert key(track.multi_match(pairs, own, ["g"], multi=0.7)) == [(0, 0, False), (0, 1, True)]


def test_tiles_don_t_show(spark):
    rng = np.random.default_rng(2)
    px = gray(spark, rng.integers(0, 256, (21, 34)).tolist())
    kernel = [[0.1, -0.3, 0.2], [0.5, 1.0, -0.2], [0.3, 0.1, 0.4]]
    for op in (lambda t: stencil.box_blur(px, 5, 34, 21, tile=t), lambda t: stencil.box_blur(px, 8, 34, 21, tile=t), lambda t: stencil.filter3x3(px, kernel, 1.5, 34, 21, tile=t), lambda t: stencil.mscn(px, 34, 21, tile=t).withColumn("v", F.round("m", 9)), lambda t: stencil.canny(px, 60, 200, 34, 21, tile=t)):
        assert grid(op(8)) == grid(op(64)) == grid(op(5))


def test_an_edge_through_many_tiles(spark):
    """A faint step down a frame, a bit stronger at one end: the whole chain is an edge."""
    n = 40
    faint = np.zeros((n, n), int)
    faint[:, 20:] = 30
    a = faint.copy()
    a[:3, 20:] = 31
    got = np.array(grid(stencil.canny(gray(spark, a.tolist()), 60, 122, n, n, tile=5)))
    assert (got == np.array(grid(stencil.canny(gray(spark, a.tolist()), 60, 122, n, n, tile=64)))).all()
    assert (got.max(1) == 255).all()
    assert not np.array(grid(stencil.canny(gray(spark, faint.tolist()), 60, 122, n, n, tile=5))).any()


def test_stencils_have_one_exchange(spark, sf_dir):
    px = fixture(spark, sf_dir, "f10_mosaic")
    for df in (stencil.box_blur(px, 5, 64, 64), stencil.filter3x3(px, [[0, 0, 0], [0, 1, 0], [0, 0, 0]], 1.0, 64, 64), stencil.mscn(px, 64, 64)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        plain = px._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == plain.count("Exchange hashpartitioning") + 1


def test_parts_of_a_graph(spark):
    links = [(1, i, i + 1) for i in range(30)] + [(2, 5, 9), (2, 9, 7), (1, 100, 50)]
    got = joined(spark.createDataFrame(links, "g int, a long, b long"), "g").collect()
    want = {(1, i): 0 for i in range(31)} | {(2, k): 5 for k in (5, 7, 9)} | {(1, 50): 50, (1, 100): 50}
    assert {(r.g, r.node): r.root for r in got} == want and len(got) == len(want)


def box_filter_by_hand(values, lengths):
    out, at, dt, q = [], 0, 1 / 30, 5000.0
    for n in lengths:
        axes, sizes = [], []
        for z in values[at : at + n]:
            if not axes:
                axes, sizes = [trackers.Axis(v, 1000.0, 1000.0) for v in z[:2]], [[v, 1000.0] for v in z[2:]]
            else:
                for a, v in zip(axes, z[:2], strict=True):
                    a.predict(dt, q * dt**4 / 4, q * dt**3 / 2, q * dt**2)
                    a.update(v, 0.1)
                for s, v in zip(sizes, z[2:], strict=True):
                    s[1] += 10
                    k = s[1] / (s[1] + 1)
                    s[0], s[1] = s[0] + k * (v - s[0]), s[1] * (1 - k)
            out.append([*(a.x for a in axes), *(s[0] for s in sizes), *(a.v for a in axes)])
        at += n
    return np.array(out)


def test_filters_in_segments_are_those_step_by_step():
    rng = np.random.default_rng(0)
    lengths = np.array([1, 2, 700, 3, 1025, 257, 256, 5])
    values = 50 + rng.normal(0, 1, (lengths.sum(), 4)).cumsum(0)
    assert np.abs(track._box_run(values, lengths) - box_filter_by_hand(values, lengths)).max() < 1e-9
    assert track._box_run(values[:0], lengths[:0]).shape == (0, 6)


def test_tracks_over_many_batches(spark, sf_dir):
    f = fixture(spark, sf_dir, "f4_stream")
    key = lambda df: sorted(str(r) for r in df.collect())
    want = [key(track.kalman_smooth(f, ["stream_id", "det_id"], m)) for m in ("box", "xyah")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = [key(track.kalman_smooth(f, ["stream_id", "det_id"], m)) for m in ("box", "xyah")]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and track.kalman_smooth(f.limit(0), ["stream_id", "det_id"]).count() == 0
