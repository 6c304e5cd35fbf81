"""Multi-object trackers as keyed state: one step per frame of a stream, the same in batch and in a stream.

A tracker has a `step(frame_no, dets)` that returns rows (track_id, x1, y1, x2, y2, score, class_id); dets is a list of
(det_id, x1, y1, x2, y2, score, class_id), and a feature (a list of numbers or None) where dets have one. State is plain numbers, so it pickles. Track ids tell stream, frame and
detection of a track's birth. Every axis of the motion models is a filter of its own: position and velocity, or a size.
"""

from __future__ import annotations

import pickle
from itertools import groupby
from math import sqrt
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from pixeltide.functions.assign import SMALL, greedy, optimal, optimal_of, plain, within
from pixeltide.operators.params import dealt

SCHEMA = "stream_id long, frame_no int, track_id string, x1 double, y1 double, x2 double, y2 double, score double, class_id int"


class Axis:
    """Constant-velocity filter of one number."""

    def __init__(self, z, p_pos, p_vel):
        self.x, self.v, self.a, self.b, self.c = z, 0.0, p_pos, 0.0, p_vel

    def predict(self, dt, q_pos, q_both, q_vel):
        self.x += dt * self.v
        self.a += 2 * dt * self.b + dt * dt * self.c + q_pos
        self.b += dt * self.c + q_both
        self.c += q_vel

    def update(self, z, r):
        s = self.a + r
        k, l = self.a / s, self.b / s  # noqa: E741
        y = z - self.x
        self.x += k * y
        self.v += l * y
        self.c -= l * self.b
        self.b *= 1 - k
        self.a *= 1 - k


def overlap(a: np.ndarray, b: np.ndarray, eps: float = 0.0) -> np.ndarray:
    """IoU of all pairs of two lists of boxes."""
    a, b = np.asarray(a, float).reshape(-1, 1, 4), np.asarray(b, float).reshape(1, -1, 4)
    side = np.maximum(0, np.minimum(a[..., 2:], b[..., 2:]) - np.maximum(a[..., :2], b[..., :2]))
    both = side.prod(-1)
    area = (a[..., 2:] - a[..., :2]).prod(-1) + (b[..., 2:] - b[..., :2]).prod(-1) - both
    return np.divide(both, area + eps, out=np.zeros_like(both), where=area + eps > 0)


def overlap_of(a: list, b: list, eps: float = 0.0) -> list[list[float]]:
    """`overlap` of two short lists of boxes, as lists: the same steps with plain numbers."""
    if len(a) * len(b) > SMALL:
        return overlap(a, b, eps).tolist()
    out = []
    other = [(x1, y1, x2, y2, (x2 - x1) * (y2 - y1)) for x1, y1, x2, y2 in b]
    for p1, q1, p2, q2 in a:
        own, row = (p2 - p1) * (q2 - q1), []
        for x1, y1, x2, y2, size in other:
            w, h = (p2 if p2 < x2 else x2) - (p1 if p1 > x1 else x1), (q2 if q2 < y2 else y2) - (q1 if q1 > y1 else y1)
            if w != w or h != h:
                row.append(_NAN)
                continue
            both = w * h if w > 0 and h > 0 else 0.0
            area = own + size - both
            row.append(both / (area + eps) if area + eps > 0 else 0.0)
        out.append(row)
    return out


_NAN = float("nan")
MOTIONS = ("velocity", "acceleration", "none")


class BoxTrack:
    """A track of the box tracker: moving centre, static size, smoothed score and feature, most frequent class.

    Its motion is of constant velocity or acceleration, or none: then a box is half the old and half the new one. How sure a
    filter is follows from when it is updated, not from what with: both axes share it, and both sizes.
    """

    DT, Q, R, Q_SIZE, R_SIZE, P0 = 1 / 30, 5000.0, 0.1, 10.0, 1.0, 1000.0
    TWO_DT, DT_DT, Q_POS, Q_BOTH, Q_VEL = 2 * DT, DT * DT, Q * DT**4 / 4, Q * DT**3 / 2, Q * DT**2
    __slots__ = ("name", "score", "alive", "hits", "stale", "motion", "feature", "classes", "x", "y", "w", "h", "vx", "vy", "ax", "ay", "p", "s")

    def __init__(self, name, det, motion="velocity"):
        _, x1, y1, x2, y2, score, cls, *_ = det
        self.name, self.score, self.alive, self.hits, self.stale, self.motion, self.feature = name, score, 1, 1, 0, motion, None
        self.x, self.y, self.w, self.h = (x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1
        self.vx = self.vy = self.ax = self.ay = 0.0
        self.p = (self.P0, 0.0, 0.0, self.P0, 0.0, self.P0) if motion == "acceleration" else (self.P0, 0.0, self.P0)
        self.s = self.P0
        self.classes = {cls: 1}

    def predict(self):
        self.alive += 1
        if self.motion == "none":
            return
        dt = self.DT
        if self.motion == "velocity":
            a, b, c = self.p
            self.x += dt * self.vx
            self.y += dt * self.vy
            self.p = a + (self.TWO_DT * b + self.DT_DT * c + self.Q_POS), b + (dt * c + self.Q_BOTH), c + self.Q_VEL
        else:
            half, q = dt * dt / 2, self.Q
            self.x, self.vx = self.x + dt * self.vx + half * self.ax, self.vx + dt * self.ax
            self.y, self.vy = self.y + dt * self.vy + half * self.ay, self.vy + dt * self.ay
            p00, p01, p02, p11, p12, p22 = self.p
            r00, r01, r02 = p00 + dt * p01 + half * p02, p01 + dt * p11 + half * p12, p02 + dt * p12 + half * p22
            r11, r12 = p11 + dt * p12, p12 + dt * p22
            self.p = (
                r00 + dt * r01 + half * r02 + q * (half * half), r01 + dt * r02 + q * (half * dt), r02 + q * half,
                r11 + dt * r12 + q * (dt * dt), r12 + q * dt, p22 + q,
            )
        self.s += self.Q_SIZE

    def update(self, det):
        x1, y1, x2, y2, score, cls = det[1:7]
        x, y = (x1 + x2) / 2, (y1 + y2) / 2
        if self.motion == "velocity":
            a, b, c = self.p
            k, l = a / (a + self.R), b / (a + self.R)  # noqa: E741
            dx, dy = x - self.x, y - self.y
            self.x += k * dx
            self.y += k * dy
            self.vx += l * dx
            self.vy += l * dy
            self.p = a * (1 - k), b * (1 - k), c - l * b
        elif self.motion == "none":
            self.x, self.y = (self.x + x) / 2, (self.y + y) / 2
        else:
            p00, p01, p02, p11, p12, p22 = self.p
            k, l, m = p00 / (p00 + self.R), p01 / (p00 + self.R), p02 / (p00 + self.R)  # noqa: E741
            dx, dy = x - self.x, y - self.y
            self.x, self.vx, self.ax = self.x + k * dx, self.vx + l * dx, self.ax + m * dx
            self.y, self.vy, self.ay = self.y + k * dy, self.vy + l * dy, self.ay + m * dy
            self.p = p00 - k * p00, p01 - k * p01, p02 - k * p02, p11 - l * p01, p12 - l * p02, p22 - m * p02
        k = 0.5 if self.motion == "none" else self.s / (self.s + self.R_SIZE)
        self.w += k * (x2 - x1 - self.w)
        self.h += k * (y2 - y1 - self.h)
        self.s *= 1 - k
        self.hits += 1
        self.classes[cls] = self.classes.get(cls, 0) + 1
        self.score = 0.8 * self.score + 0.2 * score
        if len(det) > 7 and det[7] is not None:
            new = np.asarray(det[7], float)
            self.feature = new if self.feature is None else 0.9 * self.feature + 0.1 * new
        self.stale = max(0, self.stale - 3)

    @property
    def cls(self):
        return max(self.classes, key=self.classes.get) if len(self.classes) > 1 else next(iter(self.classes))

    def box(self):
        w, h = self.w / 2, self.h / 2
        return [self.x - w, self.y - h, self.x + w, self.y + h]


class BoxTracker:
    """Optimal matching by IoU; further detections that overlap a matched track strongly update it too.

    With beta, overlaps count beta + (1 - beta) times the likeness of features (1 less half their cosine distance) when
    tracks are matched, as long as all tracks and detections of a frame have one; a track has none before its first match.
    """

    def __init__(self, stream, min_iou=0.25, multi_iou=0.93, max_stale=5, min_alive=3, motion="velocity", beta=None):
        assert motion in MOTIONS
        self.motion, self.beta = motion, beta
        self.stream, self.min_iou, self.multi_iou, self.max_stale, self.min_alive = stream, min_iou, multi_iou, max_stale, min_alive
        self.tracks: list[BoxTrack] = []

    def aptitude(self, m, dets):
        a, b = [t.feature for t in self.tracks], [d[7] if len(d) > 7 else None for d in dets]
        if self.beta is None or any(x is None for x in [*a, *b]):
            return m
        unit = lambda rows: (v := np.array([np.asarray(x, float) for x in rows])) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        like = 1 - np.maximum(0.0, 1 - unit(a) @ unit(b).T) / 2
        return m * (self.beta + (1 - self.beta) * like)

    def held(self) -> bool:
        return bool(self.tracks)

    def step(self, frame_no, dets):
        dets = [d for d in dets if None not in d[1:5] and d[1] == d[1] and d[2] == d[2] and d[3] == d[3] and d[4] == d[4]]
        for t in self.tracks:
            t.predict()
        known = len(self.tracks)
        pairs = []
        if known and dets:
            m = overlap_of([t.box() for t in self.tracks], [d[1:5] for d in dets], 1e-7)
            if self.beta is None and plain(m):
                made = optimal_of([[-x for x in row] for row in m])
            else:
                made = optimal(-self.aptitude(np.array(m), dets))
            for i, j in made:
                row = m[i]
                if row[j] >= self.min_iou:
                    pairs.append((i, j))
                pairs += [(i, k) for k, x in enumerate(row) if x > self.multi_iou and k != j]
        for i, j in pairs:
            self.tracks[i].update(dets[j])
        matched, taken = {i for i, _ in pairs}, {j for _, j in pairs}
        self.tracks += [BoxTrack(f"{self.stream}:{frame_no}:{d[0]}", d, self.motion) for j, d in enumerate(dets) if j not in taken]
        kept, out = [], []
        for i, t in enumerate(self.tracks):
            if i not in matched:  # new tracks count as unmatched in their first step
                t.stale += 1
            x1, y1, x2, y2 = t.box()
            if t.stale < self.max_stale and x1 == x1 and y1 == y1 and x2 == x2 and y2 == y2:
                kept.append(t)
                if t.alive >= self.min_alive and t.stale / t.hits < 3 and t.stale < 999:
                    out.append((t.name, x1, y1, x2, y2, t.score, t.cls))
        self.tracks = kept
        return out


class ScoreTrack:
    """A track of the two-threshold tracker: centre, aspect and height, all with velocity, noise in shares of the height.

    Centre and height share how sure their filters are (p); the aspect has its own (q).
    """

    POS, VEL = 1 / 20, 1 / 160
    __slots__ = ("name", "cls", "start", "last", "sure", "lost", "score", "x", "y", "r", "h", "vx", "vy", "vr", "vh", "p", "q")

    def __init__(self, name, det, frame_no, sure):
        self.name, self.cls, self.start, self.last, self.sure, self.lost = name, det[6], frame_no, frame_no, sure, False
        self.x, self.y, self.r, self.h = self.measure(det)
        self.vx = self.vy = self.vr = self.vh = 0.0
        self.p = (2 * self.POS * self.h) ** 2, 0.0, (10 * self.VEL * self.h) ** 2
        self.q = 1e-4, 0.0, 1e-10
        self.score = det[5]

    @staticmethod
    def measure(det):
        x1, y1, x2, y2 = det[1:5]
        w, h = x2 - x1, y2 - y1
        return (x1 + x2) / 2, (y1 + y2) / 2, w / h if h else 0.0, h

    def predict(self):
        h = self.h
        if self.lost:
            self.vh = 0.0
        self.x += self.vx
        self.y += self.vy
        self.r += self.vr
        self.h += self.vh
        a, b, c = self.p
        self.p = a + (2 * b + c + (self.POS * h) ** 2), b + c, c + (self.VEL * h) ** 2
        a, b, c = self.q
        self.q = a + (2 * b + c + 1e-4), b + c, c + 1e-10

    def update(self, det, frame_no):
        x, y, r, h = self.measure(det)
        a, b, c = self.p
        s = a + (self.POS * self.h) ** 2
        k, l = a / s, b / s  # noqa: E741
        dx, dy, dh = x - self.x, y - self.y, h - self.h
        self.x += k * dx
        self.y += k * dy
        self.h += k * dh
        self.vx += l * dx
        self.vy += l * dy
        self.vh += l * dh
        self.p = a * (1 - k), b * (1 - k), c - l * b
        a, b, c = self.q
        s = a + 1e-2
        k, l = a / s, b / s  # noqa: E741
        dr = r - self.r
        self.r += k * dr
        self.vr += l * dr
        self.q = a * (1 - k), b * (1 - k), c - l * b
        self.score, self.last, self.sure, self.lost = det[5], frame_no, True, False

    def box(self):
        x, y, r, h = self.x, self.y, self.r, self.h
        return [x - r * h / 2, y - h / 2, x + r * h / 2, y + h / 2]


class ScoreTracker:
    """High scores are matched first, then low ones with what is left; unmatched tracks stay lost for a while.

    crowded: overlaps are not weighed by scores.
    """

    def __init__(self, stream, high=0.5, low=0.1, match=0.8, again=0.5, unsure=0.7, fps=30, buffer=30, min_area=10.0, crowded=False):
        self.crowded = crowded
        self.stream, self.high, self.low, self.match, self.again, self.unsure = stream, high, low, match, again, unsure
        self.keep, self.min_area, self.frames = int(fps / 30 * buffer), min_area, 0
        self.tracked: list[ScoreTrack] = []
        self.lost: list[ScoreTrack] = []

    def pairs(self, tracks, dets, limit, fuse):
        if not tracks or not dets:
            return []
        m = overlap_of([t.box() for t in tracks], [d[1:5] for d in dets])
        if fuse and not self.crowded:
            return within([[1 - x * d[5] for x, d in zip(row, dets, strict=True)] for row in m], limit)
        return within([[1 - x for x in row] for row in m], limit)

    def held(self) -> bool:
        return bool(self.tracked or self.lost)

    def step(self, frame_no, dets):
        self.frames += 1
        strong = [d for d in dets if d[5] > self.high]
        weak = [d for d in dets if self.low < d[5] < self.high]
        sure, unsure = [t for t in self.tracked if t.sure], [t for t in self.tracked if not t.sure]
        pool = sure + self.lost
        for t in pool:
            t.predict()
        first = self.pairs(pool, strong, self.match, True)
        for i, j in first:
            pool[i].update(strong[j], frame_no)
        hit, taken = {i for i, _ in first}, {j for _, j in first}
        rest = [t for i, t in enumerate(pool) if i not in hit and not t.lost]
        second = self.pairs(rest, weak, self.again, False)
        for i, j in second:
            rest[i].update(weak[j], frame_no)
        hit2 = {i for i, _ in second}
        for i, t in enumerate(rest):
            if i not in hit2:
                t.lost = True
        left = [d for j, d in enumerate(strong) if j not in taken]
        third = self.pairs(unsure, left, self.unsure, True)
        for i, j in third:
            unsure[i].update(left[j], frame_no)
        hit3, taken3 = {i for i, _ in third}, {j for _, j in third}
        born = [ScoreTrack(f"{self.stream}:{frame_no}:{d[0]}", d, frame_no, self.frames == 1) for j, d in enumerate(left) if j not in taken3 and d[5] >= self.high + 0.1]
        every = pool + [t for i, t in enumerate(unsure) if i in hit3] + born
        self.tracked = [t for t in every if not t.lost]
        self.lost = [t for t in every if t.lost and frame_no - t.last <= self.keep]
        if self.tracked and self.lost:
            gone_a, gone_b = set(), set()
            near = overlap_of([t.box() for t in self.tracked], [t.box() for t in self.lost])
            for i, j in [(i, j) for i, row in enumerate(near) for j, x in enumerate(row) if 1 - x < 0.15]:
                a, b = self.tracked[i], self.lost[j]
                (gone_b if a.last - a.start > b.last - b.start else gone_a).add(j if a.last - a.start > b.last - b.start else i)
            self.tracked = [t for i, t in enumerate(self.tracked) if i not in gone_a]
            self.lost = [t for j, t in enumerate(self.lost) if j not in gone_b]
        out = []
        for t in self.tracked:
            if not t.sure:
                continue
            x1, y1, x2, y2 = t.box()
            if (x2 - x1) * (y2 - y1) > self.min_area:
                out.append((t.name, x1, y1, x2, y2, t.score, t.cls))
        return out


class PointTrack:
    """A track of the point tracker: four coordinates with velocity, a hit counter, and counters for both corners.

    All coordinates share how sure their filters are.
    """

    R, Q_POS, Q_VEL, P_POS, P_VEL = 4.0, 1.0, 0.1, 1.0, 10.0
    __slots__ = ("LEAST", "MOST", "period", "DELAY", "POINT_LEAST", "POINT_MOST", "name", "score", "cls", "hits", "known", "points", "seen", "at", "v", "p")

    def __init__(self, name, det, least=10, most=25, delay=None, period=1):
        self.LEAST, self.MOST, self.period = least, most, period
        self.DELAY = (most - least) // 2 if delay is None else delay
        self.POINT_LEAST, self.POINT_MOST = least // 4, max(-(-most // 4), least // 4 + period)
        self.name, self.score, self.cls = name, det[5], det[6]
        self.hits, self.known, self.points, self.seen = self.LEAST + period, False, self.POINT_LEAST, False
        self.at, self.v, self.p = list(det[1:5]), (0.0, 0.0, 0.0, 0.0), (self.P_POS, 0.0, self.P_VEL)

    def predict(self):
        self.hits -= 1
        self.points -= 1
        (x1, y1, x2, y2), (vx1, vy1, vx2, vy2), (a, b, c) = self.at, self.v, self.p
        self.at = [x1 + vx1, y1 + vy1, x2 + vx2, y2 + vy2]
        self.p = a + (2 * b + c + self.Q_POS), b + c, c + self.Q_VEL

    def box(self):
        return self.at

    def update(self, det):
        if self.hits < self.MOST:
            self.hits += 2 * self.period
        over = det[5] > 0
        if over:
            self.points += 2 * self.period
        self.points = max(0, min(self.points, self.POINT_MOST))
        if over:
            a, b, c = self.p
            s = a + self.R
            k, l = a / s, b / s  # noqa: E741
            (x1, y1, x2, y2), (z1, t1, z2, t2) = self.at, det[1:5]
            d1, e1, d2, e2 = z1 - x1, t1 - y1, z2 - x2, t2 - y2
            self.at = [x1 + k * d1, y1 + k * e1, x2 + k * d2, y2 + k * e2]
            vx1, vy1, vx2, vy2 = self.v
            self.v = vx1 + l * d1, vy1 + l * e1, vx2 + l * d2, vy2 + l * e2
            self.p = a * (1 - k), b * (1 - k), c - l * b
        if not self.seen:
            self.v = 0.0, 0.0, 0.0, 0.0
        self.seen |= over
        self.score = det[5]

    def settle(self):
        self.known |= self.hits > self.LEAST + self.DELAY
        return self.known


#: Distances of all pairs of two arrays of boxes: of all four coordinates, of the corners on average, and of overlap.
DISTANCES = {
    "euclidean": lambda a, b: np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1)),
    "corners": lambda a, b: np.sqrt(((a[:, None] - b[None]).reshape(len(a), len(b), 2, 2) ** 2).sum(-1)).mean(-1),
    "iou": lambda a, b: 1 - overlap(a, b),
}


def _euclidean(a, b):
    p, q, r, s = a[0] - b[0], a[1] - b[1], a[2] - b[2], a[3] - b[3]
    return sqrt(p * p + q * q + r * r + s * s)


def _corners(a, b):
    p, q, r, s = a[0] - b[0], a[1] - b[1], a[2] - b[2], a[3] - b[3]
    return (sqrt(p * p + q * q) + sqrt(r * r + s * s)) / 2


#: The same of two boxes, with plain numbers.
SINGLE = {"euclidean": _euclidean, "corners": _corners, "iou": lambda a, b: 1 - overlap_of([a], [b])[0][0]}


class PointTracker:
    """Greedy matching by a distance of both corners; tracks count once they were hit often enough.

    distance: a name of DISTANCES, or a function of two arrays of boxes that can be pickled. period: frames from one step
    to the next, which a hit makes good. least, most, delay: bounds of the hit counter, and how far over the least one a
    track counts (half the range if None).
    """

    def __init__(self, stream, limit=30.0, distance="euclidean", period=1, least=10, most=25, delay=None):
        self.stream, self.limit, self.distance = stream, limit, distance
        self.options = {"least": least, "most": most, "delay": delay, "period": period}
        self.tracks: list[PointTrack] = []

    def match(self, tracks, dets):
        if not tracks or not dets:
            return dets
        if isinstance(self.distance, str) and len(tracks) * len(dets) <= SMALL:
            one, boxes = SINGLE[self.distance], [t.box() for t in tracks]
            cost = [[one(d[1:5], b) for b in boxes] for d in dets]
        else:
            a, b = np.array([d[1:5] for d in dets], float), np.array([t.box() for t in tracks])
            cost = (DISTANCES[self.distance] if isinstance(self.distance, str) else self.distance)(a, b)
        taken = set()
        for i, j in greedy(cost, self.limit):
            tracks[j].update(dets[i])
            taken.add(i)
        return [d for i, d in enumerate(dets) if i not in taken]

    def held(self) -> bool:
        return bool(self.tracks)

    def step(self, frame_no, dets):
        self.tracks = [t for t in self.tracks if t.hits >= t.LEAST]
        for t in self.tracks:
            t.predict()
        known = [t.settle() for t in self.tracks]
        left = self.match([t for t, k in zip(self.tracks, known, strict=True) if k], list(dets))
        left = self.match([t for t in self.tracks if not t.settle()], left)
        self.tracks += [PointTrack(f"{self.stream}:{frame_no}:{d[0]}", d, **self.options) for d in left]
        return [(t.name, *t.box(), t.score, t.cls) for t in self.tracks if t.settle()]


TRACKERS = {"box": BoxTracker, "score": ScoreTracker, "point": PointTracker}
PER_CLASS = {"box": False, "score": True, "point": True}
FIELDS = ["det_id", "x1", "y1", "x2", "y2", "score", "class_id"]


NAMES = ["stream_id", "frame_no", "track_id", *FIELDS[1:]]


def through(tracker, last: int | None, n: int, dets: list, put) -> int:
    """Steps to frame n, which holds dets, through the gap before it while a track is held: put(frame, rows). Gives the last frame."""
    if last is not None:
        if n <= last:
            return last
        for gap in range(last + 1, n):
            if not tracker.held():  # nothing changes until the next detections
                break
            put(gap, tracker.step(gap, []))
    put(n, tracker.step(n, dets))
    return n


def advance(tracker, last: int | None, rows: pd.DataFrame, stream: int) -> tuple[pd.DataFrame, int | None]:
    """Steps through the frames of rows, in order, and through gaps while a track is held; frames up to `last` came before and are left out."""
    out, fields = [], [*FIELDS, *[c for c in ("feature",) if c in rows.columns]]
    rows = rows.dropna(subset=["frame_no"]).sort_values(["frame_no", "det_id"])

    def put(frame, made):
        out.extend((stream, frame, *t) for t in made)

    dets = zip(*(rows[c].tolist() for c in fields), strict=True)
    for n, frame in groupby(zip(rows["frame_no"].tolist(), dets, strict=True), key=itemgetter(0)):
        last = through(tracker, last, int(n), [d for _, d in frame], put)
    return pd.DataFrame(out, columns=NAMES), None if last is None else int(last)


def _column(batch: pa.RecordBatch, name: str) -> list:
    """Plain values: whole numbers, NaN for a missing fraction, arrays of fractions."""
    x = batch.column(name)
    if pa.types.is_list(x.type):
        at, values = x.offsets.to_numpy(), x.values.to_numpy(zero_copy_only=False).astype(float)
        return [values[i:j] if ok else None for i, j, ok in zip(at[:-1].tolist(), at[1:].tolist(), x.is_valid().to_pylist(), strict=True)]
    return x.to_pylist() if x.null_count and not pa.types.is_floating(x.type) else x.to_numpy(zero_copy_only=False).tolist()


LOT = 20_000  # rows given out at a time


def track(dets: DataFrame, kind: str, **params) -> DataFrame:
    """Tracks of dets(stream_id, frame_no, det_id, x1..y2, score, class_id[, feature]), per stream (and class, by kind).

    A stream is a sequence by its nature, so streams are the unit of parallel work. Its rows come sorted, in batches, and
    only the tracker and one frame are kept between them.
    """
    keys = ["stream_id", "class_id"] if PER_CLASS[kind] else ["stream_id"]
    fields = [*FIELDS, *[c for c in ("feature",) if c in dets.columns]]
    kinds = pa.schema([("stream_id", pa.int64()), ("frame_no", pa.int32()), ("track_id", pa.string()), *[(c, pa.float64()) for c in FIELDS[1:6]], ("class_id", pa.int32())])

    def frames(batches):
        """(key, frame, its detections), and how they go on in the next batch."""
        now, frame = None, []
        for b in batches:
            columns = [zip(*(_column(b, k) for k in keys), strict=True), _column(b, "frame_no"), zip(*(_column(b, c) for c in fields), strict=True)]
            for key, n, det in zip(*columns, strict=True):
                if n is None:
                    continue
                if (key, n) != now:
                    if frame:
                        yield *now, frame
                    now, frame = (key, n), []
                frame.append(det)
        if frame:
            yield *now, frame

    def run(batches):
        key, tracker, last, stream, out = None, None, None, None, []

        def put(frame, made):
            out.extend((stream, frame, *t) for t in made)

        for k, n, frame in frames(batches):
            if k != key:
                key, last, stream = k, None, int(k[0])
                tracker = TRACKERS[kind](f"{stream}:{int(k[1])}" if PER_CLASS[kind] else stream, **params)
            last = through(tracker, last, n, frame, put)
            if len(out) >= LOT:
                yield _batch(out, kinds)
                out.clear()
        if out:
            yield _batch(out, kinds)

    rows = dets.select("stream_id", "frame_no", *fields)
    return dealt(rows, *keys).sortWithinPartitions(*keys, "frame_no", "det_id").mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)


def save(tracker) -> bytes:
    return pickle.dumps(tracker)


def load(raw: bytes):
    return pickle.loads(raw)  # our own state, written by save()
