"""Whitening of embeddings by eigenvectors refined in mixed precision.

1. Entries become whole numbers x = floor(scale * c); each distinct x-vector is one row of the fit list.
2. The fit list gives n and the sums S, then the covariance: rows are centred on the whole numbers m nearest to S / n, their
   products summed as integers, and what m is off is taken out at the end, also in integers. So the covariance is exact
   whatever the order of the rows, and only d x d numbers reach the driver.
3. Its eigenvectors are found in float32 and corrected by Ogita-Aishima steps (matrix products in extended precision),
   which double the right digits each time. A step can't tell eigenvalues apart that are nearer to each other than its own
   error; such a cluster is solved as a small problem of its own, shifted by its mean and scaled to its width, after which
   the steps go on.
4. Rows are projected on the leading components over the square root of the eigenvalues. The covariance of that, over the
   fit list again, says how far it is from the identity.

Three scans of the fit list, which is written once; the one shuffle of vectors finds the distinct ones. Each task sends one
row per dimension to the sum of the products, and a task of that sum reads them as they come.

Defined cases: rows whose vector is null or empty, or holds null or non-finite entries, or one beyond LARGEST in size as x,
are dropped; so are those of another length than the most frequent one (ties: the shorter) of the fit list; components
without variance (one vector, constant or dependent entries) have null whitened numbers; equal eigenvalues have any
orthonormal basis; a null id stays null; repeated rows are whitened each; an empty table stays empty, with its columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixeltide.llm.common import Saved, importable

SCALE, COMPONENTS = 256, 4
MAX_DIM = 4096  # the driver holds a matrix of this size squared
LARGEST = 1 << 52
LIMB = 31  # sums of products are kept as three numbers of so many bits
ROWS = 1024  # of a product of matrices
STEPS, RANK = 12, 1e-13


def quantised(column: str, scale: int = SCALE) -> Column:
    """The vector as whole numbers; null for vectors that are dropped."""
    x = F.transform(column, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")) + F.lit(0).cast("long"))
    bad = F.exists(column, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) > LARGEST / scale))
    return F.when((F.size(column) > 0) & ~bad, x)


@dataclass
class Model:
    """sums: of each dimension over the fit list of n vectors. vectors: a component in each column; values: their variances."""

    scale: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    @property
    def dim(self) -> int:
        return len(self.sums)

    def spread(self, k: int) -> np.ndarray:
        """Standard deviations of the first k components, NaN where there is no variance."""
        v = self.values[:k]
        return np.sqrt(np.where(v > RANK * max(self.values[0], 0), v, np.nan)) if len(v) else v

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, rounded once."""
        whole = [s // self.n for s in self.sums]
        rest = np.array([float(Fraction(s - w * self.n, self.n)) for s, w in zip(self.sums, whole, strict=True)])
        return (x - np.array(whole, np.int64)) - rest

    def whiten(self, x: np.ndarray, k: int) -> np.ndarray:
        return self.centred(x) @ self.vectors[:, :k] / self.spread(k)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum of (n x - S)^2 of each row, exactly."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if most**2 * self.dim < 1 << 62:
            d = self.n * x - np.array(self.sums, np.int64)
            return np.einsum("ij,ij->i", d, d).tolist()
        sums = np.array(self.sums, object)
        return [int(((self.n * r.astype(object) - sums) ** 2).sum()) for r in x]


def limbs(x: np.ndarray) -> np.ndarray:
    """Whole numbers (int64 or Python's) as three int64 numbers each, lowest first, the last with the sign."""
    if x.dtype == object:
        mask = (1 << LIMB) - 1
        return np.array([[int(v) >> (LIMB * k) & mask if k < 2 else int(v) >> (LIMB * k) for v in x.ravel()] for k in range(3)], np.int64).reshape(3, *x.shape)
    mask = np.int64((1 << LIMB) - 1)
    return np.stack([x & mask, (x >> LIMB) & mask, x >> (2 * LIMB)])


def whole(parts: np.ndarray) -> np.ndarray:
    """The numbers of sums of limbs, as Python's."""
    return sum(p.astype(object) << (LIMB * k) for k, p in enumerate(parts))


def products(y: np.ndarray) -> np.ndarray:
    """y'y of whole numbers as limbs, exactly."""
    most = int(np.abs(y).max(initial=0))
    if most**2 * len(y) < 1 << 53:
        f = y.astype(np.float64)
        return limbs((f.T @ f).astype(np.int64))
    if most**2 * len(y) < 1 << 62:
        return limbs(y.T @ y)
    big = y.astype(object)
    return limbs(big.T @ big)


def _matrix(lists) -> np.ndarray:
    return np.stack([np.asarray(v, np.int64) for v in lists]) if len(lists) else np.zeros((0, 0), np.int64)


def _summed(rows: DataFrame, schema: str) -> dict[int, np.ndarray]:
    """Limbs by place: rows(place, l0, l1, l2), one for each task and place, summed where each place is dealt to."""

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for place, *parts in zip(b.place, b.l0, b.l1, b.l2, strict=True):
                x = np.stack([np.asarray(p, np.int64) for p in parts])
                held[place] = held[place] + x if place in held else x
        yield pd.DataFrame([(p, *x) for p, x in held.items()], columns=["place", "l0", "l1", "l2"])

    summed = rows.repartition("place").mapInPandas(add, schema)
    return {r.place: np.array([r.l0, r.l1, r.l2], np.int64) for r in summed.toLocalIterator()}


SUMS = "place int, l0 array<long>, l1 array<long>, l2 array<long>"


def _sums(fit: DataFrame) -> list[int]:
    def run(batches):
        total = None
        for b in batches:
            if len(b):
                s = limbs(_matrix(b.x)).sum(1)
                total = s if total is None else total + s
        if total is not None:
            yield pd.DataFrame({"place": [0], "l0": [total[0]], "l1": [total[1]], "l2": [total[2]]})

    return whole(_summed(fit.mapInPandas(run, SUMS), SUMS)[0]).tolist()


def _scatter(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """n^2 times the covariance, as Python's whole numbers."""
    near = [(2 * s + n) // (2 * n) for s in sums]  # whole numbers nearest to the means
    centre = np.array(near, np.int64)

    def run(batches):
        total = None
        for b in batches:
            for at in range(0, len(b), ROWS):
                p = products(_matrix(b.x.iloc[at : at + ROWS]) - centre)
                total = p if total is None else total + p
        if total is not None:
            yield pd.DataFrame({"place": np.arange(total.shape[1]), "l0": list(total[0]), "l1": list(total[1]), "l2": list(total[2])})

    got = _summed(fit.mapInPandas(run, SUMS), SUMS)
    squares = whole(np.stack([got[i] for i in range(len(sums))], 1))
    off = np.array([s - n * m for s, m in zip(sums, near, strict=True)], object)
    return n * squares - np.outer(off, off)


def clusters(values: np.ndarray, near: float) -> list[slice]:
    """Runs of two or more rising eigenvalues that are each nearer than `near` to the next."""
    cuts = [0, *(np.flatnonzero(np.diff(values) > near) + 1), len(values)]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 1]


def correction(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One Ogita-Aishima step: the eigenvalues, the corrected vectors, and below which gap it can't tell values apart."""
    r = np.eye(len(a), dtype=a.dtype) - x.T @ x
    s = x.T @ (a @ x)
    s = (s + s.T) / 2
    values = np.diag(s) / (1 - np.diag(r))
    size = np.abs(values).max()
    near = 2 * (np.linalg.norm((s - np.diag(values)).astype(float)) + float(size) * np.linalg.norm(r.astype(float)))
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > near
    e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
    return values, x + x @ e, near


def orthogonal(x: np.ndarray) -> np.ndarray:
    """Nearly orthonormal columns made so: one Newton step."""
    return x @ (1.5 * np.eye(x.shape[1], dtype=x.dtype) - 0.5 * (x.T @ x))


def eigen(a: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix in extended precision."""
    a = np.asarray(a, np.longdouble)
    size = np.abs(a).max(initial=0)
    if not len(a) or size == 0:
        return np.zeros(len(a)), np.eye(len(a))
    a = a / size
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    solved, last = 0, np.inf
    for _ in range(steps):
        values, x, near = correction(a, x)
        order = np.argsort(values, kind="stable")
        values, x = values[order], x[:, order]
        if near >= last / 2 or near < 1e-18:
            groups = clusters(values, max(near, 1e-18 * len(a)))
            if near < 1e-12 and not groups or solved > 3:
                break
            for k in groups:  # what the steps left mixed: solved about its mean, at its own scale
                part = x[:, k]
                q = orthogonal(np.linalg.qr(part.astype(float))[0].astype(np.longdouble))
                mean = values[k].mean()
                small = q.T @ (a @ q - mean * q)
                wide = np.abs(small).max()
                if wide > 0:
                    x[:, k] = q @ np.linalg.eigh(((small + small.T) / (2 * wide)).astype(float))[1]
            solved += 1
            last = np.inf
        else:
            last = near
    values, x, _ = correction(a, x)
    order = np.argsort(-values, kind="stable")
    x = orthogonal(x[:, order])
    x = x / np.sqrt((x * x).sum(0))
    return (values[order] * size).astype(float), x.astype(float)


def _identity_error(fit: DataFrame, model: Model, k: int) -> float | None:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    ok = np.flatnonzero(~np.isnan(model.spread(k)))
    if not len(ok):
        return None

    def run(batches):
        total = np.zeros((len(ok) + 1, len(ok)))
        for b in batches:
            for at in range(0, len(b), ROWS):
                w = model.whiten(_matrix(b.x.iloc[at : at + ROWS]), k)[:, ok]
                total[:-1] += w.T @ w
                total[-1] += w.sum(0)
        yield pd.DataFrame({"i": np.repeat(np.arange(len(ok) + 1), len(ok)), "j": np.tile(np.arange(len(ok)), len(ok) + 1), "v": total.ravel()})

    cells = fit.mapInPandas(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    got = np.zeros((len(ok) + 1, len(ok)))
    for c in cells:
        got[c.i, c.j] = c.v / model.n
    return float(np.abs(got[:-1] - np.outer(got[-1], got[-1]) - np.eye(len(ok))).max())


def fit(vectors: DataFrame, column: str = "embedding", scale: int = SCALE, components: int = COMPONENTS) -> Model | None:
    """The model of vectors(column); None where no vector is left. components: how many the identity error looks at."""
    importable(vectors.sparkSession)
    x = vectors.select(quantised(column, scale).alias("x")).where("x is not null")
    saved = Saved(x.distinct())
    most = saved.df.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if most is None:
        saved.drop()
        return None
    if most.dim > MAX_DIM:
        raise ValueError(f"vectors of {most.dim} entries; at most {MAX_DIM} can be whitened")
    rows, n = saved.df.where(F.size("x") == most.dim), most.n
    sums = _sums(rows)
    scatter = _scatter(rows, n, sums)
    largest = int(np.abs(scatter).max())
    # as longdouble to its full width: the leading part and what a double leaves of it
    high = (scatter / (largest or 1)).astype(float) if largest < 1 << 53 else np.array([[float(Fraction(int(v), largest)) for v in r] for r in scatter])
    low = np.array([[float(Fraction(int(v), largest or 1) - Fraction(h)) for v, h in zip(r, hs, strict=True)] for r, hs in zip(scatter, high.tolist(), strict=True)])
    values, basis = eigen(high.astype(np.longdouble) + low)
    unit = float(Fraction(largest, n * n))
    trace = float(Fraction(sum(int(v) for v in np.diag(scatter)), largest or 1))
    model = Model(scale, n, sums, np.maximum(values, 0) * unit, basis, np.maximum(values, 0) / trace if trace else np.full(len(values), np.nan))
    model.identity_error = _identity_error(rows, model, components)
    saved.drop()
    return model


def apply(vectors: DataFrame, model: Model | None, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """The rows of vectors that aren't dropped, all columns, with whitened array<double> (the first components) and deviation decimal(38,0)."""
    names = [c for c in vectors.columns if c not in ("whitened", "deviation")]
    rows = vectors.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), quantised(column, model.scale if model else SCALE).alias("x"))
    rows = rows.where(F.size("x") == model.dim if model else F.lit(False))
    k = min(components, model.dim) if model else 0

    @F.pandas_udf("w array<double>, d string")
    def project(x: pd.Series) -> pd.DataFrame:
        if not len(x):
            return pd.DataFrame({"w": [], "d": []})
        m = _matrix(x)
        return pd.DataFrame({"w": list(model.whiten(m, k)), "d": list(map(str, model.deviations(m)))})

    done = rows.withColumn("_p", project("x")) if model else rows.withColumn("_p", F.lit(None).cast("struct<w: array<double>, d: string>"))
    whitened = F.transform("_p.w", lambda v: F.nanvl(v, F.lit(None)))
    return done.select(*[F.col(f"row.`{c}`").alias(c) for c in names], whitened.alias("whitened"), F.col("_p.d").cast("decimal(38,0)").alias("deviation"))


def components(vectors: DataFrame, model: Model | None, key: str, column: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: key, component from 1, n, deviation, whitened, explained, identity_error."""
    done = apply(vectors, model, column, count)
    share = F.array(*[F.nanvl(F.lit(float(v)), F.lit(None)) for v in model.explained[:count]]) if model else F.array().cast("array<double>")
    rows = done.select(key, "deviation", F.posexplode("whitened").alias("_k", "whitened"))
    return rows.select(
        key,
        (F.col("_k") + 1).alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        F.col("deviation").cast("long").alias("deviation"),
        "whitened",
        F.get(share, "_k").alias("explained"),
        F.lit(model.identity_error if model else None).cast("double").alias("identity_error"),
    )
