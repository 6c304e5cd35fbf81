"""Near-duplicate vectors by E8 lattice hashing.

Unit vectors are projected at random to blocks of 8 numbers, scaled so that the lattice is as fine for vectors of any
length; each block is decoded to the nearest point of the E8 lattice, and a table's cell is the tuple of its blocks' points.
Each table has its own projection. A vector is stored in its own cell and also looks into PROBES neighbouring cells: those
of the lattice points next nearest to it. All vectors that meet in a cell are compared by cosine in double precision, in
blocks.

More vectors need finer cells, so blocks and tables follow from their number (`setting`): a block more makes cells hold about
a fifteenth as many, so that a vector meets some hundred unlike ones at most, whatever the table's size; and there are
as many tables as leave MISS of the pairs with a cosine of 0.95 unfound (measured: MET of them meet in a table of two blocks,
and NEXT of these with each block more, for vectors of 2 to 768 numbers). Nearer pairs are missed far more rarely.

A pair can meet in several cells; it counts only in the first one, which both rows tell from their lists of cells. So
links are counted per vector where they are found and only a spanning forest of each block's links leaves it: what is
emitted grows with the vectors, not with the pairs. A cell of more than BLOCK rows is dealt out as pairs of chunks, so no
task holds a whole large cell. Equal vectors are one class with a multiplicity.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite numbers, link with nothing and are their
own component; vectors of different lengths are never compared (recall was measured for lengths from 2 on); rows without vec_id aren't compared and have no
component; rows that repeat a vec_id and vector are one; other columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixeltide.llm.common import Saved, importable
from pixeltide.llm.graph import components

PROBES, SCALE = 1, 1.13  # SCALE: a lattice step, by the length that projected unit vectors have
MISS, MET, NEXT = 0.0005, 0.66, 0.67
BLOCK, LOT = 2048, 4096
ID = "vec_id"


def setting(n: int) -> tuple[int, int]:
    """Blocks of a cell, and tables, for n vectors."""
    blocks = 2 + max(0, math.ceil(math.log(n / 5000) / math.log(15))) if n else 2
    return blocks, math.ceil(math.log(MISS) / math.log(1 - MET * NEXT ** (blocks - 2)))


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest point with whole coordinates of even sum."""
    r = np.rint(x)
    odd = (r.sum(-1).astype(np.int64) & 1).astype(bool)
    d = x - r
    far = np.abs(d).argmax(-1)
    at = np.flatnonzero(odd)
    r[at, far[at]] += np.where(d[at, far[at]] >= 0, 1, -1)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 = D8 and D8 + 1/2, for rows of 8."""
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(-1) <= ((x - b) ** 2).sum(-1))[:, None], a, b)


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: the way to neighbouring cells."""
    out = []
    for i in range(8):
        for j in range(i):
            for s in (1, -1):
                for t in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = s, t
                    out.append(v)
    for bits in range(256):
        v = np.array([0.5 if bits >> i & 1 else -0.5 for i in range(8)])
        if int((v < 0).sum()) % 2 == 0:
            out.append(v)
    return np.array(out)


def cells(unit: np.ndarray, tables: int, blocks: int, probes: int = PROBES, scale: float = SCALE) -> np.ndarray:
    """Cell hashes of unit vectors: n x tables x (1 + probes); the first of each table is the vector's own."""
    n, dim = unit.shape
    scale = scale * math.sqrt(8 / max(dim, 8))
    rng = np.random.default_rng(8)
    steps = roots()
    out = np.empty((n, tables, 1 + probes), np.int64)
    for t in range(tables):
        points = np.empty((n, blocks, 8))
        gains = []
        for b in range(blocks):
            basis = np.linalg.qr(rng.standard_normal((dim, 8)))[0].T if dim >= 8 else rng.standard_normal((8, dim)) / np.sqrt(8)
            x = unit @ basis.T / scale + rng.uniform(0, 2, 8)
            p = nearest_e8(x)
            points[:, b] = p
            # how much nearer the own point is than each neighbour: |x-p-v|^2 - |x-p|^2 = 2 - 2 v.(x-p)
            gains.append(2 - 2 * (x - p) @ steps.T)
        gain = np.concatenate(gains, 1)
        pick = np.argsort(gain, 1, kind="stable")[:, :probes]
        for k in range(1 + probes):
            q = points
            if k:
                q = points.copy()
                b, v = pick[:, k - 1] // len(steps), pick[:, k - 1] % len(steps)
                q[np.arange(n), b] += steps[v]
            half = np.rint(q.reshape(n, -1) * 2).astype(np.int16)
            raw = half.tobytes()
            width = half.shape[1] * 2
            out[:, t, k] = [xxhash.xxh3_64_intdigest(raw[i * width : (i + 1) * width], seed=t * 1000 + dim) - (1 << 63) for i in range(n)]
    return out


def unit_rows(vectors) -> tuple[np.ndarray, np.ndarray]:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    big = np.abs(x).max(1, keepdims=True)
    x = x / np.where(big > 0, big, 1)
    return x / np.linalg.norm(x, axis=1, keepdims=True), x


def plain(column: str, kind):
    """The vector with -0.0 as 0.0."""
    return F.transform(column, lambda x: x + F.lit(0).cast(kind.elementType))


def classes(vectors: DataFrame, column: str) -> DataFrame:
    """class (its smallest id), copies, v: equal vectors together; only those that can link."""
    ok = vectors.where(F.col(ID).isNotNull() & (F.size(column) > 0)).select(F.col(ID).cast("long").alias("id"), F.col(column).alias("v"))
    ok = ok.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    ok = ok.select("id", plain("v", vectors.schema[column].dataType).alias("v"))
    return ok.groupBy("v").agg(F.min("id").alias("class"), F.countDistinct("id").alias("copies"))


def first_meeting(cells_: np.ndarray, homes: np.ndarray, r: np.ndarray, q: np.ndarray, cell: int) -> np.ndarray:
    """For rows r and q that meet in a cell: whether no earlier cell has both and is one's own."""
    out = np.ones(len(r), bool)
    for k in range(cells_.shape[1]):
        mine = cells_[r, k]
        same = (cells_[q] == mine[:, None]) & (mine < cell)[:, None]
        out &= ~(same & (homes[r, k][:, None] | homes[q])).any(1)
    return out


def star(label: np.ndarray, r: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Gives the rows that the links r, q connect the least label among them; returns the rows."""
    while True:
        a, b = label[r], label[q]
        if (a == b).all():
            return np.unique(np.concatenate([r, q]))
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def linked(vectors: DataFrame, column: str = "embedding", least: float = 0.95, tables: int | None = None, probes: int = PROBES, scale: float = SCALE, blocks: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors(vec_id, column). tables, blocks: by `setting` if not given."""
    importable(vectors.sparkSession)
    own = Saved(classes(vectors, column)).df
    n = own.count()
    usual = setting(n)
    blocks, tables = blocks or usual[0], tables or usual[1]

    def place(batches):
        for b in batches:
            for dim, part in b.groupby(b.v.map(len)):
                unit, _ = unit_rows(part.v)
                where = cells(unit, tables, blocks, probes, scale)
                flat = where.reshape(len(part), -1)
                k = flat.shape[1]
                home = np.tile(np.arange(k) % (1 + probes) == 0, len(part))
                yield pd.DataFrame({"cell": flat.ravel(), "class": np.repeat(part["class"].values, k), "home": home})

    written = Saved(own.select("class", "v").mapInPandas(place, "cell long, class long, home boolean").groupBy("cell", "class").agg(F.max("home").alias("home")))
    placed = written.df
    sizes = placed.groupBy("cell").agg(F.count("*").alias("rows"), F.max("home").alias("homes")).where("rows > 1 and homes")
    sizes = sizes.select("cell", F.ceil(F.col("rows") / BLOCK).cast("int").alias("chunks"))
    met = placed.join(sizes, "cell")
    # a large cell's rows are dealt to chunks, and each pair of chunks is a group; small cells share groups of about LOT rows
    chunk = F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int")
    met = met.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    lots = max(1, n * tables * (1 + probes) // LOT)
    lot = F.when(F.col("chunks") > 1, F.col("cell")).otherwise(F.pmod(F.xxhash64("cell"), F.lit(lots)))
    met = met.select("cell", "class", "home", "chunk", (F.col("chunks") > 1).alias("large"), lot.alias("lot"), F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"))
    mine = placed.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("cell", "home"))).alias("cells"))  # tables * (1 + probes) at most
    mine = mine.select("class", F.col("cells.cell").alias("cells"), F.col("cells.home").alias("homes"))
    full = met.join(own.join(mine, "class"), "class")
    width = tables * (1 + probes)

    def grid(lists, fill, kind):
        """Lists of at most `width` items as a table."""
        out = np.full((len(lists), width), fill, kind)
        lens = np.fromiter(map(len, lists), np.int64, len(lists))
        out[np.arange(width) < lens[:, None]] = np.concatenate(list(lists))
        return out

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        lo, hi = g.lo.iloc[0], g.hi.iloc[0]
        cell_of, ids, home, copies, part = g.cell.values, g["class"].values, g.home.values.astype(bool), g.copies.values, g.chunk.values
        vectors_, homes, all_cells = g.v.values, grid(g.homes.values, False, bool), grid(g.cells.values, np.iinfo(np.int64).max, np.int64)
        n_rows, forest = np.zeros(len(g), np.int64), []
        order = np.argsort(cell_of, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(cell_of[order])) + 1):
            if len(rows) < 2:
                continue
            cell = cell_of[rows[0]]
            a = rows if lo == hi else rows[part[rows] == lo]
            b = rows if lo == hi else rows[part[rows] == hi]
            if not len(a) or not len(b):
                continue
            ua = unit_rows(vectors_[a])[0]
            ub = ua if lo == hi else unit_rows(vectors_[b])[0]
            label = np.arange(len(g))
            linked_ = []
            for at in range(0, len(a), 512):
                i, j = np.nonzero((ua[at : at + 512] @ ub.T >= least - 1e-9) & (home[a[at : at + 512], None] | home[b][None, :]))
                i += at
                keep = ids[a[i]] < ids[b[j]] if lo == hi else np.ones(len(i), bool)
                i, j = i[keep], j[keep]
                for k in range(0, len(i), 1 << 15):
                    x, y = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
                    ok = np.einsum("ij,ij->i", ua[x], ub[y]) >= least
                    r, q = a[x[ok]], b[y[ok]]
                    ok = first_meeting(all_cells, homes, r, q, cell)
                    r, q = r[ok], q[ok]
                    n_rows += np.bincount(r, copies[q], len(g)).astype(np.int64) + np.bincount(q, copies[r], len(g)).astype(np.int64)
                    linked_.append(star(label, r, q))
            if linked_:
                ends = np.unique(np.concatenate(linked_))
                forest.append(np.stack([ends, label[ends]], 1)[label[ends] != ends])
        at = np.flatnonzero(n_rows)
        links = np.concatenate([np.zeros((0, 2), np.int64), *forest])
        n, m = len(at), len(links)

        def column(x, above, below):
            gaps = np.zeros(above, np.int64), np.zeros(below, np.int64)
            return pd.arrays.IntegerArray(np.concatenate([gaps[0], x, gaps[1]]), np.concatenate([gaps[0] == 0, np.zeros(len(x), bool), gaps[1] == 0]))

        return pd.DataFrame({"class": column(ids[at], 0, m), "n": column(n_rows[at], 0, m), "a": column(ids[links[:, 0]], n, 0), "b": column(ids[links[:, 1]], n, 0)})

    found = Saved(full.groupBy("large", "lot", "lo", "hi").applyInPandas(compare, "class long, n long, a long, b long")).df
    written.drop()
    n_links = found.where("class is not null").groupBy("class").agg(F.sum("n").alias("n"))
    comps = components(found.where("a is not null").select("a", "b"))
    per_class = own.join(n_links, "class", "left").join(comps.withColumnRenamed("node", "class"), "class", "left")
    per_class = per_class.select("v", "copies", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component_id", "class").alias("component_id"))
    rows = vectors.select(F.col(ID).cast("long").alias(ID), plain(column, vectors.schema[column].dataType).alias("v"))
    out = rows.join(per_class, "v", "left").withColumn("c", F.coalesce("component_id", ID))
    return out.select(ID, F.when(F.col(ID).isNotNull(), F.coalesce(F.col("n") + F.col("copies") - 1, F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.when(F.col(ID).isNotNull(), F.col("c")).alias("component_id"), F.coalesce(F.col("c") == F.col(ID), F.lit(False)).alias("kept"))
