"""A deleted-interpolation bigram language model, counted and scored with Spark.

Tokens are words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, and one end per text, which is also what the first word
follows. With c the counts over all training documents, N the tokens and V the distinct words,

    P(w | v) = a c(v, w) / c(v) + b c(w) / N + (1 - a - b) / (V + 1),

where the last part is shared by all words and one for the unknown, so P sums to one. The weights a, b are those of the
context's bucket (c(v) by powers of two), learned by expectation-maximisation on held-out counts: the training documents
are split in two halves, each in turn counted and held out, and the weights averaged. All words and all pairs of words
that follow each other are counted, however rare; what is gathered grows with the corpus.

1. Words are counted and written as a table. Workers look up the LOOKED_UP most frequent; the others, the tail, are known
   by 63 bits of their hash.
2. One pass over the texts deals each document's pairs to buckets of about PER_BUCKET tokens: a pair of looked-up words by
   its hash, a pair with a word of the tail by that word. So a bucket holds all that is needed to count its pairs, and
   the words of the tail; it keeps the counts of each pair beside the documents that hold it. Pairs of two tail words,
   about a hundredth, get the second word's count by a join with the table of words.
3. Pairs of the HEAD most frequent words stay with their documents and are counted in a square table. So a pair that goes
   to a bucket is no more than one in HEAD tokens.
4. Buckets also sum the held-out counts by context bucket and by both estimates in steps of an eighth of an octave, which
   bounds what the maximisation reads: the driver sees these cells, the square table and the looked-up words.
5. A bucket's pairs are scored where they are counted; sums by document go back to the documents.

A document is known by its task and place there, so rows have to come in a fixed order, as those of files do.

Defined cases: a null or empty text has its end token only; without training documents all counts are 0 and P is
uniform; a null `learn` is no training document; repeated rows are counted and scored each; an empty table stays empty;
other columns are left out.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixeltide.llm.common import Saved, ids_in, ids_out, importable, mix, words

HEAD, LOOKED_UP, BUCKETS = 1024, 200_000, 24
PER_BUCKET = 1_000_000
LOT, LOT_CHARS = 1_500, 2_000_000  # documents that travel together, and characters about
ROW, WORD = 12, 18  # bits of a document's place in its lot, and of a looked-up word
END = b""


def counts_of(docs: DataFrame) -> DataFrame:
    """word binary, n long, two long (of n, those of half 1) over docs(text, half); the end token is the empty word.

    Documents of half -1 aren't learned from: their tokens are counted under the null word.
    """
    importable(docs.sparkSession)

    def run(batches):
        for b in batches:
            n = Counter(), Counter()
            other = 0
            for t, h in zip(b.text, b.half, strict=True):
                w = words(t)
                if h < 0:
                    other += len(w) + 1
                    continue
                n[h].update(w)
                n[h][END] += 1
            both = n[0] + n[1]
            yield pd.DataFrame({"word": [*both, None], "n": [*both.values(), other], "two": [*[n[1][w] for w in both], 0]})

    return docs.select("text", "half").mapInPandas(run, "word binary, n long, two long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("two").alias("two"))


def threshold(counts: DataFrame, most: int) -> int:
    """The least count that at most `most` words reach. Counts over 1000 are told in steps of a hundredth."""
    step = F.when(F.col("n") <= 1000, F.col("n")).otherwise(1000 + F.floor(F.log(F.col("n") / 1000) * 100)).cast("long")
    rows = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect()  # a few thousand at most
    total, out = 0, 1 << 62
    for r in sorted(rows, key=lambda r: -r.step):
        total += r.words
        if total > most:
            break
        out = r.least
    return out


class Classes:
    """The looked-up words, the most frequent first; the first `heads` have a square table of pairs. Words are kept as one run of bytes."""

    def __init__(self, top: pa.Table, head_least: int):
        top = top.sort_by([("n", "descending"), ("word", "ascending")]).combine_chunks()
        lens = pc.binary_length(top["word"]).to_numpy().astype(np.int64)
        self.blob, self.ends = b"".join(x for chunk in top["word"].chunks for x in _pieces(chunk)), np.cumsum(lens)
        self.n, self.two = top["n"].to_numpy().astype(np.int64), top["two"].to_numpy().astype(np.int64)
        self.heads = int((self.n >= head_least).sum())

    def index(self) -> dict[bytes, int]:
        ends = self.ends.tolist()
        return {self.blob[a:b]: i for i, (a, b) in enumerate(zip([0, *ends], ends, strict=False))}


def _pieces(words: pa.Array):
    """The bytes of a binary column, in a few large pieces."""
    for at in range(0, len(words), 50_000):
        yield b"".join(words.slice(at, 50_000).to_pylist())


def keys(get, w: list[bytes]) -> np.ndarray:
    """A number for each word: its place among the looked-up words, or a negative hash."""
    out = np.fromiter(map(get, w, repeat(-1)), np.int64, len(w))
    far = np.flatnonzero(out < 0)
    if len(far):
        out[far] = np.fromiter((xxhash.xxh64_intdigest(w[j], 42) | 1 << 63 for j in far.tolist()), np.uint64, len(far)).view(np.int64)
    return out


def hashed(word="word"):
    """The same hash as a column."""
    return F.xxhash64(word).bitwiseOR(F.lit(-(1 << 63)))


def buckets(n: np.ndarray) -> np.ndarray:
    return np.minimum(BUCKETS - 1, np.floor(np.log2(n + 1) + 1e-12).astype(int))


# --- arrays as bytes


def dump(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as bytes: all first bytes of an array's numbers, then all second ones, and so on, compressed."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def load(raw: bytes, *kinds) -> list[np.ndarray]:
    kinds = [np.dtype(k) for k in kinds]
    x = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    n, out, at = len(x) // sum(k.itemsize for k in kinds), [], 0
    for k in kinds:
        out.append(x[at : at + n * k.itemsize].reshape(k.itemsize, n).T.copy().view(k).ravel())
        at += n * k.itemsize
    return out


def load_all(raws, *kinds) -> tuple[list[np.ndarray], np.ndarray]:
    """The arrays of several runs one after the other, and the run each row is from."""
    parts = [load(r, *kinds) for r in raws]
    if not parts:
        return [np.zeros(0, k) for k in kinds], np.zeros(0, np.int64)
    return [np.concatenate(x) for x in zip(*parts, strict=True)], np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])


def runs(*sorted_: np.ndarray) -> np.ndarray:
    """Where each run of equal rows starts."""
    n = len(sorted_[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for x in sorted_:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


# --- documents to buckets

PAIR = ("<i8", "<u2", "<u4")  # pair, place in the lot and half, times
TAIL = ("<i8", "<i8", "<u2", "<u4")  # word of the tail, the other word, place and half, times
DOC = ("<i8", "<i8", "<i8", "<f8", "<i8")  # doc_id, tokens, known, base of the looked-up words, half
PACKED = "bucket long, lot long, pairs binary, seconds binary, firsts binary, docs binary"


def lots(batches):
    for b in batches:
        lens = np.cumsum(b.text.map(lambda t: len(t) if t else 0).to_numpy(np.int64)) if len(b) else []
        at = 0
        while at < len(b):
            n = max(1, min(LOT, int(np.searchsorted(lens[at : at + LOT], LOT_CHARS + (lens[at - 1] if at else 0), "right"))))
            yield b.iloc[at : at + n]
            at += n


def folded(order, at, *columns):
    """Rows in order with the times of equal ones (the last column) summed."""
    columns = [c[order] for c in columns]
    first = runs(*columns[:-1])
    return [*[c[first] for c in columns[:-1]], np.add.reduceat(columns[-1], first) if len(first) else columns[-1]]


def packed(docs: DataFrame, shared, n_buckets: int) -> DataFrame:
    """For each lot of docs(doc_id, text, half) one row with its documents and near pairs (bucket -1 - lot), and its other pairs by bucket."""

    def run(batches):
        c = shared.value
        get, base_of, heads = c.index().get, np.log10(c.n + 1.0), c.heads
        task, no = TaskContext.get().partitionId(), 0
        for b in lots(batches):
            lot = task << 20 | no
            no += 1
            flat: list[bytes] = []
            ends = []
            for t in b.text:
                flat += words(t)
                flat.append(END)
                ends.append(len(flat))
            ends = np.array(ends)
            starts = np.append(0, ends[:-1])
            w = keys(get, flat)
            v = np.append(w[:1], w[:-1])
            v[starts] = w[ends - 1]
            half = b.half.to_numpy(np.int64)
            local = np.repeat(np.arange(len(b)), ends - starts)
            place = (local << 2 | half[local] + 1).astype(np.int64)
            known, one = w >= 0, np.ones(len(w), np.int64)
            base = np.bincount(local[known], base_of[w[known]], len(b))
            seen = known & (v >= 0)
            near = seen & (v < heads) & (w < heads)
            pair = v << WORD | w
            x = pair[near] << ROW + 2 | place[near]
            x, times = np.unique(x, return_counts=True)
            docs_ = dump(b.doc_id.to_numpy("<i8"), (ends - starts).astype("<i8"), np.bincount(local[known], minlength=len(b)).astype("<i8"), base, half.astype("<i8"))
            rows = [(-1 - lot, lot, dump((x >> ROW + 2).astype("<i8"), (x & (1 << ROW + 2) - 1).astype("<u2"), times.astype("<u4")), None, None, docs_)]
            made: dict[int, list] = {}

            def deal(k, bucket, columns, kinds, made=made):
                order = np.argsort(bucket, kind="stable")
                bucket = bucket[order]
                columns = [x[order].astype(t) for x, t in zip(columns, kinds, strict=True)]
                first = runs(bucket)
                for i, j in zip(first.tolist(), [*first[1:].tolist(), len(bucket)], strict=False):
                    made.setdefault(int(bucket[i]), [None] * 3)[k] = dump(*[x[i:j] for x in columns])

            x, times = np.unique(pair[seen & ~near] << ROW + 2 | place[seen & ~near], return_counts=True)
            pair = x >> ROW + 2
            deal(0, (mix(pair.astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int64), [pair, x & (1 << ROW + 2) - 1, times], PAIR)
            for k, tail, other, here in ((1, w, v, ~known), (2, v, w, v < 0)):
                tail, other, spot = tail[here], other[here], place[here]
                got = folded(np.lexsort((spot, other, tail)), here, tail, other, spot, one[here])
                deal(k, (mix(got[0].astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int64), got, TAIL)
            rows += [(k, lot, *x, None) for k, x in made.items()]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in PACKED.split(", ")])

    return docs.select("doc_id", "text", "half").mapInPandas(run, PACKED)


# --- buckets

CELL = ["at", "i2", "i1", "n", "s2", "s1"]
COUNTED = "kind string, lot long, lots array<long>, held binary, docs binary, w long, v_n long, v_two long, one long, two long, rows array<long>, times array<long>, at int, i2 int, i1 int, n long, s2 double, s1 double"
HOLD = ("<i8", "<i8", "<i8", "<u4", "<u1")  # of a pair: c(v), c(w), c(v, w), documents, kind
HELD = ("<i8", "<u4")  # the documents that hold a pair: lot of the bucket and place, times
LOGS, BASE = 1, 2  # kinds of pairs: it has a probability here; its second word is of the tail


def cells(v_n, v_two, w_n, w_two, one, two, ones: int, twos: int) -> pd.DataFrame:
    """Held-out counts by context bucket and both estimates: n, and the estimates' sums s2, s1, of each cell."""
    out = []
    for d, v, w, own, held, total in ((0, v_n - v_two, w_n - w_two, one, two, ones), (1, v_two, w_two, two, one, twos)):
        at = np.flatnonzero(held > 0)
        v, w, own, held = v[at], w[at], own[at], held[at]
        p2, p1 = own / np.maximum(1, v), w / max(1, total)
        step = lambda p: np.floor(8 * np.log2(np.where(p > 0, p, 2.0**-200))).astype(np.int64)
        out.append(pd.DataFrame({"at": d * BUCKETS + buckets(v), "i2": step(p2), "i1": step(p1), "n": held, "s2": held * p2, "s1": held * p1}))
    return pd.concat(out).groupby(CELL[:3], as_index=False).sum()


def counted(rows: DataFrame, shared, ones: int, twos: int) -> DataFrame:
    """What becomes of each bucket: its pairs with counts and holders, held-out cells, and pairs of two tail words."""
    names = [x.split()[0] for x in COUNTED.split(", ")]
    zero = {x.split()[0]: np.float64 if x.endswith("double") else np.int64 for x in COUNTED.split(", ") if x.split()[1] in ("long", "int", "double")}

    def table(kind, size, **columns):
        """Rows of one kind; whole numbers stay whole, 64-bit hashes are no floats."""
        given = {k: np.asarray(x, zero[k]) if k in zero else x for k, x in columns.items()}
        return pd.DataFrame({k: given[k] if k in given else np.zeros(size, zero[k]) if k in zero else [None] * size for k in names} | {"kind": [kind] * size})

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        if g.bucket.iloc[0] < 0:
            return table("lot", len(g), lot=g.lot.values, held=list(g.pairs), docs=list(g.docs))
        c = shared.value
        lot = g.lot.values
        parts, cell, far = [], [], []

        def split(half, times):
            return np.where(half == 0, times, 0), np.where(half == 1, times, 0)

        def sums(first, x):
            return np.add.reduceat(x, first) if len(first) else np.zeros(0, np.int64)

        def add(kind, v, w, one, two, first, rows, times):
            """Pairs: (n, two) of both words, counts by half, where their holders start."""
            k = np.diff(np.append(first, len(rows)))
            parts.append(([v[0], w[0], one + two, k, np.full(len(k), kind)], [rows, times]))
            if kind & LOGS:
                cell.append(cells(*v, *w, one, two, ones, twos))

        at = [i for i, x in enumerate(g.pairs) if x is not None]
        (pair, place, times), run = load_all([g.pairs.iloc[i] for i in at], *PAIR)
        order = np.argsort(pair, kind="stable")
        pair, place, times, run = pair[order], place[order].astype(np.int64), times[order].astype(np.int64), np.array(at, np.int64)[run[order]]
        first = runs(pair)
        one, two = (sums(first, x) for x in split((place & 3) - 1, times))
        v, w = pair[first] >> WORD, pair[first] & (1 << WORD) - 1
        add(LOGS, (c.n[v], c.two[v]), (c.n[w], c.two[w]), one, two, first, run << ROW | place >> 2, times)

        for k, column in ((1, g.seconds), (2, g.firsts)):
            at = [i for i, x in enumerate(column) if x is not None]
            (tail, other, place, times), run = load_all([column.iloc[i] for i in at], *TAIL)
            known = other >= 0  # pairs with a looked-up word first
            order = np.lexsort((other, tail))
            tail, other, place, times, run = tail[order], other[order], place[order].astype(np.int64), times[order].astype(np.int64), np.array(at, np.int64)[run[order]]
            half = split((place & 3) - 1, times)
            word, first = runs(tail), runs(tail, other)
            own = np.searchsorted(word, first, "right") - 1
            one_, two_ = (sums(word, x)[own] for x in half)
            mine = one_ + two_, two_
            one, two = (sums(first, x) for x in half)
            known = other[first] >= 0
            size = np.diff(np.append(first, len(tail)))
            rows_ = run << ROW | place >> 2
            for ok, kind in ((True, LOGS | BASE if k == 1 else LOGS), (False, BASE)):
                here = np.flatnonzero(known == ok)
                if not len(here):
                    continue
                held = np.repeat(known == ok, size)
                begin = np.append(0, np.cumsum(size[here])[:-1])
                m = mine[0][here], mine[1][here]
                if ok:
                    o = c.n[other[first[here]]], c.two[other[first[here]]]
                    add(kind, *((o, m) if k == 1 else (m, o)), one[here], two[here], begin, rows_[held], times[held])
                elif k == 1:
                    add(kind, m, m, one[here], two[here], begin, rows_[held], times[held])
                else:  # both are of the tail
                    ids = lot[rows_[held] >> ROW] << ROW | rows_[held] & (1 << ROW) - 1
                    cut = begin[1:]
                    far.append(table("far", len(here), w=other[first[here]], v_n=m[0], v_two=m[1], one=one[here], two=two[here], rows=np.split(ids, cut), times=np.split(times[held], cut)))
        hold = dump(*[np.concatenate(x).astype(t) for x, t in zip(zip(*[p[0] for p in parts], strict=True), HOLD, strict=True)])
        held = dump(*[np.concatenate(x).astype(t) for x, t in zip(zip(*[p[1] for p in parts], strict=True), HELD, strict=True)])
        got = pd.concat(cell).groupby(CELL[:3], as_index=False).sum() if cell else pd.DataFrame(columns=CELL)
        return pd.concat([table("pairs", 1, lots=[lot], held=[held], docs=[hold]), *far, table("cell", len(got), **{k: got[k].values for k in CELL})])

    return rows.groupBy("bucket").applyInPandas(fold, COUNTED)


def near_counts(made: DataFrame, heads: int) -> np.ndarray:
    """Counts of all pairs of head words in both halves: 2 x heads x heads."""

    def run(batches):
        total = np.zeros(2 * heads * heads, np.int64)
        for b in batches:
            for raw in b.held:
                pair, place, times = load(raw, *PAIR)
                half = (place & 3).astype(np.int64) - 1
                ok = half >= 0
                code = (half * heads + (pair >> WORD)) * heads + (pair & (1 << WORD) - 1)
                total += np.bincount(code[ok], times[ok], len(total)).astype(np.int64)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"code": at, "n": total[at]})

    got = made.where("kind = 'lot'").select("held").mapInPandas(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # 2 * HEAD^2 rows at most
    out = np.zeros(2 * heads * heads, np.int64)
    out[got["code"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(2, heads, heads)


def weights(c: pd.DataFrame, flat: float, rounds: int = 200) -> np.ndarray:
    """Mixture weights (BUCKETS x 3: bigram, unigram, uniform) from cells, each half's pairs held out from the other's counts."""
    if not len(c):
        return np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))
    at, n = c["at"].to_numpy(np.int64), c["n"].to_numpy(float)
    p = np.stack([c["s2"] / n, c["s1"] / n, np.full(len(c), flat)], 1)
    out = np.full((2 * BUCKETS, 3), 1 / 3)
    for _ in range(rounds):
        share = out[at] * p
        share *= (n / share.sum(1))[:, None]
        new = np.stack([np.bincount(at, share[:, k], 2 * BUCKETS) for k in range(3)], 1) + 1e-6
        new /= new.sum(1, keepdims=True)
        moved, out = np.abs(new - out).max(), new
        if moved < 1e-5:
            break
    out = out.reshape(2, BUCKETS, 3).mean(0)
    out[0] = [0, *(out[0, 1:] / out[0, 1:].sum())]  # a context never seen has no estimate
    return out


class Model:
    """The counts of the looked-up words, N and V, the weights, and log10 P among the heads."""

    def __init__(self, classes: Classes, mix: np.ndarray, near: np.ndarray, n: int, v: int):
        self.classes, self.mix, self.n, self.v = classes, mix, n, v
        h = classes.heads
        c = np.broadcast_to(classes.n[:h, None], (h, h))
        self.log = self.pair(c, np.broadcast_to(classes.n[None, :h], (h, h)), near)
        self.base_floor = np.log10(n + v + 1)

    def pair(self, v_n, w_n, n) -> np.ndarray:
        """log10 P(w | v) from the counts of v, w and the pair."""
        m = self.mix[buckets(v_n)]
        return np.log10(m[..., 0] * n / np.maximum(1, v_n) + m[..., 1] * w_n / max(1, self.n) + m[..., 2] / (self.v + 1))


def score(docs: DataFrame, learn, half) -> tuple[DataFrame, Model]:
    """doc_id, n_tokens, n_known, base_score, score for each row of docs(doc_id, text), and the model.

    It learns from the rows where learn holds; half, a condition too, splits them for the weights.
    """
    spark = docs.sparkSession
    importable(spark)
    part = F.when(F.coalesce(learn, F.lit(False)), F.when(F.coalesce(half, F.lit(False)), 1).otherwise(0)).otherwise(-1)
    docs = docs.select(ids_in(), F.col("text").cast("binary").alias("text"), part.alias("half"))
    all_ = Saved(counts_of(docs))
    counts = all_.df.where("word is not null")
    looked, head = threshold(counts, LOOKED_UP), threshold(counts, HEAD)
    n, v, twos = (x or 0 for x in counts.agg(F.sum("n"), F.count("*"), F.sum("two")).first())
    others = all_.df.where("word is null").agg(F.sum("n")).first()[0] or 0
    classes = Classes(counts.where(F.col("n") >= looked).select("word", "n", "two").toArrow(), head)  # LOOKED_UP rows at most
    shared = spark.sparkContext.broadcast(classes)
    n_buckets = 1 + (n + others) // PER_BUCKET

    dealt = packed(docs, shared, n_buckets).repartition(4 * n_buckets, "bucket")  # so many that few buckets meet in one
    made = Saved(counted(dealt, shared, n - twos, twos))
    tail = counts.where(F.col("n") < looked).select(hashed().alias("w"), F.col("n").alias("w_n"), F.col("two").alias("w_two"))
    far = made.df.where("kind = 'far'").select("w", "v_n", "v_two", "one", "two", "rows", "times").join(tail, "w", "left").fillna(0, ["w_n", "w_two"])
    far_made = Saved(far)

    def far_cells(batches):
        for b in batches:
            yield cells(*[b[k].values for k in ("v_n", "v_two", "w_n", "w_two", "one", "two")], n - twos, twos)[CELL]

    some = far_made.df.select("v_n", "v_two", "w_n", "w_two", "one", "two").mapInPandas(far_cells, "at int, i2 int, i1 int, n long, s2 double, s1 double")
    some = some.unionByName(made.df.where("kind = 'cell'").select(*CELL)).groupBy(*CELL[:3]).agg(*[F.sum(k).alias(k) for k in CELL[3:]]).toPandas()  # bounded by the steps
    h = classes.heads
    near = near_counts(made.df, h)
    v_, w_ = (x.ravel() for x in np.meshgrid(np.arange(h), np.arange(h), indexing="ij"))
    own = cells(classes.n[v_], classes.two[v_], classes.n[w_], classes.two[w_], near[0].ravel(), near[1].ravel(), n - twos, twos)
    model = Model(classes, weights(pd.concat([some, own]), 1 / (v + 1)), near.sum(0), n, v)
    return _scored(spark, made, far_made, model), model


def _scored(spark, made: Saved, far: Saved, model: Model) -> DataFrame:
    slim = Model.__new__(Model)
    slim.__dict__ = {k: x for k, x in model.__dict__.items() if k not in ("classes", "log")}
    log, heads, floor = spark.sparkContext.broadcast(model.log), model.classes.heads, float(model.base_floor)
    logs_of, tails_of = ("<u2", "<f8"), ("<u2", "<i8", "<f8")

    def by_lot(batches):
        for b in batches:
            for lots_, held, hold in zip(b.lots, b.held, b.docs, strict=True):
                v_n, w_n, n, k, kind = load(hold, *HOLD)
                rows, times = (x.astype(np.int64) for x in load(held, *HELD))
                p = np.where(kind & LOGS, slim.pair(v_n, w_n, n), 0.0)
                place, back = np.unique(rows, return_inverse=True)
                logs = np.bincount(back, np.repeat(p, k) * times, len(place))
                of_tail = np.repeat((kind & BASE) > 0, k)
                known = np.bincount(back, np.repeat(w_n > 0, k) * times * of_tail, len(place)).astype(np.int64)
                base = np.bincount(back, np.repeat(np.log10(w_n + 1.0), k) * times * of_tail, len(place))
                first = runs(place >> ROW)
                local = place & (1 << ROW) - 1
                out = []
                for i, j in zip(first.tolist(), [*first[1:].tolist(), len(place)], strict=False):
                    x = i + np.flatnonzero(known[i:j])
                    out.append((int(lots_[place[i] >> ROW]), dump(local[i:j].astype("<u2"), logs[i:j]), dump(local[x].astype("<u2"), known[x], base[x])))
                yield pd.DataFrame(out, columns=["lot", "logs", "tails"]).assign(held=None, docs=None)

    def finish(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        top = g[g.docs.notna()].iloc[0]
        doc, tokens, known, base, _ = load(top.docs, *DOC)
        pair, place, times = load(top.held, *PAIR)
        total = np.bincount(place >> 2, log.value[pair >> WORD, pair & (1 << WORD) - 1] * times, len(doc)) if len(pair) else np.zeros(len(doc))
        for a, t in zip(g.logs, g.tails, strict=True):
            if a is not None:
                at, x = load(a, *logs_of)
                total[at] += x
                at, k, x = load(t, *tails_of)
                known[at] += k
                base[at] += x
        row = key[0] << ROW | np.arange(len(doc))
        return pd.DataFrame({"row": row, "doc_id": doc, "n_tokens": tokens, "n_known": known, "base_score": base - tokens * floor, "score": total})

    df = made.df
    sums = df.where("kind = 'pairs'").select("lots", "held", "docs").mapInPandas(by_lot, "lot long, logs binary, tails binary, held binary, docs binary")
    tops = df.where("kind = 'lot'").select("lot", F.lit(None).cast("binary").alias("logs"), F.lit(None).cast("binary").alias("tails"), "held", "docs")
    rows = sums.unionByName(tops).groupBy("lot").applyInPandas(finish, "row long, doc_id long, n_tokens long, n_known long, base_score double, score double")
    m = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in model.mix])
    w = F.element_at(m, F.least(F.lit(BUCKETS), 1 + F.floor(F.log2(F.col("v_n") + F.lit(1)) + 1e-12)).cast("int"))
    p = w[0] * (F.col("one") + F.col("two")) / F.greatest("v_n", F.lit(1)) + w[1] * F.col("w_n") / F.lit(max(1, model.n)) + w[2] / F.lit(model.v + 1)
    more = far.df.select(F.log10(p).alias("p"), F.explode(F.arrays_zip("rows", "times")).alias("x")).groupBy(F.col("x.rows").alias("row")).agg(F.sum(F.col("p") * F.col("x.times")).alias("more"))
    out = rows.join(more, "row", "left").fillna(0, ["more"])
    return ids_out(out.select("doc_id", "n_tokens", "n_known", "base_score", (F.col("score") + F.col("more")).alias("score")))
