"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is linear in a few dozen features of its whole text. Preference pairs put a document labelled 1
over one labelled 0; the weights minimise the logistic loss on the difference of the two feature vectors. The raw
threshold is a quantile of the scores of all labelled training rows: the share of them labelled 0. Scores are then
mapped by a logistic curve that puts this quantile at CUT, so `score >= CUT` is the quantile rule.

The weights are fitted on a bounded sample: MAX_TRAIN rows of each label, those with the lowest hashes of their id, and
PAIRS preference pairs per row. The threshold and the curve's scale come from a pass over all texts, whose raw scores are
joined with the labels. Scoring is another pass over all texts without a shuffle.

Defined cases: a null or empty text has features of zero length and is scored like any other; without labels of both
kinds every score is 0.5; a doc_id with several labels counts with the lowest; null labels and ids are not learned from;
repeated rows are scored each; other columns are left out.
"""

from __future__ import annotations

import operator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixeltide.llm.common import Saved, ids_in, ids_out, importable

CUT = 0.3
MAX_TRAIN, PAIRS = 8_000, 8
FINE = 1_000_000  # ranks are exact up to half as many rows, and within a millionth beyond

_LETTERS = bytes(c for c in range(256) if chr(c).isalpha() and c < 128 or c >= 128)
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_MARKS = b"!#$%&*|~^<>{}[]=+\\/@_"
NAMES = ["upper", "digit", "space", "line", *[f"mark_{m}" for m in map(chr, _MARKS)], "stop", "other", "word_len", "long_word", "distinct", "alone", "log_chars", "line_repeat", "tail_mark", "upper_word", "again"]


def features(text: bytes | None) -> np.ndarray:
    """Rates over the whole text. Rates that tell junk are given as x and sqrt(x), so that traces of it count too."""
    t = text or b""
    n = max(1, len(t))
    count = t.count
    letters = len(t) - len(t.translate(None, _LETTERS))
    upper = n and len(t) - len(t.translate(None, _UPPER))
    digits = len(t) - len(t.translate(None, _DIGITS))
    w = t.split()
    k = max(1, len(w))
    lines = t.split(b"\n")
    lens = [len(x) for x in w]
    ends = sum(1 for x in w if x[-1] in _MARKS)
    out = [upper / max(1, letters), digits / n, (count(b" ") + count(b"\n")) / n, len(lines) / k]
    out += [t.count(bytes([m])) / n for m in _MARKS]
    out += [(count(b".") + count(b",")) / k, (count(b";") + count(b":") + count(b"(") + count(b'"')) / n]
    out += [sum(lens) / k / 10, sum(1 for x in lens if x > 20) / k, len(set(w)) / k, sum(1 for x in lens if x == 1) / k]
    out += [np.log1p(len(t)) / 10, 1 - len(set(lines)) / len(lines), ends / k, sum(1 for x in w if x.isupper() and len(x) > 2) / k, sum(map(operator.eq, w, w[1:])) / k]
    a = np.array(out)
    return np.concatenate([a, np.sqrt(a)])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> dict:
    """Weights from rows x with labels y, by Newton's method on the pairwise loss."""
    if not len(x) or y.min() == y.max():
        return {}
    mean, std = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / std, -8, 8)
    good, bad = z[y == 1], z[y == 0]
    rng = np.random.default_rng(7)
    m = PAIRS * max(len(good), len(bad))
    d = good[rng.integers(0, len(good), m)] - bad[rng.integers(0, len(bad), m)]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        grad = d.T @ p / m - ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / m + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w + step
        if np.abs(step).max() < 1e-5:
            break
    return {"mean": mean, "std": std, "w": w}


def strength(x: np.ndarray, model: dict) -> np.ndarray:
    return np.clip((x - model["mean"]) / model["std"], -8, 8) @ model["w"]


def place(rows: DataFrame) -> dict:
    """The threshold and scale, from rows(quality, raw): the quantile of raw at the share of label 0, between two rows as numpy does."""
    n, zeros = rows.agg(F.count("*"), F.count(F.when(F.col("quality") == 0, 1))).first()
    if not n:
        return {"cut": 0.0, "scale": 1 / 3}
    at = [min(1.0, max(0.0, (zeros + x) / n)) for x in (-0.5, 0.5)]
    below, above = rows.agg(F.percentile_approx("raw", at, FINE)).first()[0]
    cut = below + (above - below) * (1 - zeros / n)
    scale = rows.agg(F.percentile_approx(F.abs(F.col("raw") - cut), 0.5, FINE)).first()[0] or 1.0
    return {"cut": cut, "scale": scale / 3}


def score(x: np.ndarray, model: dict) -> np.ndarray:
    if not model:
        return np.full(len(x), 0.5)
    shift = np.log(CUT / (1 - CUT))
    return 1 / (1 + np.exp(-np.clip((strength(x, model) - model["cut"]) / model["scale"] + shift, -50, 50)))


def train(docs: DataFrame, labels: DataFrame, learn=None, max_train: int = MAX_TRAIN) -> dict:
    """The model, from docs(doc_id, text) and labels(doc_id, quality); learn: a condition on the labels' rows."""
    importable(docs.sparkSession)
    own = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    own = (own if learn is None else own.where(learn)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    n = {r.quality: r["count"] for r in own.groupBy("quality").count().collect()}
    if set(n) != {0, 1}:
        return {}
    # the lowest hashes; only those below a share of somewhat more rows than wanted are sorted
    picked = None
    for q in (0, 1):
        share = 1.1 * max(1000, max_train) / n[q]
        part = own.where(F.col("quality") == q)
        part = part.where(F.xxhash64("doc_id") < int(share * 2**64) - 2**63) if share < 1 else part
        part = part.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select(F.col("doc_id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(picked), "doc_id")  # at most 2 * max_train rows

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"quality": b.quality, "x": [features(t) for t in b.text]})

    rows = texts.mapInPandas(run, "quality int, x array<double>").toPandas()
    model = fit(np.stack(rows.x.values), rows.quality.values) if len(rows) else {}
    if not model:
        return {}

    def weigh(batches):
        for b in batches:
            x = np.stack([features(t) for t in b.text]) if len(b) else np.zeros((0, 2 * len(NAMES)))
            yield pd.DataFrame({"doc_id": b.doc_id.array, "raw": strength(x, model)})

    all_texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    raw = Saved(all_texts.mapInPandas(weigh, "doc_id long, raw double").join(own, "doc_id").select("quality", "raw"))
    model |= place(raw.df)
    raw.drop()
    return model


def rank(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score double for each row of docs(doc_id, text)."""
    importable(docs.sparkSession)

    def run(batches):
        for b in batches:
            x = np.stack([features(t) for t in b.text]) if len(b) else np.zeros((0, 2 * len(NAMES)))
            yield pd.DataFrame({"doc_id": b.doc_id.array, "score": score(x, model)})

    return ids_out(docs.select(ids_in(), F.col("text").cast("binary").alias("text")).mapInPandas(run, "doc_id long, score double"))


def keep(docs: DataFrame, model: dict, cut: float = CUT) -> DataFrame:
    """The rows of docs whose score is cut or more, all columns."""
    importable(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = b.column("text").cast("binary").to_pylist()
            x = np.stack([features(t) for t in texts]) if texts else np.zeros((0, 2 * len(NAMES)))
            yield b.filter(pa.array(score(x, model) >= cut))

    return docs.mapInArrow(run, docs.schema)
