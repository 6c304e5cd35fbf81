"""CLEAR-MOT and identity scores of tracks against ground truth."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixeltide.functions.assign import sparse
from pixeltide.operators.detect import BOX
from pixeltide.operators.params import dealt
from pixeltide.operators.rounds import checkpoint, joined
from pixeltide.operators.track import iou_pairs

LIMIT = 0.5
_NONE = object()
WHOLE = 1_000_000  # pairs of a sequence that isn't cut in parts


def pairs_of(truth: DataFrame, tracks: DataFrame, limit: float = LIMIT) -> DataFrame:
    """seq, part, frame_no, t_id, p_id, dist: the pairs that may be made of truth(seq, frame_no, id, box) and tracks(seq, frame_no, id, box).

    Truths and tracks that no chain of pairs joins have no influence on each other. So a sequence of more than WHOLE pairs
    is cut in the parts that its pairs join; smaller ones are one part, null.
    """
    pairs = iou_pairs(truth.withColumnRenamed("id", "a_id"), tracks.withColumnRenamed("id", "b_id"), ["seq", "frame_no"], 0.0, only_overlapping=limit < 1)
    pairs = checkpoint(pairs.select("seq", "frame_no", F.col("a_id").alias("t_id"), F.col("b_id").alias("p_id"), (1 - F.col("iou")).alias("dist")).where(F.col("dist") <= limit))
    large = pairs.groupBy("seq").count().where(F.col("count") > WHOLE).select("seq")
    if large.isEmpty():
        return pairs.withColumn("part", F.lit(None).cast("string"))
    node = lambda c: F.concat(F.lit(c), F.col(c).cast("string"))
    links = pairs.join(large, "seq", "left_semi").select("seq", node("t_id").alias("a"), node("p_id").alias("b"))
    parts = joined(links, "seq").select("seq", F.col("node").alias("_node"), F.col("root").alias("part"))
    return pairs.withColumn("_node", node("t_id")).join(parts, ["seq", "_node"], "left").drop("_node")


def matches_of(pairs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """`matches` of the pairs of `pairs_of`. A part, whose frames depend on each other, comes in sorted batches, of which one
    frame and the pairs made last are kept."""
    schema = pairs.select("seq", "frame_no", "t_id", "p_id", "dist").schema

    def step(cost: dict, before: dict) -> dict:
        now = {a: b for a, b in cost if before.get(a, _NONE) == b}
        used = set(now.values())
        left = [(a, b) for a, b in cost if a not in now and b not in used]
        if left:
            rows, columns = sorted({a for a, _ in left}), sorted({b for _, b in left})
            row, column = ({x: i for i, x in enumerate(xs)} for xs in (rows, columns))
            made = sparse([row[a] for a, _ in left], [column[b] for _, b in left], [cost[k] for k in left], limit)
            now |= {rows[i]: columns[j] for i, j, _ in made}
        before |= now
        return now

    def run(batches):
        key, frame, cost, before = None, None, {}, {}
        for b in batches:
            out = []
            for seq, part, n, t, p, d in zip(b.seq, b.part, b.frame_no, b.t_id, b.p_id, b.dist, strict=True):
                if ((seq, part), n) != (key, frame):
                    out += [(key[0], frame, x, y, cost[x, y]) for x, y in step(cost, before).items()] if key else []
                    if (seq, part) != key:
                        key, before = (seq, part), {}
                    frame, cost = n, {}
                cost[t, p] = d
            yield pd.DataFrame(out, columns=schema.names)
        yield pd.DataFrame([(key[0], frame, x, y, cost[x, y]) for x, y in step(cost, before).items()] if key else [], columns=schema.names)

    return dealt(pairs, "seq", "part").sortWithinPartitions("seq", "part", "frame_no", "t_id", "p_id").mapInPandas(run, schema)


def matches(truth: DataFrame, tracks: DataFrame, limit: float = LIMIT) -> DataFrame:
    """seq, frame_no, t_id, p_id, dist: frame by frame, a pair of the frame before goes on if it may; the rest optimally."""
    return matches_of(pairs_of(truth, tracks, limit), limit)


def identity_overlap(pairs: DataFrame) -> DataFrame:
    """seq, idtp: frames that agree under the best one-to-one naming of truths and tracks of each sequence, from `pairs_of`."""
    counts = pairs.groupBy("seq", "part", "t_id", "p_id").agg(F.count("*").alias("n"))

    def run(batches):
        key, rows = None, []
        for b in batches:
            out = []
            for seq, part, *row in zip(b.seq, b.part, b.t_id, b.p_id, b.n, strict=True):
                if (seq, part) != key:
                    out += [(key[0], agreed(rows))] if rows else []
                    key, rows = (seq, part), []
                rows.append(row)
            yield pd.DataFrame(out, columns=["seq", "idtp"])
        yield pd.DataFrame([(key[0], agreed(rows))] if rows else [], columns=["seq", "idtp"])

    def agreed(rows: list) -> int:
        t, p, n = zip(*rows, strict=True)
        a, b = ({x: i for i, x in enumerate(dict.fromkeys(xs))} for xs in (t, p))
        return -int(sum(c for *_, c in sparse([a[x] for x in t], [b[x] for x in p], [-float(x) for x in n], 0.0)))

    own = dealt(counts, "seq", "part").sortWithinPartitions("seq", "part", "t_id", "p_id").mapInPandas(run, f"seq {pairs.schema['seq'].dataType.simpleString()}, idtp long")
    return own.groupBy("seq").agg(F.sum("idtp").alias("idtp"))


def mot_metrics(truth: DataFrame, tracks: DataFrame, limit: float = LIMIT) -> DataFrame:
    """Per sequence, and overall in the row whose seq is null: counts, switches, MOTA, MOTP (mean distance) and IDF1."""
    truth, tracks = (checkpoint(d.select("seq", "frame_no", "id", *BOX)) for d in (truth, tracks))  # used again and again
    pairs = pairs_of(truth, tracks, limit)
    m = matches_of(pairs, limit)
    switch = F.lag("p_id").over(Window.partitionBy("seq", "t_id").orderBy("frame_no"))
    m = m.withColumn("sw", F.coalesce((switch != F.col("p_id")).cast("int"), F.lit(0)))
    hit = m.groupBy("seq").agg(F.count("*").alias("tp"), F.sum("dist").alias("dist"), F.sum("sw").alias("sw"))
    n_t, n_p = truth.groupBy("seq").agg(F.count("*").alias("n_truth")), tracks.groupBy("seq").agg(F.count("*").alias("n_pred"))
    j = n_t.join(n_p, "seq", "full").join(hit, "seq", "left").join(identity_overlap(pairs), "seq", "left").na.fill(0)
    s = j.rollup("seq").agg(*[F.sum(c).alias(c) for c in ("n_truth", "n_pred", "tp", "dist", "sw", "idtp")])
    return s.select(
        "seq", "n_truth", "n_pred", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_truth") - F.col("tp")).alias("fn"), F.col("sw").alias("switches"),
        (1 - (F.col("n_pred") - F.col("tp") + F.col("n_truth") - F.col("tp") + F.col("sw")) / F.when(F.col("n_truth") > 0, F.col("n_truth"))).alias("mota"),
        (F.col("dist") / F.when(F.col("tp") > 0, F.col("tp"))).alias("motp"),
        (2 * F.col("idtp") / F.when(F.col("n_truth") + F.col("n_pred") > 0, F.col("n_truth") + F.col("n_pred"))).alias("idf1"),
    )
