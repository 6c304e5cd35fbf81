"""Jaccard join of documents on word n-grams: rare-first prefixes with length, positional and suffix filters.

A document's set has a 64-bit hash for each distinct n-gram. Documents with equal sets form a class, known by a hash of
the set; classes are what is compared, so copies are never expanded into pairs.

1. One pass over the texts gives each document's set size, class and a 512-cell parity of its set, and counts n-grams
   over all documents in 2^20 cells (CELLS), which orders n-grams rare first. The order decides what it costs, never
   what is found: any one order of all n-grams is right.
2. A second pass emits each class's prefix: the n - ceil(t n) + 1 rarest n-grams. Two sets with Jaccard >= t share one.
3. In each bucket (classes that share a prefix n-gram) the class with the most copies is the head. Each class is verified
   once against the head it shares most of its prefix with, after length, positional and suffix filters (the parities
   differ in at most as many cells as the sets do in n-grams). This gives the bulk of the links in linear time.
4. All pairs of a bucket that are not yet in one component pass the same filters, as they are made, and are verified
   likewise. So no link that joins two components is lost, and no pair inside a component is expanded.

Nothing is capped. Exact copies are combined before the shuffle, and whole sets are only computed for classes of pairs
that pass all filters. A class with many pairs, as heads have, is dealt out for the verification: its set goes once to
every PAIRS of them. The head of a bucket is found by a window over the bucket, which one task sorts and spills; in step 4
a large bucket is a join key whose skewed partitions Spark splits.

Defined cases: null or blank texts have no n-grams and link with nothing; with fewer than k words the whole sequence is
the one n-gram; rows without doc_id get no component; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixeltide.llm.common import Saved, checkpoint, hashes, ids_in, ids_out, importable, mix, shingles, words
from pixeltide.llm.graph import components

CELLS, PARTS = 1 << 20, 16
IDS = 4_000_000  # ids sent to the workers at most, 8 bytes each
PAIRS = 64  # pairs of one class that are verified together, about


def set_of(text: bytes | None, k: int) -> np.ndarray:
    return np.unique(shingles(hashes(words(text)), k))


def class_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def parity(s: np.ndarray) -> np.ndarray:
    cells = np.bincount((s >> np.uint64(40)).astype(np.int64) & 511, minlength=512) & 1
    return np.packbits(cells.astype(np.uint8)).view(np.int64)


def least_common(a, b, percent: int):
    """The smallest intersection of sets of sizes a and b that are linked; for columns or numbers."""
    whole = percent * (a + b)
    return F.ceil(whole / (100 + percent)) if isinstance(whole, Column) else -(-whole // (100 + percent))


def profiles(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n, class, parity for each document with n-grams; and rows (part, cells) with counts of this task."""

    def run(batches):
        counts = np.zeros(CELLS, np.int64)
        for b in batches:
            rows, all_sets = [], []
            for d, t in zip(b.doc_id, b.text, strict=True):
                s = set_of(t, k)
                all_sets.append(s)
                rows.append((d, len(s), class_of(s) if len(s) else None, parity(s) if len(s) else None))
            flat = np.concatenate(all_sets) if all_sets else np.zeros(0, np.uint64)
            counts += np.bincount((flat & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
            # numbers with gaps stay whole: 64-bit classes are no floats
            whole = {k: pd.array([r[i] for r in rows], dtype="Int64") for i, k in ((0, "doc_id"), (2, "class"))}
            yield pd.DataFrame({"doc_id": whole["doc_id"], "n": [r[1] for r in rows], "class": whole["class"], "parity": [r[3] for r in rows], "part": pd.array([None] * len(rows), "Int32"), "cells": None})
        size = CELLS // PARTS
        for i in range(PARTS if counts.any() else 0):
            yield pd.DataFrame({"doc_id": pd.array([None], "Int64"), "n": [0], "class": pd.array([None], "Int64"), "parity": [None], "part": pd.array([i], "Int32"), "cells": [counts[i * size : (i + 1) * size].astype("<i8").tobytes()]})

    text = docs.select(ids_in(), F.col("text").cast("binary").alias("text"))
    return ids_out(text.mapInPandas(run, "doc_id long, n int, class long, parity array<long>, part int, cells binary"))


def cell_counts(parts: DataFrame) -> np.ndarray:
    """The counts of all tasks, one number per cell."""

    def total(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [key[0]], "cells": [sum(np.frombuffer(x, "<i8") for x in pdf.cells).tobytes()]})

    some = parts.select("part", "cells", F.pmod(F.spark_partition_id(), F.lit(64)).alias("lot"))
    once = some.groupBy("part", "lot").applyInPandas(total, "part int, cells binary")
    out = np.zeros(CELLS, np.int64)
    size = CELLS // PARTS
    for r in once.groupBy("part").applyInPandas(total, "part int, cells binary").collect():  # PARTS rows
        out[r.part * size : (r.part + 1) * size] = np.frombuffer(r.cells, "<i8")
    return out


def prefixes(docs: DataFrame, k: int, percent: int, counts: np.ndarray) -> DataFrame:
    """token, class, n, pos, copies: the prefix of each class, once per task."""
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, np.iinfo(np.uint32).max).astype(np.uint32))  # 4 MB

    def run(batches):
        freq = shared.value
        for b in batches:
            seen: dict[int, list] = {}
            for t in b.text:
                s = set_of(t, k)
                if not len(s):
                    continue
                c = class_of(s)
                if c in seen:
                    seen[c][2] += 1
                    continue
                n = len(s)
                keep = n - -(-percent * n // 100) + 1
                rank = freq[(s & np.uint64(CELLS - 1)).astype(np.int64)]
                spread = mix(s)
                seen[c] = [s[np.lexsort((spread, rank))[:keep]].view(np.int64), n, 1]
            if seen:
                lens = [len(x[0]) for x in seen.values()]
                yield pd.DataFrame(
                    {
                        "token": np.concatenate([x[0] for x in seen.values()]),
                        "class": np.repeat(np.fromiter(seen, np.int64, len(seen)), lens),
                        "n": np.repeat([x[1] for x in seen.values()], lens),
                        "pos": np.concatenate([np.arange(m) for m in lens]),
                        "copies": np.repeat([x[2] for x in seen.values()], lens),
                    }
                )

    return docs.select(F.col("text").cast("binary").alias("text")).mapInPandas(run, "token long, class long, n int, pos int, copies int")


def may_link(a: str, b: str, percent: int) -> Column:
    """Length and positional filter for rows with the columns n and pos."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    rest = F.least(na - F.col(f"{a}.pos"), nb - F.col(f"{b}.pos"))  # what can still be common from the first common n-gram on
    return (F.lit(percent) * F.greatest(na, nb) <= F.lit(100) * F.least(na, nb)) & (rest >= least_common(na, nb, percent))


def suffix_filter(a: str, b: str, percent: int, cells: list[str]) -> Column:
    """Rows differ in at least as many n-grams as their parities (the columns `cells`) differ in bits."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    bits = [F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in cells]
    return sum(bits[1:], bits[0]) <= na + nb - 2 * least_common(na, nb, percent)


WIDE = [f"p{i}" for i in range(8)]


def passing(pairs: DataFrame, parities: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(a, b, ...) that the suffix filter with all cells lets through."""
    own = lambda c, n: parities.select(F.col("class").alias(c), F.struct("n", *WIDE).alias(n))
    both = pairs.join(own("a", "x"), "a").join(own("b", "y"), "b")
    return both.where(suffix_filter("x", "y", percent, WIDE)).drop("x", "y")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of pairs(a, b), each once, whose whole sets are linked."""
    found = Saved(pairs)
    pairs = found.df
    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    wanted = classes.join(wanted, "class", "left_semi").select(F.col("holder").alias("doc_id"))
    text = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    wanted = checkpoint(wanted)
    if wanted.count() <= IDS:
        shared = docs.sparkSession.sparkContext.broadcast(np.sort(wanted.toPandas().doc_id.values.astype(np.int64)))  # IDS at most
    else:
        shared, text = None, text.join(wanted, "doc_id", "left_semi")

    def run(batches):
        ids = shared.value if shared is not None else None
        for b in batches:
            if ids is not None:
                b = b[np.isin(b.doc_id.values, ids)]
            for at in range(0, len(b), 200):
                sets = [set_of(t, k) for t in b.text.iloc[at : at + 200]]
                yield pd.DataFrame({"class": [class_of(s) if len(s) else 0 for s in sets], "s": [s.view(np.int64) for s in sets]})

    made = Saved(text.mapInPandas(run, "class long, s array<long>"))
    sets = made.df
    # ids are small and sets are not: the ids go to the sets while there are IDS of them at most
    small = F.broadcast if pairs.count() <= IDS else lambda df: df
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS).alias("salts")).where("salts > 1")
    pairs = pairs.join(small(many), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).alias("salt"))
    left = sets.select(F.col("class").alias("b"), F.col("s").alias("sb")).join(small(pairs), "b")
    heads = sets.select(F.col("class").alias("a"), F.col("s").alias("sa")).join(small(pairs.select("a", "salt").distinct()), "a")
    both = left.join(heads, ["a", "salt"])
    common = F.size(F.array_intersect("sa", "sb"))
    links = checkpoint(both.where(common * (100 + percent) >= percent * (F.size("sa") + F.size("sb"))).select("a", "b").distinct())
    made.drop()
    found.drop()
    return links


def components_of(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links lead to) for each row of docs(doc_id, text)."""
    importable(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = Saved(profiles(docs, k)).df
    counts = cell_counts(rows.where("part is not null"))
    own = rows.where("part is null")
    classes = own.where("class is not null and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("holder"), F.max("n").alias("n"))

    tokens = prefixes(docs, k, percent, counts).repartition("token").groupBy("token", "class").agg(F.max("n").alias("n"), F.min("pos").alias("pos"), F.sum("copies").alias("copies"))
    bucket = Window.partitionBy("token")
    heads = F.max(F.struct("copies", "class", "n", "pos")).over(bucket).alias("head")
    shared = tokens.select("*", F.count("*").over(bucket).alias("size"), heads).where("size > 1")
    in_buckets = Saved(shared.select("token", "class", "n", "pos", "head"))
    shared = in_buckets.df

    parities = own.where("class is not null").groupBy("class").agg(F.first("parity").alias("parity"), F.first("n").alias("n"))
    cell = [F.col("parity")[i] for i in range(8)]
    parities = parities.select("class", "n", *[e.alias(c) for e, c in zip(cell, WIDE, strict=True)])
    near = shared.select(F.col("head").alias("x"), F.struct("class", "n", "pos").alias("y")).where("x.class <> y.class").where(may_link("x", "y", percent))
    near = near.groupBy(F.col("x.class").alias("a"), F.col("y.class").alias("b")).agg(F.count("*").alias("common"))
    # each class once: with the head that shares most of its prefix
    near = passing(near, parities, percent).groupBy("b").agg(F.max(F.struct("common", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    links = verified(near, docs, classes, k, percent)

    first = checkpoint(components(links))
    placed = shared.select("token", "class", "n", "pos").join(first, F.col("class") == F.col("node"), "left").withColumn("own", F.coalesce("component_id", "class")).drop("node", "component_id")
    split = placed.groupBy("token").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo <> hi").select("token")
    open_ = placed.join(split, "token", "left_semi").join(parities.select("class", *WIDE), "class").select("token", "class", "n", "pos", "own", *WIDE)
    still_open = Saved(open_)
    in_buckets.drop()
    open_ = still_open.df
    more = open_.alias("x").join(open_.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.own") < F.col("y.own")) & may_link("x", "y", percent) & suffix_filter("x", "y", percent, WIDE))
    more = more.select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")).distinct()
    links = links.union(verified(more, docs, classes, k, percent))
    still_open.drop()

    found = components(links)
    joined = classes.join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("own", F.coalesce("component_id", "class"))
    least = joined.groupBy("own").agg(F.min("holder").alias("component_id"))
    placed = joined.select("class", "own").join(least, "own").select("class", "component_id")
    out = own.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "class").join(placed, "class", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
