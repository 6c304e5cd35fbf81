"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

A copy scores LEAK where the best local alignment (match 2, mismatch and gap -1) reaches that share of the item's alignment
with itself: n points for n words. Between two matches of an alignment that are i words apart in the item and j in the text
lie max(i, j) - 1 points of cost. With m matches the cost is at most 2 m - n, so at least n / 2 - 1 of the pairs of
successive matches are at most two words apart on both sides, and each of them begins at another word of the item. Hence
an item needs seeds at some of its words only: those whose pairs (the word with the next one, and with the one after that)
are the rarest in the benchmark. With T more than the n - 1 beginnings less the n / 2 - 1 sure ones, at least T seeds are
hit in any leak, whatever was replaced, deleted or put in; frequent pairs are seeds of an item only if it has no rarer ones.

A text is looked at where T seeds of an item lie within n places of one diagonal, which any alignment that can reach the
threshold keeps to. There a passage is cut that holds the alignment, dropped if the words it shares with the item can't
reach the threshold (an upper bound on the alignment), and the rest aligned. Items of two words have one seed: both words,
at most two apart.

One scan without a shuffle of texts. The benchmark goes to the workers in blocks of at most about BLOCK_WORDS words, one
scan for each block, one block at a time. Texts are looked up in windows, so the seeds held at once don't follow their length.

Words are lower-cased (A-Z), with ASCII punctuation as white space. Defined cases: items of fewer than N words, or null,
leak nowhere; null and empty texts hold no leak; repeated items are items each; rows that repeat a doc_id are looked at
each and their best score per item is given; rows without doc_id are kept by `without_leaks` only if they hold no leak; an
empty table, of either kind, gives no leak.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixeltide.llm.common import Saved, hashes, importable

N, LEAK = 2, 0.5
EIGHTH = 8  # T is n / 8: a longer list of seeds, but less to align
WINDOW = 4_096  # words of a text whose seeds are looked up at once, or four times the longest item
BLOCK_WORDS = 2_000_000
MATCH, MISS, GAP = 2, -1, -1
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def plain_words(text: bytes | None) -> list[bytes]:
    return text.translate(_PLAIN).split() if text else []


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two sequences of numbers: score, and the last places in both."""
    step = np.arange(len(passage)) * -GAP
    row = np.zeros(len(passage) + 1, np.int64)
    best = (0, 0, 0)
    for i, w in enumerate(item):
        new = np.maximum(row[:-1] + np.where(passage == w, MATCH, MISS), row[1:] + GAP)
        new = np.maximum(new, 0)
        new = np.maximum.accumulate(new + step) - step  # gaps along the passage
        j = int(new.argmax())
        if new[j] > best[0]:
            best = (int(new[j]), i, j)
        row[1:] = new
    return best


class Bench:
    """A block of benchmark items: their words by number, and the rarest of their pairs of words, which are the seeds."""

    def __init__(self, ids: list[int], texts: list[bytes | None]):
        same: dict[tuple[bytes, ...], list[int]] = {}
        for i, t in zip(ids, texts, strict=True):
            if len(w := plain_words(t)) >= N:
                same.setdefault(tuple(w), []).append(i)
        self.ids, words = list(same.values()), [hashes(list(w)) for w in same]
        none = np.zeros(0, np.int64)
        self.known = np.unique(np.concatenate([np.zeros(0, np.uint64), *words]))
        self.words = [np.searchsorted(self.known, h) for h in words]
        self.need = [np.unique(w, return_counts=True) for w in self.words]
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.hits = np.maximum(1, self.size // EIGHTH)
        self.longest = int(self.size.max(initial=0))
        near = np.concatenate([none, *[self._pairs(w, 1) for w in self.words]])
        skip = np.concatenate([none, *[self._pairs(w, 2) for w in self.words]])
        item = np.repeat(np.arange(len(words)), self.size - 1)
        pos = np.concatenate([none, *[np.arange(n - 1) for n in self.size]])
        # how often the pairs that begin at a word are in the block; the rarest beginnings of each item are kept
        codes, number, times = np.unique(np.concatenate([near, skip[skip >= 0]]), return_inverse=True, return_counts=True)
        often = times[number[: len(near)]]
        often[skip >= 0] += times[number[len(near) :]]
        order = np.lexsort((pos, often, item))
        rank = np.arange(len(item)) - np.repeat(np.cumsum(self.size - 1) - (self.size - 1), self.size - 1)
        sure = np.maximum(1, -(-self.size // 2) - 1)
        kept = order[rank < (self.size - 1 - sure + self.hits)[item]]
        far = kept[skip[kept] >= 0]
        seeds, where = np.concatenate([near[kept], skip[far]]), np.concatenate([kept, far])
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.item, self.pos = seeds[order], item[where[order]], pos[where[order]]

    def _pairs(self, w: np.ndarray, apart: int) -> np.ndarray:
        """For each word but the last of a sequence, its pair with the word so far after it, or -1 past the end."""
        out = np.full(len(w) - 1, -1, np.int64)
        out[: max(0, len(w) - apart)] = w[:-apart] * len(self.known) + w[apart:]
        return out

    def candidates(self, number: np.ndarray):
        """item, least and greatest place of its first word: the parts of a text of word numbers that have an item's seeds."""
        window = max(WINDOW, 4 * self.longest)
        for start in range(0, len(number), window - 2 * self.longest):
            part = number[start : start + window + 2]
            at, code = [], []
            for apart in (1, 2):
                x = np.flatnonzero((part[:-apart] >= 0) & (part[apart:] >= 0))
                at.append(x + start)
                code.append(part[x] * len(self.known) + part[x + apart])
            at, code = np.concatenate(at), np.concatenate(code)
            lo = np.searchsorted(self.seeds, code)
            hit = self.seeds[np.minimum(lo, len(self.seeds) - 1)] == code
            at, lo, code = at[hit], lo[hit], code[hit]
            n = np.searchsorted(self.seeds, code, "right") - lo
            seed = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            item, begin = self.item[seed], np.repeat(at, n) - self.pos[seed]
            order = np.lexsort((begin, item))
            item, begin = item[order], begin[order]
            # as many seeds as a leak has, no further from each other than the gaps that a leak may have
            last = np.arange(len(item)) + self.hits[item] - 1
            end = np.minimum(last, len(item) - 1)
            first = np.flatnonzero((last == end) & (item[end] == item) & (begin[end] - begin <= self.size[item]))
            if len(first):
                end = end[first]
                new = np.append(True, (first[1:] > end[:-1]) | (item[first[1:]] != item[first[:-1]]))
                until = np.append(np.flatnonzero(new)[1:], len(first)) - 1
                yield from zip(item[first[new]].tolist(), begin[first[new]].tolist(), begin[end[until]].tolist(), strict=True)
            if start + window >= len(number):
                break

    def leaks(self, text: bytes | None) -> list[tuple[int, float, int, int]]:
        """item id, score, first and last word of the passage, for each item that leaks into a text."""
        h = hashes(plain_words(text))
        if len(h) < N or not len(self.seeds):
            return []
        k = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        number = np.where(self.known[k] == h, k, -1)
        best: dict[int, tuple[float, int, int]] = {}
        for i, low, high in self.candidates(number):
            words, (distinct, times) = self.words[i], self.need[i]
            size = len(words)  # an alignment that reaches LEAK has no more gaps than the item has words
            a = max(0, low - size)
            passage = number[a : max(0, high) + 2 * size + 1]
            own = np.sort(passage)
            shared = np.minimum(times, np.searchsorted(own, distinct, "right") - np.searchsorted(own, distinct)).sum()
            full = MATCH * size
            if MATCH * shared < LEAK * full:
                continue
            s, i_end, p_end = align(words, passage)
            if s / full >= max(LEAK, best.get(i, (0.0,))[0]):
                _, _, back = align(words[i_end::-1], passage[p_end::-1])
                new_ = (s / full, a + p_end - back, a + p_end)
                if new_[0] > best.get(i, (0.0,))[0]:
                    best[i] = new_
        return [(name, *x) for i, x in best.items() for name in self.ids[i]]


def blocks(bench: DataFrame):
    """The benchmark in blocks of a bounded number of words, one at a time."""
    size = bench.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"[\x00-\x7F&&[^0-9A-Za-z]]+")))).first()[0] or 0
    n = -(-size // BLOCK_WORDS)
    for k in range(n):
        rows = bench.where(F.col("item_id").isNotNull() & (F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)).select("item_id", F.col("text").cast("binary").alias("text")).toPandas()
        yield Bench([int(i) for i in rows.item_id], list(rows.text))


def leaks(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word: the passages of docs(doc_id, text) that copy items of bench(item_id, text)."""
    spark = docs.sparkSession
    importable(spark)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).where("doc_id is not null")
    kind = "doc_id long, item_id long, score double, first_word long, last_word long"
    found, before = spark.createDataFrame([], kind), None
    for block in blocks(bench):
        if before is not None:  # written, so that only one block is held by the workers
            found = Saved(found).df
            before.destroy()
        shared = before = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            own = shared.value
            for b in batches:
                rows = [(d, *x) for d, t in zip(b.doc_id, b.text, strict=True) for x in own.leaks(t)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "first_word", "last_word"])

        found = found.unionByName(text.mapInPandas(run, kind))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "first_word", "last_word")).alias("x"))
    return best.select("doc_id", "item_id", "x.score", "x.first_word", "x.last_word")


def without_leaks(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that hold no leak. Between two blocks the rows are written."""
    spark = docs.sparkSession
    importable(spark)
    before, saved = None, None
    for block in blocks(bench):
        if before is not None:
            last, saved = saved, Saved(docs)
            docs = saved.df
            before.destroy()
            if last is not None:
                last.drop()
        shared = before = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            own = shared.value
            for b in batches:
                texts = b.column("text").cast("binary").to_pylist()
                yield b.filter(pa.array([not own.leaks(t) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
