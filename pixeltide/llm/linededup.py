"""Reversible line dedup: sharded cuckoo filters before exact reference counts.

State is two tables. `postings` (key, doc_id) says which documents hold which line key; its counts per key are the exact
reference counts. A key that at least MIN_DOCS documents hold is hot: it stays in the largest doc_id that holds it and is
dropped elsewhere. `filters` (shard, shards, filter) has one cuckoo filter per shard of the key space with the fingerprints of
the hot keys; keys that become hot are inserted, keys that no longer are get deleted, so documents can be added and taken
back (`add`, `remove`, `update_filters`) without a rebuild. A filter that gets full is made anew, larger, from the exact
table; where that isn't given it is null, which holds every key, until it is. A line whose fingerprint is in no filter is kept without a
look-up; the rest are joined with the exact table, so filter errors never reach the result.

Every line passes the filters. They are sent to the workers while their total is under BROADCAST bytes; beyond that the
lines are dealt to the filters' shards, in SALTS lots each. There is a shard for each SHARD_KEYS hot keys, SHARDS at least.
A hot line is one key with many postings: counts are combined before the shuffle, and the join is with the small hot
side, whose skewed partitions Spark splits.

Keys: a line with all of [\\x20\\x09-\\x0D] stripped at both ends and A-Z lower-cased, hashed to 128 bits; only keys of at
least MIN_CHARS code points count. Defined cases: a null or empty text is one empty line and comes back as it was;
rows that repeat a doc_id are one document when counting and each is cleaned; rows with a null doc_id hold no keys and
keep all lines; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixeltide.llm.common import Saved, importable

MIN_DOCS, MIN_CHARS = 3, 20
SHARDS, SHARD_KEYS, SALTS, BROADCAST = 64, 200_000, 16, 64 << 20
_BLANK = " \t\n\x0b\x0c\r"


def keys_of(text: str | None, min_chars: int) -> list[bytes | None]:
    """The key of each line, None for short ones."""
    out: list[bytes | None] = []
    for line in (text or "").split("\n"):
        line = line.strip(_BLANK)
        out.append(xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass").lower()) if len(line) >= min_chars else None)
    return out


class Cuckoo:
    """16-bit fingerprints in buckets of four, two buckets per key; deletes exactly what was inserted."""

    def __init__(self, capacity: int = 64, table: np.ndarray | None = None):
        n = 1 << max(2, int(np.ceil(np.log2(max(1, capacity) / 0.85 / 4))))
        self.table = np.zeros((n, 4), np.uint16) if table is None else table

    @classmethod
    def load(cls, raw: bytes) -> Cuckoo:
        return cls(table=np.frombuffer(raw, np.uint16).reshape(-1, 4).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints and both buckets of keys, an n x 2 array of uint64."""
        mask = np.uint64(len(self.table) - 1)
        prints = (keys[:, 1] % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        one = (keys[:, 1] >> np.uint64(20)) & mask
        return prints, one.astype(np.int64), ((one ^ self.offset(prints)) & mask).astype(np.int64)

    @staticmethod
    def offset(prints) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (np.asarray(prints, np.uint64) * np.uint64(0xC6A4A7935BD1E995)) >> np.uint64(24)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        p, a, b = self.places(keys)
        return (self.table[a] == p[:, None]).any(1) | (self.table[b] == p[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """False if the filter is full; it is to be rebuilt larger then."""
        for p, a, b in zip(*self.places(keys), strict=True):
            for _ in range(500):
                for at in (a, b):
                    if len(free := np.flatnonzero(self.table[at] == 0)):
                        self.table[at, free[0]] = p
                        break
                else:
                    slot = int(a + p) & 3  # push one out to its other bucket
                    p, self.table[a, slot] = self.table[a, slot], p
                    a = b = int((np.uint64(a) ^ self.offset(p)) & np.uint64(len(self.table) - 1))
                    continue
                break
            else:
                return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        for p, a, b in zip(*self.places(keys), strict=True):
            for at in (a, b):
                if len(hit := np.flatnonzero(self.table[at] == p)):
                    self.table[at, hit[0]] = 0
                    break


def halves(keys) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys[:, 0] % np.uint64(shards)).astype(np.int64)


def postings(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """key binary, doc_id: each key once for each row of docs(doc_id, text) that holds it."""
    importable(docs.sparkSession)

    def run(batches):
        for b in batches:
            keys, ids = [], []
            for d, t in zip(b.doc_id, b.text, strict=True):
                own = {k for k in keys_of(t, min_chars) if k is not None}
                keys += own
                ids += [d] * len(own)
            yield pd.DataFrame({"key": keys, "doc_id": ids})

    return docs.select("doc_id", "text").where("doc_id is not null").mapInPandas(run, "key binary, doc_id long")


def add(held: DataFrame, docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    return held.unionByName(postings(docs, min_chars)).distinct()


def remove(held: DataFrame, doc_ids: DataFrame) -> DataFrame:
    return held.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti").select("key", "doc_id")


def hot_keys(held: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """key, docs long, holder: the keys that at least min_docs documents hold, and the one that keeps it."""
    return held.groupBy("key").agg(F.countDistinct("doc_id").alias("docs"), F.max("doc_id").alias("holder")).where(F.col("docs") >= min_docs)


FILTERS = "shard int, shards int, filter binary"


def count_of(filters: DataFrame) -> int | None:
    """How many shards the key space has that the filters are of; None without filters, which hold no key."""
    row = filters.agg(F.max("shards"), F.min("shards")).first()
    if row[0] != row[1]:
        raise ValueError("filters of different numbers of shards")
    return row[0]


def build_filters(hot: DataFrame, shards: int = SHARDS) -> DataFrame:
    return update_filters(None, hot, None, shards)


def update_filters(filters: DataFrame | None, added: DataFrame, removed: DataFrame | None, shards: int = SHARDS, hot: DataFrame | None = None) -> DataFrame:
    """The filters after keys became hot (added.key) or no longer are (removed.key).

    hot: all hot keys by now, from which full filters are made anew. shards is for the first filters; later ones keep theirs.
    """
    importable(added.sparkSession)
    spark = added.sparkSession
    if filters is not None:
        shards = count_of(filters) or shards
    changes = added.select("key", F.lit(1).alias("sign"))
    if removed is not None:
        changes = changes.union(removed.select("key", F.lit(-1).alias("sign")))

    old = filters if filters is not None else spark.createDataFrame([], FILTERS)

    def change(before: pd.DataFrame, now: pd.DataFrame) -> pd.DataFrame:
        shard = int(before["shard"].iloc[0] if len(before) else now["shard"].iloc[0])
        plus, minus = now[now.sign > 0], now[now.sign < 0]
        size = 2 * len(plus)
        full = pd.DataFrame({"shard": [shard], "shards": [shards], "filter": [None]})
        if len(before) and before["filter"].iloc[0] is None:
            return full
        f = Cuckoo.load(before["filter"].iloc[0]) if len(before) else Cuckoo(size)
        if len(minus):
            f.delete(halves(minus.key))
        while len(plus) and not f.insert(halves(plus.key)):
            if len(before):  # an old filter can't tell its keys
                return full
            size *= 2
            f = Cuckoo(size)
        return pd.DataFrame({"shard": [shard], "shards": [shards], "filter": [f.dump()]})

    def changed(own: DataFrame, changes: DataFrame, only: list[int] | None = None) -> DataFrame:
        def tag(batches):
            for b in batches:
                if len(b):
                    b = b.assign(shard=shard_of(halves(b.key), shards).astype(np.int32))[["shard", "key", "sign"]]
                    yield b if only is None else b[b["shard"].isin(only)]

        tagged = changes.mapInPandas(tag, "shard int, key binary, sign int")
        return own.groupBy("shard").cogroup(tagged.groupBy("shard")).applyInPandas(change, FILTERS)

    done = changed(old, changes)
    if filters is None or hot is None:
        return done
    done = Saved(done).df
    full = [r.shard for r in done.where("filter is null").select("shard").collect()]  # one number per full filter
    if not full:
        return done
    anew = changed(spark.createDataFrame([], FILTERS), hot.select("key", F.lit(1).alias("sign")), full)
    return done.where("filter is not null").unionByName(anew)


def candidates(docs: DataFrame, filters: DataFrame, min_chars: int = MIN_CHARS, broadcast: int = BROADCAST) -> DataFrame:
    """key, doc_id of the lines that may be hot: those that a filter holds."""
    size, shards = filters.agg(F.sum(F.length("filter"))).first()[0] or 0, count_of(filters)
    if size > broadcast:
        return _dealt(postings(docs, min_chars), filters, shards)
    shared = docs.sparkSession.sparkContext.broadcast({r.shard: r["filter"] for r in filters.collect()})  # at most `broadcast` bytes

    def run(batches):
        own = {s: None if raw is None else Cuckoo.load(raw) for s, raw in shared.value.items()}
        for b in batches:
            keys, ids = [], []
            for d, t in zip(b.doc_id, b.text, strict=True):
                mine = {k for k in keys_of(t, min_chars) if k is not None}
                keys += mine
                ids += [d] * len(mine)
            if keys and own:
                pairs = halves(keys)
                shard = shard_of(pairs, shards)
                ok = np.zeros(len(keys), bool)
                for s, f in own.items():
                    at = np.flatnonzero(shard == s)
                    ok[at] = True if f is None else f.contains(pairs[at])
                at = np.flatnonzero(ok)
                yield pd.DataFrame({"key": [keys[i] for i in at], "doc_id": np.array(ids, np.int64)[at]})

    return docs.select("doc_id", "text").where("doc_id is not null").mapInPandas(run, "key binary, doc_id long")


def _dealt(held: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The postings that the filters of their shards hold; a shard's postings are dealt to SALTS lots by the document."""

    def tag(batches):
        for b in batches:
            if len(b):
                yield b.assign(shard=shard_of(halves(b.key), shards).astype(np.int32))[["shard", "key", "doc_id"]]

    def probe(f: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(f) or not len(rows):
            return rows[:0][["key", "doc_id"]]
        if f["filter"].iloc[0] is None:
            return rows[["key", "doc_id"]]
        return rows[Cuckoo.load(f["filter"].iloc[0]).contains(halves(rows.key))][["key", "doc_id"]]

    tagged = held.mapInPandas(tag, "shard int, key binary, doc_id long").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    spread = filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return spread.groupBy("shard", "salt").cogroup(tagged.groupBy("shard", "salt")).applyInPandas(probe, "key binary, doc_id long")


def drops(found: DataFrame, hot: DataFrame) -> DataFrame:
    """doc_id, keys array<binary>: what each document loses."""
    gone = found.join(hot.select("key", "holder"), "key").where("doc_id <> holder")
    return gone.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def clean(docs: DataFrame, lost: DataFrame, min_chars: int = MIN_CHARS, counts: bool = True) -> DataFrame:
    """All columns of docs with the text after the dropped lines are out; counts: and n_lines, n_dropped (long), in place of any of docs."""
    importable(docs.sparkSession)
    names = docs.columns
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    joined = own.join(lost.select(F.col("doc_id").alias("_id"), F.col("keys").alias("_keys")), "_id", "left")

    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def cut(text: pd.Series, keys: pd.Series) -> pd.DataFrame:
        out = []
        for t, k in zip(text, keys, strict=True):
            lines = t.count("\n") + 1 if t else 1
            if not t or k is None or not len(k):
                out.append((t, lines, 0))
                continue
            gone = set(k)
            kept = [line for line, key in zip(t.split("\n"), keys_of(t, min_chars), strict=True) if key not in gone]
            out.append(("\n".join(kept), lines, lines - len(kept)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

    done = joined.withColumn("_cut", cut("_text", "_keys"))
    more = ["n_lines", "n_dropped"] if counts else []
    columns = [F.col("_cut.text").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names if c not in more]
    return done.select(*columns, *[f"_cut.{c}" for c in more])


def dedup(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, broadcast: int = BROADCAST, counts: bool = True) -> DataFrame:
    """clean() of all docs against each other, by the filters and the exact table."""
    hot = Saved(hot_keys(postings(docs, min_chars), min_docs)).df  # the hot part alone: cuts what is computed twice
    shards = max(SHARDS, -(-hot.count() // SHARD_KEYS))
    filters = Saved(build_filters(hot, shards)).df
    return clean(docs, drops(candidates(docs, filters, min_chars, broadcast), hot), min_chars, counts)
