"""How a source's terms differ from those of its language and of the language's other sources.

1. First pass: documents per (lang, term), exactly, counted in the tasks before the shuffle; terms of MIN_DOCS documents
   are kept.
2. Kept terms are dealt to shards of about SHARD_KEYS of one language. A shard gets a minimal perfect hash: levels of bit
   arrays; a key that is alone at its place in a level keeps it, the others go on to the next, and a key's slot is the
   number of taken places before its own. The terms themselves are stored by slot, so a term that isn't kept, which a
   perfect hash sends anywhere, is told by comparing its bytes.
3. Second pass: the shards are broadcast, and each text's terms increment dense slots of its (lang, source) group and
   shard. Where the shards are more than BROADCAST bytes, counts of terms are dealt to the shards instead, in SALTS lots, and
   increment the slots there.
4. Slots are summed, FAN tasks' at a time, and give N and p of each group, which are compared with the language's slots
   and, for blocks of SOURCES sources at a time, with each other's. All of it is whole numbers.

A task holds at most HOLD bytes of slots; it sends them on beyond that. No key of a join or group has more rows than a shard
has blocks or FAN tasks have sent, whatever a language, source or term is worth.

Terms are runs of letters A-Z, a-z and all characters beyond ASCII, A-Z lower-cased. p = 1 + floor(PARTS (count + 1) / (N + V)),
and f(p, q) = floor((p - q)^2 / q).

Defined cases: a null text, lang or source is ''; each row is a document, repeated or not; a group without kept terms has
N = 0; a language without any has value 0 for each pair; ties are ranked by the item's bytes; a language with one source has no
pairs; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixeltide.llm.bpe import parts
from pixeltide.llm.common import Saved, importable, mix

MIN_DOCS, TOP, PARTS = 3, 200, 1_000_000_000
SHARD_KEYS, BROADCAST, HOLD = 16_384, 64 << 20, 96 << 20
SOURCES, FAN, SALTS = 64, 64, 16
COUNTED, MOST = 300_000, 1 << 30  # terms, and their occurrences, that a task counts before it looks them up or sends them on
GAMMA, LEVELS = 2, 48
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 128 and not chr(c).isalpha() else c for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(_PLAIN).split() if text else []


# --- minimal perfect hashes


def hashes(items: list[bytes]) -> np.ndarray:
    """Two 64-bit halves for each item."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, items)), "<u8").reshape(-1, 2)


def level_places(h: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(h[:, 0] + np.uint64(level) * (h[:, 1] | np.uint64(1))) % np.uint64(size)).astype(np.int64)


@dataclass
class Perfect:
    """sizes: of the levels; taken: a flag for each place of all levels; rank: taken places before each; blob, ends: the stored keys."""

    sizes: np.ndarray
    taken: np.ndarray
    blob: np.ndarray
    ends: np.ndarray

    def __post_init__(self):
        self.rank = (np.cumsum(self.taken) - self.taken).astype(np.int32)
        self.begins = np.append(0, self.ends[:-1]) if len(self.ends) else self.ends
        self.first = np.cumsum(self.sizes) - self.sizes

    def __len__(self) -> int:
        return len(self.ends)

    @classmethod
    def build(cls, items: list[bytes]) -> Perfect:
        h = hashes(items)
        left, sizes, taken, slots = np.arange(len(items)), [], [], np.zeros(len(items), np.int64)
        done = 0
        while len(left):
            if len(sizes) == LEVELS:
                raise ValueError("two terms have the same 128-bit hash")
            size = max(8, GAMMA * len(left))
            at = level_places(h[left], len(sizes), size)
            n = np.bincount(at, minlength=size)
            alone = n[at] == 1
            flags = n == 1
            slots[left[alone]] = done + (np.cumsum(flags) - flags)[at[alone]]
            done += int(alone.sum())
            sizes.append(size)
            taken.append(flags)
            left = left[~alone]
        keys = [b""] * len(items)
        for item, s in zip(items, slots.tolist(), strict=True):
            keys[s] = item
        flat = np.concatenate([np.zeros(0, bool), *taken])
        return cls(np.array(sizes, np.int64), flat, np.frombuffer(b"".join(keys), np.uint8), np.cumsum([len(k) for k in keys], dtype=np.int64))

    def dump(self) -> bytes:
        head = np.array([len(self.sizes), len(self.ends), len(self.blob)], "<i8")
        return b"".join([head.tobytes(), self.sizes.astype("<i8").tobytes(), self.ends.astype("<i8").tobytes(), self.blob.tobytes(), np.packbits(self.taken).tobytes()])

    @classmethod
    def load(cls, raw: bytes) -> Perfect:
        levels, n, size = np.frombuffer(raw, "<i8", 3)
        at = 24
        sizes = np.frombuffer(raw, "<i8", levels, at)
        ends = np.frombuffer(raw, "<i8", n, at := at + 8 * int(levels))
        blob = np.frombuffer(raw, np.uint8, size, at := at + 8 * int(n))
        taken = np.unpackbits(np.frombuffer(raw, np.uint8, -1, at + int(size)), count=int(sizes.sum())).astype(bool)
        return cls(sizes, taken, blob, ends)

    def keys(self) -> list[bytes]:
        raw = self.blob.tobytes()
        return [raw[a:b] for a, b in zip(self.begins.tolist(), self.ends.tolist(), strict=True)]

    def slots(self, items: list[bytes], h: np.ndarray) -> np.ndarray:
        """The slot of each item, -1 for those that aren't keys. h: their hashes."""
        out, left = np.full(len(items), -1, np.int64), np.arange(len(items))
        for level, size in enumerate(self.sizes.tolist()):
            place = self.first[level] + level_places(h[left], level, size)
            found = self.taken[place]
            out[left[found]] = self.rank[place[found]]
            left = left[~found]
        # the stored key decides
        at = np.flatnonzero(out >= 0)
        slot, lens = out[at], np.fromiter(map(len, items), np.int64, len(items))[at]
        same = self.ends[slot] - self.begins[slot] == lens
        out[at[~same]] = -1
        at, slot, lens = at[same], slot[same], lens[same]
        if len(at):
            flat = np.frombuffer(b"".join([items[i] for i in at]), np.uint8)
            start = np.cumsum(lens) - lens
            stored = self.blob[np.arange(len(flat)) + np.repeat(self.begins[slot] - start, lens)]
            out[at[~np.logical_and.reduceat(stored == flat, start)]] = -1
        return out


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return (h[:, 1] % np.uint64(shards)).astype(np.int64)


# --- first pass


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.col("text").cast("binary").alias("text"))


def _sent(counts: dict[str, Counter], name: str) -> pd.DataFrame:
    """(lang, term, name) rows of counters by language, which are emptied."""
    langs = pd.Series([lang for lang, c in counts.items() for _ in c], dtype=object)  # a text column of pandas' own may come in chunks
    out = pd.DataFrame({"lang": langs, "term": [t for c in counts.values() for t in c], name: [n for c in counts.values() for n in c.values()]})
    counts.clear()
    return out


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term binary: the terms in at least min_docs documents of a language."""
    importable(docs.sparkSession)

    def run(batches):
        counts: dict[str, Counter] = {}
        for part in (p for b in batches for p in parts([b])):
            for lang, text in zip(part.lang, part.text, strict=True):
                counts.setdefault(lang, Counter()).update(set(terms(text)))
            if sum(map(len, counts.values())) > COUNTED:
                yield _sent(counts, "n")
        yield _sent(counts, "n")

    seen = _plain(docs).select("lang", "text").mapInPandas(run, "lang string, term binary, n long")
    return seen.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("lang", "term")


def perfect_hashes(kept: DataFrame, shards: dict[str, int]) -> DataFrame:
    """lang, shard int, hash binary, keys long for each shard of kept(lang, term). shards: how many a language has."""

    def tag(batches):
        for b in batches:
            if len(b):
                n = b.lang.map(shards).to_numpy(np.uint64)
                yield b.assign(shard=(hashes(b.term.tolist())[:, 1] % n).astype(np.int32))

    def build(g: pd.DataFrame) -> pd.DataFrame:
        made = Perfect.build(sorted(g.term))
        return pd.DataFrame({"lang": g.lang.iloc[:1], "shard": g["shard"].iloc[:1], "hash": [made.dump()], "keys": [len(made)]})

    return kept.mapInPandas(tag, "lang string, term binary, shard int").groupBy("lang", "shard").applyInPandas(build, "lang string, shard int, hash binary, keys long")


# --- second pass

SLOTS = "lang string, source string, shard int, task int, at binary, n binary"


def _packed(lang, source, shard, task, dense) -> tuple:
    at = np.flatnonzero(dense)
    return lang, source, shard, task, at.astype("<i4").tobytes(), dense[at].astype("<i8").tobytes()


_COLUMNS = ["lang", "source", "shard", "task", "at", "n"]


class Slots:
    """Dense counts by (lang, source, shard), of `keys` slots each."""

    def __init__(self, task: int, kind=np.int64):
        self.task, self.kind, self.held, self.bytes, self.added = task, kind, {}, 0, 0

    def add(self, lang: str, source: str, shard: int, keys: int, slots: np.ndarray, n: np.ndarray) -> None:
        """Adds n at slots, which are different ones."""
        dense = self.held.get((lang, source, shard))
        if dense is None:
            dense = self.held[lang, source, shard] = np.zeros(keys, self.kind)
            self.bytes += dense.nbytes + 200
        dense[slots] += n.astype(self.kind)
        self.added += int(n.sum())

    def send(self):
        rows = [_packed(*k, self.task, v) for k, v in self.held.items()]
        self.held, self.bytes, self.added = {}, 0, 0
        for at in range(0, len(rows), 64):
            yield pd.DataFrame(rows[at : at + 64], columns=_COLUMNS)


def _counted(docs: DataFrame, made: DataFrame, shards: dict[str, int]) -> DataFrame:
    """SLOTS rows by broadcast shards."""
    rows = made.select("lang", "shard", "hash").toLocalIterator()  # BROADCAST bytes at most
    shared = docs.sparkSession.sparkContext.broadcast({(r.lang, r.shard): bytes(r["hash"]) for r in rows})

    def run(batches):
        own: dict[tuple[str, int], Perfect] = {}
        held = Slots(TaskContext.get().partitionId(), np.int32)  # a slot stays under 2 * MOST
        counts: dict[str, dict[str, Counter]] = {}

        def look_up(lang: str, sources: dict[str, Counter]) -> None:
            items = list(set().union(*sources.values()))
            place = dict(zip(items, range(len(items)), strict=True))
            h = hashes(items)
            shard, slot = shard_of(h, shards[lang]), np.full(len(items), -1, np.int64)
            order = np.argsort(shard, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                key = lang, int(shard[at[0]])
                if key in shared.value:
                    if key not in own:
                        own[key] = Perfect.load(shared.value[key])
                    slot[at] = own[key].slots([items[i] for i in at], h[at])
            for source, c in sources.items():
                at = np.fromiter(map(place.get, c), np.int64, len(c))
                n = np.fromiter(c.values(), np.int64, len(c))
                ok = slot[at] >= 0
                at, n = at[ok], n[ok]
                order = np.argsort(shard[at], kind="stable")
                at, n = at[order], n[order]
                for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(shard[at])) + 1):
                    if len(part):
                        s = int(shard[at[part[0]]])
                        held.add(lang, source, s, len(own[lang, s]), slot[at[part]], n[part])

        def settle():
            for lang, sources in counts.items():
                look_up(lang, sources)
            counts.clear()
            if held.bytes > HOLD or held.added > MOST:
                yield from held.send()

        seen = 0
        for part in (p for b in batches for p in parts([b])):
            for lang, source, text in zip(part.lang, part.source, part.text, strict=True):
                if lang in shards and (found := terms(text)):
                    counts.setdefault(lang, {}).setdefault(source, Counter()).update(found)
                    seen += len(found)
            if seen > MOST or sum(len(c) for sources in counts.values() for c in sources.values()) > COUNTED:
                yield from settle()
                seen = 0
        yield from settle()
        yield from held.send()

    return _plain(docs).mapInPandas(run, SLOTS)


def _dealt(docs: DataFrame, made: DataFrame, shards: dict[str, int]) -> DataFrame:
    """SLOTS rows where the shards are too large to send: counts of terms go to their shards, in lots by source and term."""

    def count(batches):
        counts: dict[tuple[str, str], Counter] = {}

        def send():
            for (lang, source), c in counts.items():
                h = hashes(list(c))
                same = [pd.Series([x] * len(c), dtype=object) for x in (lang, source)]
                yield pd.DataFrame({"lang": same[0], "source": same[1], "shard": shard_of(h, shards[lang]).astype(np.int32), "salt": (h[:, 0] % np.uint64(SALTS)).astype(np.int32), "term": list(c), "n": list(c.values())})
            counts.clear()

        for part in (p for b in batches for p in parts([b])):
            for lang, source, text in zip(part.lang, part.source, part.text, strict=True):
                if lang in shards and (found := terms(text)):
                    counts.setdefault((lang, source), Counter()).update(found)
            if sum(map(len, counts.values())) > COUNTED:
                yield from send()
        yield from send()

    def add(hashed: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(hashed) or not len(rows):
            return pd.DataFrame({c: [] for c in _COLUMNS})
        lang, shard, task = hashed.lang.iloc[0], int(hashed["shard"].iloc[0]), int(hashed.salt.iloc[0])
        own, items = Perfect.load(hashed["hash"].iloc[0]), rows.term.tolist()
        slot, held = own.slots(items, hashes(items)), Slots(task)
        for source, at in rows.groupby("source").indices.items():
            at = at[slot[at] >= 0]
            held.add(lang, source, shard, len(own), slot[at], rows.n.to_numpy()[at])
        return pd.DataFrame([_packed(*k, task, v) for k, v in held.held.items()], columns=_COLUMNS)

    sent = _plain(docs).mapInPandas(count, "lang string, source string, shard int, salt int, term binary, n long")
    sent = sent.groupBy("lang", "source", "shard", "salt", "term").agg(F.sum("n").alias("n"))
    spread = made.select("lang", "shard", "hash").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return spread.groupBy("lang", "shard", "salt").cogroup(sent.groupBy("lang", "shard", "salt")).applyInPandas(add, SLOTS)


def _summed(rows: DataFrame, tasks: int) -> DataFrame:
    """One SLOTS row for each group and shard; FAN tasks' rows at a time meet in a partition, which reads them as they come."""

    def add(batches):
        key, total, task = None, None, 0
        for b in batches:
            for lang, source, shard, task_, at, n in b.itertuples(index=False):
                at, n = np.frombuffer(at, "<i4"), np.frombuffer(n, "<i8")
                if key != (lang, source, shard, task_):
                    if key:
                        yield pd.DataFrame([_packed(*key, total)], columns=_COLUMNS)
                    key, total = (lang, source, shard, task_), np.zeros(0, np.int64)
                if len(at) and at[-1] >= len(total):
                    total = np.concatenate([total, np.zeros(int(at[-1]) + 1 - len(total), np.int64)])
                total[at] += n
        if key:
            yield pd.DataFrame([_packed(*key, total)], columns=_COLUMNS)

    while True:
        tasks = max(1, -(-tasks // FAN))
        rows = rows.withColumn("task", F.pmod("task", F.lit(tasks)) if tasks > 1 else F.lit(0))
        keys = ["lang", "source", "shard", "task"]
        rows = rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(add, SLOTS)
        if tasks == 1:
            return rows


# --- comparison


def share(count: np.ndarray, n: int, v: int) -> np.ndarray:
    """1 + floor(PARTS (count + 1) / (n + v)), digit by digit so that nothing overflows."""
    whole, rest = np.zeros(len(count), np.int64), count + 1
    for _ in range(3):
        rest = rest * 1000
        whole, rest = whole * 1000 + rest // (n + v), rest % (n + v)
    return whole + 1


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _dense(at: bytes, n: bytes, keys: int) -> np.ndarray:
    out = np.zeros(keys, np.int64)
    out[np.frombuffer(at, "<i4")] = np.frombuffer(n, "<i8")
    return out


def term_values(slots: DataFrame, made: DataFrame, sizes: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item, value: the terms that a source has more of than its language; at most `top` of a shard.

    slots: all groups' and, with a null source, the languages'. sizes: lang, source, n, v.
    """

    def run(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                own, keys = Perfect.load(r.hash), None
                count = _dense(r.at, r.n, len(own))
                p, q = share(count, r.size, r.v), share(_dense(r.all_at, r.all_n, len(own)), r.all_size, r.v)
                at = np.flatnonzero((count > 0) & (p > q))
                if len(at):
                    value = difference(p[at], q[at])
                    least = np.partition(value, len(value) - top)[len(value) - top] if len(value) > top else 0
                    at, value = at[value >= least], value[value >= least]  # ties of the last are settled below
                    raw = own.blob.tobytes()
                    keys = [raw[a:e].decode() for a, e in zip(own.begins[at].tolist(), own.ends[at].tolist(), strict=True)]
                    order = sorted(range(len(at)), key=lambda i: (-value[i], keys[i].encode()))[:top]
                    yield pd.DataFrame({"lang": r.lang, "source": r.source, "item": [keys[i] for i in order], "value": value[order]})

    totals = slots.where("source is null").select("lang", "shard", F.col("at").alias("all_at"), F.col("n").alias("all_n"))
    n = sizes.select("lang", "source", F.col("n").alias("size"), "v")
    whole = sizes.groupBy("lang").agg(F.sum("n").alias("all_size"))
    rows = slots.where("source is not null").select("lang", "source", "shard", "at", "n")
    rows = rows.join(n, ["lang", "source"]).join(whole, "lang").join(totals, ["lang", "shard"]).join(made.select("lang", "shard", "hash"), ["lang", "shard"])
    return rows.mapInPandas(run, "lang string, source string, item string, value long")


def pair_values(slots: DataFrame, made: DataFrame, sizes: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language), value: f summed over the kept terms."""
    numbered = sizes.select("lang", "source", "n", "v", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("i"))
    numbered = numbered.withColumn("block", F.floor(F.col("i") / SOURCES).cast("int"))
    blocks = numbered.groupBy("lang", "block").agg(F.sort_array(F.collect_list(F.struct("i", "source", "n"))).alias("members"), F.max("v").alias("v"))  # SOURCES at most
    pairs = blocks.alias("a").join(blocks.alias("b"), F.expr("a.lang = b.lang AND a.block <= b.block"))
    pairs = pairs.select("a.lang", F.col("a.block").alias("lo"), F.col("b.block").alias("hi"), F.col("a.members").alias("first"), F.col("b.members").alias("second"), "a.v")
    tasks = made.select("lang", "shard", "keys").join(pairs, "lang")  # each shard with each pair of blocks
    own = slots.where("source is not null").join(numbered.select("lang", "source", "i", "block"), ["lang", "source"])
    per_block = own.groupBy("lang", "shard", "block").agg(F.collect_list(F.struct("i", "at", "n")).alias("rows"))  # SOURCES rows at most
    left = per_block.select("lang", "shard", F.col("block").alias("lo"), F.col("rows").alias("lo_rows"))
    right = per_block.select("lang", "shard", F.col("block").alias("hi"), F.col("rows").alias("hi_rows"))
    full = tasks.join(left, ["lang", "shard", "lo"], "left").join(right, ["lang", "shard", "hi"], "left")

    def run(batches):
        for b in batches:
            for r in b.itertuples(index=False):

                def shares(members, rows):
                    """Rows of p, which is the same for all terms that a source doesn't have."""
                    found = {x["i"]: x for x in (rows if rows is not None else [])}
                    return [share(_dense(found[m["i"]]["at"], found[m["i"]]["n"], r.keys) if m["i"] in found else np.zeros(r.keys, np.int64), m["n"], r.v) for m in members]

                lo = shares(r.first, r.lo_rows)
                hi = lo if r.lo == r.hi else shares(r.second, r.hi_rows)
                out = []
                for m, p in zip(r.first, lo, strict=True):
                    for k, q in zip(r.second, hi, strict=True):
                        if m["i"] < k["i"]:
                            square = (p - q) * (p - q)
                            out += [(r.lang, m["source"], k["source"], int((square // q).sum())), (r.lang, k["source"], m["source"], int((square // p).sum()))]
                if out:
                    yield pd.DataFrame(out, columns=["lang", "source", "item", "value"])

    found = full.mapInPandas(run, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    a, b = sizes.select("lang", "source"), sizes.select("lang", F.col("source").alias("item"))
    every = a.join(b, "lang").where("source <> item")  # what is asked for: each source with each other one of its language
    return every.join(found, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0)))


def ranked(values: DataFrame, part: str, top: int | None = None) -> DataFrame:
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = values.withColumn("rank", F.row_number().over(by))
    return (out if top is None else out.where(F.col("rank") <= top)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, shard_keys: int = SHARD_KEYS, broadcast: int = BROADCAST) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value long, rank int of docs(lang, source, text)."""
    spark = docs.sparkSession
    importable(spark)
    kept = Saved(kept_terms(docs, min_docs))
    v = kept.df.groupBy("lang").agg(F.count("*").alias("v"))
    shards = {r.lang: max(1, -(-r.v // shard_keys)) for r in v.collect()}  # one number per language
    made = Saved(perfect_hashes(kept.df, shards)).df
    size = made.agg(F.sum(F.length("hash"))).first()[0] or 0
    if size <= broadcast:
        sent, tasks = _counted(docs, made, shards), docs.rdd.getNumPartitions()
    else:
        sent, tasks = _dealt(docs, made, shards), SALTS
    groups = Saved(_summed(sent, tasks)).df
    whole = groups.withColumn("task", F.pmod(F.xxhash64("source"), F.lit(FAN * FAN)).cast("int")).withColumn("source", F.lit(None).cast("string"))
    names = _plain(docs).select("lang", "source").distinct()
    slots = Saved(groups.unionByName(_summed(whole, FAN * FAN if names.count() > FAN else 1))).df
    sums = spark.sql("SELECT lang, source, sum(n) AS n FROM {counts} GROUP BY lang, source", counts=_sizes(slots))
    sizes = Saved(names.join(sums, ["lang", "source"], "left").join(v, "lang", "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"))).df
    kept.drop()
    pair = ranked(pair_values(slots, made, sizes), "pair")
    return pair.unionByName(ranked(term_values(slots, made, sizes, top), "term", top))


def _sizes(slots: DataFrame) -> DataFrame:
    """lang, source, n: a group's counts in each shard."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"lang": b.lang, "source": b.source, "n": [int(np.frombuffer(x, "<i8").sum()) for x in b.n]})

    return slots.where("source is not null").select("lang", "source", "n").mapInPandas(run, "lang string, source string, n long")
