"""Token ids in files, by canonical length-limited Huffman codes of the global counts.

A directory has two Parquet tables, written by Spark's committers, so files of lost or repeated tasks never show:

* `codes` (id, bits): the code length of each id that occurs. Codes are canonical: they count up in the order of (bits, id),
  so the lengths say it all. No code is longer than MAX_BITS.
* `segments`, one row each: part and segment number it in the order of documents; doc_id and n are arrays, an entry for
  each of its documents in order; ids is their number of ids, before that of the part's segments before it; payload holds the codes, highest bit first; offsets is the
  bit at which each block of BLOCK ids begins (little-endian unsigned 64-bit), so a block is decoded without those before
  it; crc is the crc32 of the ids as little-endian unsigned 32-bit integers. A segment closes after SEGMENT ids; a document
  is never split.

Documents are in ascending order of doc_id (nulls first, then by their ids), dealt to parts by range; `part` follows it.
Decoding looks the next MAX_BITS bits up in a table of all codes, for all blocks of a segment side by side. A reader that
wants ids from a place on (`read_range`) finds its segments by the parts' totals and decodes only the blocks it needs.

Ids are counted in the tasks and summed; only one count per id of the vocabulary and one total per part reach the driver. The
ids are written once before, since they are read twice.

Defined cases: a null or empty text has the end id alone; repeated rows and ids are documents each; rows with a null
doc_id come first; an empty table gives files without segments; other columns are left out. A payload that doesn't decode
to its crc raises an error.
"""

from __future__ import annotations

import functools
import re
import zlib
from itertools import islice

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixeltide.llm.bpe import parts
from pixeltide.llm.common import Saved, ids_in, ids_out, importable

TOKENIZER, END = "word_bpe_49k.json", 2
MAX_BITS, BLOCK, SEGMENT = 20, 256, 1 << 18
TOGETHER = 8  # segments that are decoded side by side
PIECES, WORDS = 800_000, 200_000  # that a worker remembers

# --- ids of texts


_LETTERS = "a-zß-öø-įı-ž"
_PLAIN = "!-&(-~À-ÖØ-öø-įı-ž"  # no apostrophe, nothing that NFC changes or that lower-cases to two


class Tokens:
    """Ids by the tokenizers library, piece by piece: its normaliser and its pre-tokens never look past white space.

    Words of plain letters and marks are cut at the library's own pre-token borders, so that a word with a comma and
    the word alone share a piece, which goes to the library's model; any other word is encoded whole.
    """

    plain = re.compile(rf"[{_PLAIN}]+").fullmatch
    all_plain = re.compile(rf"[{_PLAIN} \t-\r]+").fullmatch
    cut = re.compile(rf"[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9 \t-\r]+").findall

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model
        self.wide = id_type(self.tokenizer.get_vocab_size())
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        letters = [chr(c) for c in range(0xDF, 0x180) if re.fullmatch(f"[{_LETTERS}]", chr(c))]
        self.written = str.maketrans({c: self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters})  # as the model has them

    def _piece(self, piece: str) -> bytes:
        return np.array([t.id for t in self.model.tokenize(piece.translate(self.written))], self.wide).tobytes()

    def _known(self, held: dict[str, bytes], items: list[str], make) -> list[bytes]:
        got = list(map(held.get, items))
        if not all(got):
            for k, x in enumerate(got):
                if x is None:
                    x = held.get(items[k])
                    got[k] = held[items[k]] = make(items[k]) if x is None else x
        return got

    def _word(self, word: str) -> bytes:
        if self.plain(word):
            return b"".join(self._known(self.pieces, self.cut(word.lower()), self._piece))
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.wide).tobytes()

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        for held, most in ((self.pieces, PIECES), (self.words, WORDS)):
            if len(held) > most:  # the older half goes
                for k in list(islice(held, most // 2)):
                    del held[k]
        if self.all_plain(text):
            return b"".join(self._known(self.pieces, self.cut(text.lower()), self._piece))
        return b"".join(self._known(self.words, [w for w in re.split(r"[ \t-\r]+", text) if w], self._word))


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


@functools.lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def tokenise(docs: DataFrame, path: str | None = None, end: int | None = END) -> DataFrame:
    """doc_id, ids binary (little-endian unsigned, 16 bits while the vocabulary has no more) of docs(doc_id, text)."""
    path = path or public_tokenizers.path(TOKENIZER)
    importable(docs.sparkSession)

    def run(batches):
        t = tokens(path)
        last = b"" if end is None else np.array([end], t.wide).tobytes()
        for part in parts(batches):
            yield pd.DataFrame({"doc_id": part.doc_id.array, "ids": [t.ids(x) + last for x in part.text]})

    return ids_out(docs.select(ids_in(), "text").mapInPandas(run, "doc_id long, ids binary"))


# --- codes


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Bits of each symbol (0 where its count is), at most `most`, of the least total: package-merge."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) > 1 << most:
        raise ValueError(f"{len(used)} symbols don't fit codes of {most} bits")
    if len(used) < 2:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(object) if counts.sum() > 1 << 40 else counts[order].astype(np.int64)
    row, levels = leaf, []  # levels: for each row but the first, which of its items are leaves, in order
    for _ in range(most - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaf, pairs])
        sort = np.argsort(both, kind="stable")
        row = both[sort]
        levels.append(sort < len(leaf))
    take = 2 * len(leaf) - 2
    bits = np.zeros(len(leaf), np.int64)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        bits[:leaves] += 1
        take = 2 * (take - leaves)
    bits[:take] += 1
    out[order] = bits
    return out


class Codes:
    """Canonical codes of lengths by id (0: no code), a decoding table over all windows of as many bits as the longest has."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.short = bits.astype(np.uint64), bits.astype(np.int8)
        used = np.flatnonzero(bits)
        order = used[np.lexsort((used, bits[used]))]
        self.longest = int(bits.max(initial=0))
        spans = np.uint64(1) << (np.uint64(self.longest) - self.bits[order])  # windows of each code
        begins = np.cumsum(spans) - spans
        self.code = np.zeros(len(bits), np.uint64)
        self.code[order] = begins >> (np.uint64(self.longest) - self.bits[order])
        self.order, self.spans = order, spans

    @functools.cached_property
    def table(self) -> np.ndarray:
        """id << 5 | bits for each window."""
        kind = np.uint32 if len(self.bits) < 1 << 27 else np.uint64
        t = np.zeros(1 << self.longest, kind)
        filled = np.repeat((self.order.astype(np.uint64) << np.uint64(5) | self.bits[self.order]).astype(kind), self.spans.astype(np.int64))
        t[: len(filled)] = filled
        return t

    def encode(self, ids: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
        """The codes one after the other, padded to whole bytes, and the bit at which each block begins."""
        if not len(ids):
            return b"", np.zeros(0, np.uint64)
        bits, code = self.short[ids], self.code[ids]
        if not bits.all():
            raise ValueError("an id without a code")
        end = np.cumsum(bits, dtype=np.int64)
        begin = end - bits
        word = begin >> 6
        left = ((word + 1) << 6) - end  # bits left in the word; negative: the code goes on in the next
        over = np.flatnonzero(left < 0)
        here = code << left.view(np.uint64)
        here[over] = code[over] >> (-left[over]).astype(np.uint64)
        words = np.zeros(int(word[-1]) + 2, np.uint64)
        first = np.append(0, np.flatnonzero(word[1:] != word[:-1]) + 1)  # codes are shorter than words, so each has one
        words[word[first]] = np.bitwise_or.reduceat(here, first)
        words[word[over] + 1] |= code[over] << (64 + left[over]).astype(np.uint64)
        return words.astype(">u8").tobytes()[: (int(end[-1]) + 7) // 8], begin[::block]

    def decode(self, payload: bytes, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
        """n ids (uint32) from the blocks that begin at the bits `offsets`."""
        return self.decode_all([(payload, offsets, n)], block)[0]

    def decode_all(self, runs: list[tuple[bytes, np.ndarray, int]], block: int = BLOCK) -> list[np.ndarray]:
        """decode for several runs (payload, offsets, n); the blocks of all of them step together."""
        pad = bytes(block * 4 + 8)  # what a short last block reads beyond its end
        sizes = np.array([len(p) + len(pad) for p, _, _ in runs], np.int64)
        starts = np.cumsum(sizes) - sizes
        at = np.concatenate([o.astype(np.int64) + 8 * s for (_, o, _), s in zip(runs, starts, strict=True)])
        raw = np.frombuffer(b"".join(x for p, _, _ in runs for x in (p, pad)), np.uint8).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        table, down, last = self.table, np.uint32(32 - self.longest), len(window) - 1
        id_bits, bits = table.dtype.type(5), table.dtype.type(31)
        out = np.empty((block if len(at) else 0, len(at)), np.uint32)
        for k in range(len(out)):
            word = window[np.minimum(at >> 3, last)]
            word <<= (at & 7).astype(np.uint32)
            word >>= down
            got = table[word]
            np.right_shift(got, id_bits, out=out[k], casting="unsafe")
            got &= bits
            at += got
        rows = np.ascontiguousarray(out.T)
        ends = np.cumsum([len(o) for _, o, _ in runs]).tolist()
        return [rows[e - len(o) : e].ravel()[:n] for (_, o, n), e in zip(runs, ends, strict=True)]


def count_ids(held: DataFrame, wide: str) -> np.ndarray:
    """The count of each id from 0 on."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            n = np.bincount(np.frombuffer(b"".join(b.ids), wide))
            if len(n) > len(total):
                n[: len(total)] += total
                total = n
            else:
                total[: len(n)] += n
        at = np.flatnonzero(total)
        yield pd.DataFrame({"id": at, "n": total[at]})

    rows = held.select("ids").mapInPandas(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # one row per id of the vocabulary
    out = np.zeros(int(rows.id.max()) + 1 if len(rows) else 0, np.int64)
    out[rows.id] = rows.n
    return out


# --- files

KIND = "part int, segment int, before long, ids long, doc_id array<long>, n array<long>, offsets binary, payload binary, crc long"


def write(texts: DataFrame, path: str, wide: str, max_bits: int = MAX_BITS, segment: int = SEGMENT, block: int = BLOCK) -> None:
    """Writes texts(doc_id, ids), as tokenise makes them, to a new directory."""
    spark = texts.sparkSession
    saved = Saved(texts.select("doc_id", "ids"))
    bits = code_lengths(count_ids(saved.df, wide), max_bits)
    codes = spark.createDataFrame(pd.DataFrame({"id": np.flatnonzero(bits), "bits": bits[bits > 0].astype(np.int32)}), "id long, bits int")
    codes.coalesce(1).write.option("parquet.block.size", 1 << 24).parquet(f"{path}/codes")
    shared = spark.sparkContext.broadcast(bits)  # one number per id of the vocabulary

    def run(batches):
        made, number, place = Codes(shared.value), 0, TaskContext.get().partitionId()
        docs, raw, held, before = [], [], 0, 0

        def close():
            nonlocal number, held, before
            ids = np.frombuffer(b"".join(raw), wide)
            payload, offsets = made.encode(ids, block)
            size = np.dtype(wide).itemsize
            row = (place, number, before, len(ids), docs.copy(), [len(x) // size for x in raw], offsets.astype("<u8").tobytes(), payload, zlib.crc32(ids.astype("<u4").tobytes()))
            number, held, before = number + 1, 0, before + len(ids)
            docs.clear()
            raw.clear()
            return pd.DataFrame([row], columns=["part", "segment", "before", "ids", "doc_id", "n", "offsets", "payload", "crc"])

        for b in batches:
            for d, null, x in zip(b.doc_id, b.null, b.ids, strict=True):
                docs.append(None if null else d)
                raw.append(x)
                held += len(x) // np.dtype(wide).itemsize
                if held >= segment:
                    yield close()
        if docs:
            yield close()

    rows = saved.df.withColumn("tie", F.xxhash64("ids"))
    dealt = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "ids")
    dealt.select(ids_in(), F.col("doc_id").isNull().alias("null"), "ids").mapInPandas(run, KIND).write.option("compression", "zstd").parquet(f"{path}/segments")
    shared.destroy()
    saved.drop()


def _codes(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.schema("id long, bits int").parquet(f"{path}/codes").toPandas()
    bits = np.zeros(int(rows.id.max()) + 1 if len(rows) else 0, np.int64)
    bits[rows.id] = rows.bits
    return bits


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with `start`: the ids in all segments before. What precedes a part is a number per part, at the driver."""
    rows = spark.read.schema(KIND).parquet(f"{path}/segments")
    ends = rows.groupBy("part").agg(F.sum("ids").alias("n")).orderBy("part").toPandas()
    before = spark.createDataFrame(pd.DataFrame({"part": ends.part, "all_before": (ends.n.cumsum() - ends.n).astype("int64")}), "part int, all_before long")
    return rows.join(F.broadcast(before), "part").withColumn("start", F.col("all_before") + F.col("before")).drop("all_before")


def read(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """doc_id, start long, n_tokens long, ids binary (little-endian unsigned 32-bit integers) of each document."""
    importable(spark)
    shared = spark.sparkContext.broadcast(_codes(spark, path))

    def run(batches):
        made = Codes(shared.value)
        for part in (list(b.iloc[k : k + TOGETHER].itertuples()) for b in batches for k in range(0, len(b), TOGETHER)):
            decoded = made.decode_all([(r.payload, np.frombuffer(r.offsets, "<u8"), r.ids) for r in part], block)
            for r, ids in zip(part, decoded, strict=True):
                raw = ids.astype("<u4", copy=False).tobytes()
                if zlib.crc32(raw) != r.crc:
                    raise ValueError(f"segment {r.segment} of part {r.part} doesn't decode to its crc")
                n = np.asarray(r.n, np.int64)
                end = np.cumsum(n)
                yield pd.DataFrame({"doc_id": r.doc_id, "start": r.start + end - n, "n_tokens": n, "ids": [raw[4 * (e - k) : 4 * e] for e, k in zip(end.tolist(), n.tolist(), strict=True)]})

    rows = segments(spark, path).withColumn("doc_id", F.transform("doc_id", lambda d: F.coalesce(d, F.lit(-(1 << 63)))))
    return ids_out(rows.mapInPandas(run, "doc_id long, start long, n_tokens long, ids binary"))


def read_range(spark: SparkSession, path: str, start: int, stop: int, block: int = BLOCK) -> DataFrame:
    """start long, ids binary: the ids from `start` to before `stop`, a row for each segment; other blocks aren't decoded."""
    importable(spark)
    shared = spark.sparkContext.broadcast(_codes(spark, path))

    def run(batches):
        made = Codes(shared.value)
        for b in batches:
            for r in b.itertuples():
                lo, hi = max(start - r.start, 0), min(stop - r.start, r.ids)
                first = lo // block
                offsets = np.frombuffer(r.offsets, "<u8")[first : -(-hi // block)]
                ids = made.decode(r.payload, offsets, min(len(offsets) * block, r.ids - first * block), block)
                yield pd.DataFrame({"start": [r.start + lo], "ids": [ids[lo - first * block : hi - first * block].astype("<u4").tobytes()]})

    rows = segments(spark, path).where((F.col("start") < stop) & (F.col("start") + F.col("ids") > start))
    return rows.mapInPandas(run, "start long, ids binary")


def digests(read_back: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32."""
    return read_back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
