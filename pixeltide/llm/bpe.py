"""Byte-level BPE encoding and decoding by a hierarchical-bitmap rank queue.

Each match of the split pattern is encoded by itself. Its bytes form a linked list; a bucket per merge rank holds the
positions at which that merge may apply, and two levels of bitmaps tell which buckets are filled, so the next
rank is found by find-first-set. Entries go stale when a neighbour merges; they are skipped when they come up. A merge
costs O(1) bitmap steps however long the pre-token is.

Encoding has no shuffle. The distinct pre-tokens of a batch of texts that a worker doesn't remember share one queue, and
their ids are looked up after that. A worker remembers about CACHE pre-tokens of at most CACHE_CHARS characters each; when
there are more, the older half goes.

Defined cases: an empty table stays empty; a null or empty text has no tokens and decodes to no bytes; repeated rows are encoded each; other columns
are left out; every byte is a token, so any text round-trips.
"""

from __future__ import annotations

import base64
import functools
from itertools import islice

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixeltide.llm.common import ids_in, ids_out, importable

RANKS = "byte_bpe_50k.tiktoken"
CACHE, CACHE_CHARS = 600_000, 64
TOGETHER = 1 << 14  # bytes of pre-tokens in one queue, and one more pre-token


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """WIDE: bits of a bitmap word. Level 0 has a bit per rank, level 1 a bit per word of level 0."""

    WIDE = 256

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.ranks = load_ranks(path)
        n = max(self.ranks.values()) + 1
        pieces = [b""] * n
        for piece, i in self.ranks.items():
            pieces[i] = piece
        self.lens = np.fromiter(map(len, pieces), np.int64, n)
        self.starts = np.cumsum(self.lens) - self.lens
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.one = np.array([self.ranks[bytes([c])] for c in range(256)])
        self.two = np.array([self.ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)])
        self.find = regex.compile(pattern).findall
        self.low = [0] * (n // self.WIDE + 1)
        self.bit = [1 << i for i in range(max(self.WIDE, len(self.low)))]
        self.cache: dict[str, bytes] = {}

    def encode_pieces(self, items: list[bytes]) -> list[bytes]:
        """The ids of each pre-token (none is empty), as little-endian unsigned 32-bit integers.

        The pre-tokens lie one after the other and share one queue, no part crosses their edges.
        """
        text, get = b"".join(items), self.ranks.get
        n, raw = len(text), np.frombuffer(text, np.uint8).astype(np.int64)
        stops = np.cumsum(np.fromiter(map(len, items), np.int64, len(items)))
        edge = bytearray(n + 1)
        for at in (0, *stops.tolist()):
            edge[at] = 1
        first = np.append(self.two[raw[:-1] << 8 | raw[1:]], -1)
        first[stops - 1] = -1
        merge = first.tolist()  # the rank of the merge of a part with the next one, as it stands
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ids, alive = self.one[raw].tolist(), bytearray(b"\1") * n
        low, bit, top, n_ranks = self.low, self.bit, 0, len(self.lens)
        order = np.argsort(first, kind="stable")
        order = order[np.searchsorted(first[order], 0) :]
        found, at = np.unique(first[order], return_index=True)
        order, at = order.tolist(), [*at.tolist(), len(order)]
        buckets = {r: order[at[i] : at[i + 1]] for i, r in enumerate(found.tolist())}  # positions by rank
        for r in buckets:
            low[r >> 8] |= bit[r & 255]
            top |= bit[r >> 8]
        while top:
            a = (top & -top).bit_length() - 1  # find first set, from the top level down
            w = low[a]
            r = (a << 8) + (w & -w).bit_length() - 1
            w &= w - 1
            low[a] = w
            if not w:
                top &= top - 1
            bucket = buckets.pop(r)
            bucket.sort()
            for at, i in enumerate(bucket):
                if merge[i] != r:
                    continue  # stale
                j = after[i]
                k = after[j]
                after[i] = k
                ids[i] = r
                alive[j] = 0
                merge[j] = -1
                least = n_ranks
                if edge[k]:
                    merge[i] = -1
                else:
                    before[k] = i
                    s = merge[i] = get(text[i : after[k]], -1)
                    if s >= 0:
                        least = s
                        if s in buckets:
                            buckets[s].append(i)
                        else:
                            buckets[s] = [i]
                            low[s >> 8] |= bit[s & 255]
                            top |= bit[s >> 8]
                if not edge[i]:
                    h = before[i]
                    s = merge[h] = get(text[h:k], -1)
                    if s >= 0:
                        if s < least:
                            least = s
                        if s in buckets:
                            buckets[s].append(h)
                        else:
                            buckets[s] = [h]
                            low[s >> 8] |= bit[s & 255]
                            top |= bit[s >> 8]
                if least < r:  # a longer merge with a lower rank goes first; the rest of this bucket waits
                    if rest := bucket[at + 1 :]:
                        buckets[r] = rest + buckets.get(r, [])
                        low[r >> 8] |= bit[r & 255]
                        top |= bit[r >> 8]
                    break
        kept = np.flatnonzero(np.frombuffer(alive, np.uint8))
        out = np.array(ids, "<u4")[kept].tobytes()
        ends = (4 * np.searchsorted(kept, stops)).tolist()
        return [out[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def learn(self, missing: list[str]) -> None:
        """Puts the ids of pre-tokens in the cache: those that are one token at once, the others by the queue."""
        cache, get, rest, size = self.cache, self.ranks.get, [], 0
        for m in missing:
            piece = m.encode("utf-8", "surrogatepass")
            whole = get(piece)
            if whole is not None:
                cache[m] = whole.to_bytes(4, "little")
                continue
            rest.append((m, piece))
            size += len(piece)
            if size > TOGETHER:
                cache.update(zip([m for m, _ in rest], self.encode_pieces([p for _, p in rest]), strict=True))
                rest, size = [], 0
        if rest:
            cache.update(zip([m for m, _ in rest], self.encode_pieces([p for _, p in rest]), strict=True))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        cache = self.cache
        if len(cache) > CACHE:  # the older half goes
            for m in list(islice(cache, CACHE // 2)):
                del cache[m]
        flat, ends = [], [0]
        for t in texts:
            if t:
                flat += self.find(t)
            ends.append(len(flat))
        got = list(map(cache.get, flat))
        new = [i for i, x in enumerate(got) if x is None]
        missing = list({flat[i] for i in new})
        self.learn(missing)
        for i in new:
            got[i] = cache[flat[i]]
        for m in missing:
            if len(m) > CACHE_CHARS:
                del cache[m]
        return [b"".join(got[a:b]) for a, b in zip(ends, ends[1:], strict=False)]

    def decode_all(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each run of ids."""
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        lens = self.lens[flat]
        stops = np.cumsum(lens)
        where = np.arange(stops[-1] if len(stops) else 0) + np.repeat(self.starts[flat] - (stops - lens), lens)
        out = self.bytes[where].tobytes()
        ends = np.append(0, stops)[np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)].tolist() if ids else []
        return [out[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return self.decode_all([ids])[0]


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def parts(batches, rows: int = 200, size: int = 4 << 20):
    """Batches of at most `rows` rows and about `size` characters; a longer text goes by itself."""
    for b in batches:
        lens = b.text.str.len().fillna(0).to_numpy(np.int64) if len(b) else np.zeros(0, np.int64)
        at = 0
        while at < len(b):
            n = max(1, min(rows, int(np.searchsorted(np.cumsum(lens[at : at + rows]), size, "right"))))
            yield b.iloc[at : at + n]
            at += n


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens long, ids binary (little-endian unsigned 32-bit integers), for each row of docs(doc_id, text)."""
    path = path or public_tokenizers.path(RANKS)
    importable(docs.sparkSession)

    def run(batches):
        c = codec(path)
        for part in parts(batches):
            ids = c.encode_all(part.text.tolist())
            yield pd.DataFrame({"doc_id": part.doc_id.array, "n_tokens": [len(x) // 4 for x in ids], "ids": ids})

    return ids_out(docs.select(ids_in(), "text").mapInPandas(run, "doc_id long, n_tokens long, ids binary"))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds decoded binary, the bytes of the column ids; a null has none."""
    path = path or public_tokenizers.path(RANKS)
    importable(encoded.sparkSession)

    @F.pandas_udf("binary")
    def back(ids: pd.Series) -> pd.Series:
        return pd.Series(codec(path).decode_all([x or b"" for x in ids]), dtype=object)

    return encoded.withColumn("decoded", back("ids"))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """encode and decode in one pass over the texts: doc_id, n_tokens, ids, decoded."""
    path = path or public_tokenizers.path(RANKS)
    importable(docs.sparkSession)

    def run(batches):
        c = codec(path)
        for part in parts(batches):
            ids = c.encode_all(part.text.tolist())
            yield pd.DataFrame({"doc_id": part.doc_id.array, "n_tokens": [len(x) // 4 for x in ids], "ids": ids, "decoded": c.decode_all(ids)})

    return ids_out(docs.select(ids_in(), "text").mapInPandas(run, "doc_id long, n_tokens long, ids binary, decoded binary"))


def digests(coded: DataFrame) -> DataFrame:
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
