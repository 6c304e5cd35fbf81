"""Whitening, id files and the divergence audit against plain versions, and their defined cases."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pixeltide.llm import common, divergence, idfiles, queries, whitening
from tests.conftest import DATA
from tests.llm.test_operators import DOCS, ODD

# --- whitening

VECTORS = "vec_id long, embedding array<float>, whitened string, row string"


def vectors(spark, rows, kind=VECTORS):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "z", "z") for i, v in rows], kind)


def orthonormal(rng, d):
    q = np.linalg.qr(rng.standard_normal((d, d)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ (1.5 * np.eye(d, dtype=np.longdouble) - 0.5 * (q.T @ q))
    return q


@pytest.mark.parametrize("values, exact", [(np.linspace(1, 100, 40), 1e-15), (np.r_[10, 10 - 1e-7, 10 - 2e-7, 5, 5 - 1e-6, np.linspace(0, 1, 30)], 1e-10), (np.r_[1e6, 1e6 - 1, 1e6 - 1.001, np.linspace(0, 1e-3, 20)], 1e-10), ([3.0, 1.0], 1e-15), ([2.0], 1e-15)])
def test_eigenvectors_to_double_precision(values, exact):
    values = np.sort(np.array(values, np.longdouble))[::-1]
    q = orthonormal(np.random.default_rng(len(values)), len(values))
    a = (q * values) @ q.T
    e, x = whitening.eigen((a + a.T) / 2)
    assert np.abs(e - values).max() <= 1e-14 * values[0]
    few = slice(0, 4)
    assert np.abs(x * np.sign((x * q).sum(0)) - q)[:, few].max() < exact
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-14


def test_equal_and_zero_eigenvalues_keep_an_orthonormal_basis():
    q = orthonormal(np.random.default_rng(3), 12)
    values = np.array([5, 5, 5, 2, 2, 1, 0, 0, 0, 0, 0, 0], np.longdouble)
    a = (q * values) @ q.T
    e, x = whitening.eigen((a + a.T) / 2)
    assert np.allclose(e, values.astype(float), atol=1e-14) and np.abs(x.T @ x - np.eye(12)).max() < 1e-14
    assert np.abs(a.astype(float) @ x - x * e).max() < 1e-13
    assert whitening.eigen(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]


def test_sums_are_exact_beyond_64_bits():
    rng = np.random.default_rng(0)
    for size in (100, 1 << 30, 1 << 45):
        y = rng.integers(-size, size, (50, 3))
        parts = whitening.products(y) + whitening.products(y)
        big = y.astype(object)
        assert (whitening.whole(parts) == 2 * (big.T @ big)).all()


def test_query_whitens_the_table(spark):
    table = common.table(spark, DATA, "embeddings")
    x = {r.vec_id: np.floor(256 * np.array(r.embedding, float)).astype(np.int64) for r in table.collect()}
    fit = np.unique(np.stack(list(x.values())), axis=0)
    n, s = len(fit), fit.sum(0)
    c = fit - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    got = queries.QUERIES["op11_embedding_whitening"](spark, DATA).collect()
    assert got[0].asDict().keys() == {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}
    assert len(got) == 4 * len(x) and {r.n for r in got} == {n} and {r.component for r in got} == {1, 2, 3, 4}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-12
    sign = {}
    for r in got:
        k = r.component - 1
        want = (x[r.vec_id] - s / n) @ v[:, k] / np.sqrt(e[k])
        sign.setdefault(k, np.sign(want * r.whitened))
        assert r.whitened * sign[k] == pytest.approx(want, abs=1e-9) and r.explained == pytest.approx(e[k] / e.sum(), rel=1e-9)
        assert r.deviation == int(((n * x[r.vec_id].astype(object) - s) ** 2).sum())


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1, 2]), (2, [1, 2]), (None, [3, 1]), (4, None), (5, []), (6, [nan, 1]), (7, [1, inf]), (8, [None, 1]), (9, [1, 2, 3]), (10, [1e30, 1]), (11, [-0.0, 0.0])]
    t = vectors(spark, rows)
    model = whitening.fit(t)
    assert (model.n, model.dim) == (3, 2)
    done = whitening.apply(t, model)
    assert done.columns == ["vec_id", "embedding", "row", "whitened", "deviation"] and sorted(r.vec_id or 0 for r in done.collect()) == [0, 1, 2, 11]
    assert {r.row for r in done.collect()} == {"z"}
    got = whitening.components(t, model, "vec_id").collect()
    assert len(got) == 8 and got[0].identity_error < 1e-12
    one = whitening.components(t.where("vec_id in (1, 2)"), whitening.fit(t.where("vec_id in (1, 2)")), "vec_id").collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None)] * 4
    none = t.limit(0)
    assert whitening.fit(none) is None and whitening.components(none, None, "vec_id").count() == 0
    assert whitening.components(t, None, "vec_id").columns == whitening.components(t, model, "vec_id").columns


# --- id files


@pytest.mark.parametrize("n, most", [(1, 20), (2, 20), (5, 3), (300, 9), (3000, 20)])
def test_code_lengths(n, most):
    rng = np.random.default_rng(n)
    counts = rng.zipf(1.4, n) % 10_000
    counts[: min(n, 2)] = 7
    bits = idfiles.code_lengths(counts, most)
    used = counts > 0
    assert ((bits > 0) == used).all() and bits.max() <= most and (0.5 ** bits[used]).sum() <= 1
    if most == 20 and n > 2:  # without the limit it is Huffman's total
        import heapq

        heap = [(int(c), i) for i, c in enumerate(counts[used])]
        heapq.heapify(heap)
        total = 0
        for k in range(len(heap) - 1):
            a, b = heapq.heappop(heap)[0], heapq.heappop(heap)[0]
            total += a + b
            heapq.heappush(heap, (a + b, n + k))
        assert int((bits * counts).sum()) == total or bits.max() == most
    codes = idfiles.Codes(bits)
    ids = rng.choice(np.flatnonzero(used), 1001)
    for block in (1, 7, 256):
        payload, offsets = codes.encode(ids, block)
        assert (codes.decode(payload, offsets, len(ids), block) == ids).all()
    (a, b), empty = codes.encode(ids[:300], 64), codes.encode(ids[:0], 64)
    assert [x.tolist() for x in codes.decode_all([(a, b, 300), (*empty, 0), (a, b, 300)], 64)] == [ids[:300].tolist(), [], ids[:300].tolist()]


def test_length_limit_is_the_best_one():
    """Against all lengths of a small alphabet."""
    import itertools

    counts = np.array([1, 2, 4, 8, 16, 32])
    for most in (3, 4, 5):
        got = int((idfiles.code_lengths(counts, most) * counts).sum())
        assert got == min(sum(b * c for b, c in zip(x, counts, strict=True)) for x in itertools.product(range(1, most + 1), repeat=6) if sum(0.5**b for b in x) <= 1)
    with pytest.raises(ValueError):
        idfiles.code_lengths(np.ones(9), 3)


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(idfiles.TOKENIZER))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_ids_are_the_library_s():
    rng = np.random.default_rng(5)
    t = idfiles.tokens(public_tokenizers.path(idfiles.TOKENIZER))
    alphabets = ["aA'sétİΣ̸́= \t\n\x1c\x85\xa0 1²,.!ŉǅ漢　ｱẞ<|>😀", "aAséÉt= \t\n1,.!žŸı"]
    texts = ["".join(rng.choice(list(alphabets[k % 2]), rng.integers(0, 14))) for k in range(4000)]
    texts += ["<|endoftext|> it's We'LL", "".join(map(chr, range(0x20, 0x180))), "don't 's's", "x" * 5000]
    assert [np.frombuffer(t.ids(x), t.wide).tolist() for x in texts] == library(texts)


def test_files_hold_the_ids_in_order(spark):
    docs = common.table(spark, DATA, "documents")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    want, start = [], 0
    for (d, _), ids in zip(rows, library([t for _, t in rows]), strict=True):
        ids = np.array([*ids, 2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = queries.QUERIES["op12_token_files"](spark, DATA)
    assert sorted(map(tuple, got.collect())) == want and got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_small_segments_ranges_and_damage(spark):
    docs = common.table(spark, DATA, "documents").where("doc_id < 60")
    path, tokens = common.new_path(spark), idfiles.tokenise(docs)
    idfiles.write(tokens, path, "<u2", segment=1000, block=64)
    whole = idfiles.read(spark, path, block=64).orderBy("start").collect()
    assert len(whole) == 60 and spark.read.parquet(f"{path}/segments").count() > 10
    ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in whole])
    assert [r.start for r in whole] == (np.cumsum([r.n_tokens for r in whole]) - [r.n_tokens for r in whole]).tolist()
    for a, b in ((0, len(ids)), (777, 5003), (64, 128), (len(ids) - 1, len(ids) + 9)):
        got = idfiles.read_range(spark, path, a, b, block=64).orderBy("start").collect()
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in got]).tolist() == ids[a:b].tolist()
    broken = common.new_path(spark)
    spark.read.parquet(f"{path}/codes").write.parquet(f"{broken}/codes")
    spark.read.parquet(f"{path}/segments").withColumn("crc", F.col("crc") + F.when(F.col("segment") == 1, 1).otherwise(0)).write.parquet(f"{broken}/segments")
    with pytest.raises(Exception, match="doesn't decode"):
        idfiles.read(spark, broken, block=64).count()


def test_files_of_odd_rows(spark):
    odd = spark.createDataFrame(ODD, DOCS).withColumn("ids", F.lit("z")).withColumn("part", F.lit("z"))
    path = common.new_path(spark)
    idfiles.write(idfiles.tokenise(odd), path, "<u2")
    got = idfiles.read(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in ODD), key=lambda d: (d is not None, d))
    want = Counter((d, tuple([*ids, 2])) for (d, *_), ids in zip(ODD, library([r[1] or "" for r in ODD]), strict=True))
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    none = common.new_path(spark)
    idfiles.write(idfiles.tokenise(odd.limit(0)), none, "<u2")
    assert idfiles.read(spark, none).count() == 0 and idfiles.read_range(spark, none, 0, 5).count() == 0


# --- divergence


def test_perfect_hash_is_minimal_and_tells_strangers():
    for n in (0, 1, 2, 5000):
        keys = [f"k{i}é".encode() for i in range(n)]
        p = divergence.Perfect.load(divergence.Perfect.build(keys).dump())
        assert sorted(p.slots(keys, divergence.hashes(keys)).tolist()) == list(range(n)) and sorted(p.keys()) == sorted(keys)
        others = [f"x{i}".encode() for i in range(3000)] + [k + b"x" for k in keys[:50]] + [b"x" + k[1:] for k in keys[:50]]
        assert (p.slots(others, divergence.hashes(others)) == -1).all()


def test_shares_are_exact():
    rng = np.random.default_rng(0)
    for most in (10, 1 << 40):
        count = rng.integers(0, most, 200)
        n, v = int(count.sum()), 200
        assert divergence.share(count, n, v).tolist() == [1 + 10**9 * (int(c) + 1) // (n + v) for c in count]


def sql_rows(docs):
    import pandas as pd

    c = duckdb.connect()
    c.register("documents", pd.DataFrame([(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()], columns=["doc_id", "text", "lang", "source"]))
    return Counter(tuple(r) for r in c.execute(queries.SQL["op13_source_divergence"] + " ORDER BY 1, 2, 3, rank").fetchall())


@pytest.mark.parametrize("how", [{}, {"shard_keys": 50}, {"broadcast": 0, "shard_keys": 700}])
def test_audit_by_any_way(spark, monkeypatch, how):
    docs = common.table(spark, DATA, "documents").where("doc_id < 120")
    if "shard_keys" in how:
        monkeypatch.setattr(divergence, "SOURCES", 3)
        monkeypatch.setattr(divergence, "FAN", 2)
    got = divergence.audit(docs, **how)
    assert Counter(map(tuple, got.collect())) == sql_rows(docs) and got.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_audit_of_odd_rows(spark):
    rows = [*ODD, *[(20 + i, "the cat sat ÉCOLE École école", lang, source) for i, (lang, source) in enumerate([("en", "s"), ("en", None), ("en", "t"), (None, "s"), (None, None), ("xx", "only")])]]
    odd = spark.createDataFrame(rows, DOCS).withColumn("term", F.lit("z")).withColumn("shard", F.lit("z"))
    assert Counter(map(tuple, divergence.audit(odd).collect())) == sql_rows(odd)
    assert divergence.audit(odd.limit(0)).count() == 0
