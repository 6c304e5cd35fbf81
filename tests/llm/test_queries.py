"""The registered corpus queries against their SQL, and the pipeline against a brute-force version."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pixeltide.llm import bpe, decontam, quality, queries
from pixeltide.llm.common import fold, table
from tests.conftest import DATA
from tests.llm.test_operators import DOCS, ODD, cleaned, linked_by_hand


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = queries.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    cur = c.execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(str(r[names.index(k)]) for k in columns) for r in cur.fetchall())
    assert sorted(tuple(str(r[k]) for k in columns) for r in got.collect()) == want


def test_contract_columns(spark):
    want = {"op1": ["doc_id", "held_out", "lang_pred", "score"], "op4": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "op8": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"], "op9": ["doc_id", "held_out", "score", "predicted"]}
    for n, columns in want.items():
        name = next(k for k in queries.QUERIES if k.startswith(n + "_"))
        df = queries.QUERIES[name](spark, DATA)
        assert df.columns[: len(columns)] == columns and df.count() == table(spark, DATA, "documents").count()


def test_pipeline_against_brute_force(spark):
    docs = table(spark, DATA, "documents")
    model = quality.train(docs, table(spark, DATA, "labels"), fold(5) != 0)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = [(d, t) for d, t in rows if quality.score(quality.features(t.encode())[None, :], model)[0] >= quality.CUT]
    lines = [(d, t) for d, t, *_ in cleaned(kept)]
    groups = {d: c for d, _, c in linked_by_hand(lines, corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT)}
    alone = [(d, t) for d, t in lines if groups[d] == d]
    items = [decontam.plain_words(r.text.encode()) for r in table(spark, DATA, "benchmark").collect()]

    def leaks(text):
        w = decontam.plain_words(text.encode())
        ids = {x: i for i, x in enumerate(set(w))}
        passage = np.array([ids[x] for x in w])
        return any(len(passage) and decontam.align(np.array([ids.get(x, -1) for x in item]), passage)[0] >= 2 * len(item) * decontam.LEAK for item in items if len(set(item) & set(w)) * 2 >= len(set(item)))

    codec = bpe.codec(bpe.public_tokenizers.path(bpe.RANKS))
    want = sorted((d, codec.encode(t), hashlib.sha256(t.encode()).hexdigest()) for d, t in alone if not leaks(t))
    got = corpus_pipeline.run(spark, DATA)
    assert sorted((r.doc_id, bytes(r.ids), r.decoded_sha256) for r in got.collect()) == want
    assert len(want) < len(rows) and math.isclose(len(want), got.count())


def test_stages_on_odd_rows(spark):
    """Each stage by itself on null and blank texts, repeated rows, null ids, long texts and columns whose names it uses itself."""
    extra = ["n_lines", "n_dropped", "row", "class", "component_id", "score", "keys", "_id", "half", "quality"]
    odd = spark.createDataFrame([(*r, 7) for r in ODD], DOCS + ", n_chars int").select("*", *[F.lit("z").alias(c) for c in extra])
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, DATA)
        assert got.columns == odd.columns and stage(spark, odd.limit(0), DATA).count() == 0
        rows = got.collect()
        assert all(r.n_lines == r.quality == "z" for r in rows)
        if name != names[0]:
            assert sum(r.text is None for r in rows) == 1 and sum(r.doc_id is None for r in rows) == 1
            gone = {6} if name == names[2] else set()  # a copy of document 5
            assert sorted(r.doc_id or -1 for r in rows) == sorted(r[0] or -1 for r in ODD if r[0] not in gone)
    ids = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, odd, DATA).collect()}
    assert len(ids) == len({r[0] for r in ODD}) and ids[1].n_tokens == 0 and ids[1].decoded_sha256 == hashlib.sha256(b"").hexdigest()
