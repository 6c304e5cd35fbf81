"""The registered corpus queries: each operator over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixeltide.llm import bpe, decontam, divergence, e8dedup, idfiles, langid, linededup, lm, ngramjoin, quality, tokencount, urlfilter, whitening
from pixeltide.llm.common import fold, new_path, table


def held(n: int, remainder: int):
    return F.coalesce(fold(n) == remainder, F.lit(False))


def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, ~held(4, 2))
    return langid.predict(docs, model).select("doc_id", held(4, 2).alias("held_out"), "lang_pred", "score")


def op2_token_counts(spark, sf_dir):
    return tokencount.count(table(spark, sf_dir, "documents"))


def op3_url_filter(spark, sf_dir):
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op4_bpe(spark, sf_dir):
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents")))


def op5_line_dedup(spark, sf_dir):
    done = linededup.dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op6_ngram_jaccard(spark, sf_dir):
    return ngramjoin.components_of(table(spark, sf_dir, "documents"), k=3, percent=90)


def op7_decontamination(spark, sf_dir):
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_lm_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored, model = lm.score(docs, fold(7) != 2, fold(2) == 0)
    return scored.select("doc_id", held(7, 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


def op9_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~held(5, 0))
    scored = quality.rank(docs, model)
    return scored.select("doc_id", held(5, 0).alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op10_embedding_dedup(spark, sf_dir):
    return e8dedup.linked(table(spark, sf_dir, "embeddings"))


def op11_embedding_whitening(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.components(vectors, whitening.fit(vectors), "vec_id")


def op12_token_files(spark, sf_dir):
    path = new_path(spark)
    idfiles.write(idfiles.tokenise(table(spark, sf_dir, "documents")), path, idfiles.tokens(idfiles.public_tokenizers.path(idfiles.TOKENIZER)).wide)
    return idfiles.digests(idfiles.read(spark, path))


def op13_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_language_id, op2_token_counts, op3_url_filter, op4_bpe, op5_line_dedup, op6_ngram_jaccard, op7_decontamination, op8_lm_score, op9_quality, op10_embedding_dedup, op11_embedding_whitening, op12_token_files, op13_source_divergence)
}
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op3_url_filter": urlfilter.sql(),
    "op5_line_dedup": f"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, i, l[i] AS line, {LOWER.format("trim(l[i], chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')")} AS k
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM docs) x),
hot AS (SELECT k, max(doc_id) AS holder FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT doc_id, i, line, h.k IS NOT NULL AND h.holder <> doc_id AS gone FROM lines LEFT JOIN hot h USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op6_ngram_jaccard": f"""
WITH RECURSIVE d AS (SELECT doc_id, [x FOR x IN string_split_regex({LOWER.format("coalesce(text, '')")}, '[ \\t\\n\\x0B\\f\\r]+') IF x <> ''] AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0) x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.y) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN reach r ON r.x = d.doc_id GROUP BY d.doc_id, n.n""",
    "op10_embedding_dedup": """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS (SELECT vec_id, v FROM e WHERE len(v) > 0 AND len([x FOR x IN v IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN v IF x <> 0]) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
n AS (SELECT x, count(*) AS n FROM links GROUP BY x),
c AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, c.c = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.x = vec_id JOIN c ON c.x = vec_id""",
    "op13_source_divergence": f"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT d, lang, source, {LOWER.format("unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))")} AS term FROM docs),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT d) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM docs),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
size AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS size FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (size + v) AS p
  FROM g JOIN kept k USING (lang) JOIN size USING (lang, source) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (sum(sum(n)) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q FROM c GROUP BY lang, term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM term)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200""",
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)