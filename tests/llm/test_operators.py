"""Each corpus operator against a brute-force version on small inputs, and its defined cases."""

import base64
import hashlib
import itertools
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from pixeltide.llm import bpe, common, decontam, e8dedup, graph, langid, linededup, lm, ngramjoin, pieces, quality, tokencount, urlfilter

DOCS = "doc_id long, text string, lang string, source string"
#: Null and blank texts, ties, repeated rows, long texts, odd columns: every operator takes these.
ODD = [
    (1, None, None, None), (2, "", "en", None), (3, " \n\t ", None, "s"), (4, "a", "en", "s"), (5, "the cat sat on the mat", "en", "s"), (5, "the cat sat on the mat", "en", "s"),
    (6, "the cat sat on the mat", "en", None), (None, "no id at all here", "fr", "s"), (7, "line one is long enough to count\nsecond\nline one is long enough to count", "en", "s"),
    (8, "ünïcödé 漢字 😀 " * 40, "de", "s"), (9, "x" * 30000, None, "s"), (10, "word " * 6000, "en", "s"), (11, "\x00\x1f ", None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, DOCS)
    extra = ["n", "pos", "keys", "row", "token", "class", "copies", "score", "word", "half", "shard", "_id", "_text", "n_lines", "ids", "decoded", "part", "cells"]
    return df.select("*", *[F.lit("z").alias(c) for c in extra])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    return common.table(spark, sf_dir, "documents")


# --- 1 language


def words_by_hand(model, word):
    """log P(word) by all segmentations, for each language."""
    w = pieces.WORD_START + word
    known = {p: i for i, p in enumerate(model.pieces)}
    total = np.zeros((len(w) + 1, len(model.langs)))
    total[0] = 1
    for end in range(1, len(w) + 1):
        total[end] += total[end - 1] * math.exp(model.unseen)
        for begin in range(end):
            if (i := known.get(w[begin:end])) is not None:
                total[end] += total[begin] * np.exp(model.log[i])
    return np.log(total[-1])


def test_language_forward_sums_all_segmentations():
    m = langid.Model(public_tokenizers.path(langid.VOCABULARY), ["a", "b"])
    m.log = np.log(np.random.default_rng(0).dirichlet(np.ones(len(m.pieces)), 2).T + 1e-9)
    items = ["the", "there", "theory", "ünder", "漢字", "q"]
    assert np.allclose(m.words(items), [words_by_hand(m, w) for w in items])


def test_language_expected_counts_add_up():
    m = langid.Model(public_tokenizers.path(langid.VOCABULARY), ["a"])
    n = m.expected(["the", "cat"], np.array([0, 0]), np.array([2.0, 1.0]))
    lens = np.array([len(p) for p in m.pieces])
    assert (n[:, 0] * lens).sum() == pytest.approx(2 * 4 + 4, rel=1e-3)


def test_language_held_out_accuracy(corpus):
    learn = F.coalesce(common.fold(4) != 2, F.lit(True))
    model = langid.train(corpus, learn, per_lang=100)
    got = langid.predict(corpus, model).join(corpus.where(~learn).select("doc_id", "lang", "n_chars"), "doc_id").where("n_chars > 100")
    right = got.where("lang = lang_pred").count()
    assert right >= 0.97 * got.count() and got.where("score < 0 or score > 1").count() == 0


def test_language_odd_and_empty(odd, none):
    model = langid.train(odd)
    got = {(r.doc_id, r.lang_pred == "und", r.score == 0) for r in langid.predict(odd, model).collect()}
    assert {(1, True, True), (2, True, True), (3, True, True), (11, True, True), (4, False, False)} <= got
    assert langid.predict(none, langid.train(none)).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, langid.train(none)).collect()} == {"und"}


def test_language_of_documents_by_hand(spark):
    """Prediction from all segmentations of all words, and one round of maximisation from all segmentations."""
    rows = [(1, "the cat and the hat", "en"), (2, "der hut und der", "de"), (3, "und the", "de"), (4, "\u00bd \u00b2 \u2460 7", "en"), (5, "a\u00b2cat", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learn = F.col("doc_id") < 4
    start = langid.Model(public_tokenizers.path(langid.VOCABULARY), ["de", "en"])
    model = langid.train(df, learn, rounds=1)
    known = {p: i for i, p in enumerate(start.pieces)}
    n = np.full(start.log.shape, langid.SMOOTH)
    for _, t, lang in rows[:3]:
        k = start.langs.index(lang)
        for w in t.split():
            w = pieces.WORD_START + w
            ways = []  # (probability, pieces) of each segmentation

            def cut(at, p, own, w=w, ways=ways, k=k):
                if at == len(w):
                    ways.append((p, own))
                    return
                cut(at + 1, p * math.exp(start.unseen), own)
                for end in range(at + 1, len(w) + 1):
                    if (i := known.get(w[at:end])) is not None:
                        cut(end, p * math.exp(start.log[i, k]), [*own, i])

            cut(0, 1.0, [])
            total = sum(p for p, _ in ways)
            for p, own in ways:
                for i in own:
                    n[i, k] += p / total
    assert np.allclose(model.log, np.log(n / n.sum(0)), atol=1e-6)
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert (got[4].lang_pred, got[4].score) == ("und", 0.0)
    for d, words in ((1, ["the", "cat", "and", "the", "hat"]), (2, ["der", "hut", "und", "der"]), (5, ["a", "cat"])):
        x = np.log([2 / 3, 1 / 3]) + sum(words_by_hand(model, w) for w in words)
        p = np.exp(x - x.max()) / np.exp(x - x.max()).sum()
        assert got[d].lang_pred == model.langs[int(p.argmax())] and got[d].score == pytest.approx(p.max())


# --- 2 token counts


def test_token_counts_against_a_plain_viterbi(corpus, odd, monkeypatch):
    c = tokencount.counter(public_tokenizers.path(tokencount.VOCABULARY))
    vocab = pieces.vocabulary(public_tokenizers.path(tokencount.VOCABULARY))
    logs = tokencount.log_probs(len(vocab))
    known = {p: logs[i] for i, p in enumerate(vocab) if p}

    def plain(word):
        w = pieces.WORD_START + word
        best = [(0.0, 0)]
        for end in range(1, len(w) + 1):
            size = len(w[end - 1].encode())
            ways = [(-(best[end - 1][0] + size * tokencount.BYTE), best[end - 1][1] + size)]
            ways += [(-(best[b][0] + known[w[b:end]]), best[b][1] + 1) for b in range(max(0, end - 20), end) if w[b:end] in known]
            s, n = min(ways)
            best.append((-s, n))
        return best[-1]

    items = sorted({w for r in corpus.limit(20).collect() for w in r.text.split()}) + ["漢字😀", "a" * 50, "the", "them"]
    assert np.allclose(c.words(items), [plain(w) for w in items])
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in tokencount.count(odd).collect()}
    assert got[1] == got[2] == got[3] == (0, 0) and got[10][0] == 6000
    assert tokencount.count(odd.limit(0)).count() == 0
    monkeypatch.setattr(tokencount, "CHARS", 8)  # no trie of two texts
    assert {r.doc_id: (r.n_pretokens, r.n_tokens) for r in tokencount.count(odd).collect()} == got


# --- 3 URL filter

URLS = [None, "no scheme", "http://", "HTTPS://A.ORG/x", "http://x.example.org/es/1", "http://example.org/en/12", "http://example.org/en/2", "http://notexample.org", "http://b.com/fr/1?q=/de/", "http://b.com/de/2#x", "http://b.com/de", "ftp://org/://a"]


def test_url_parts_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r.page_id: r for r in urlfilter.judge(pages).collect()}
    assert len(got) == len(URLS)
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(len(URLS))] == [
        ("", "", None), ("", "", None), ("", "", None), ("a.org", "/x", "org/"), ("x.example.org", "/es/1", "example.org/es/"), ("example.org", "/en/12", "example.org/en/1"), ("example.org", "/en/2", "org/"),
        ("notexample.org", "", None), ("b.com", "/fr/1", "com/fr/"), ("b.com", "/de/2", "com/de/"), ("b.com", "/de", None), ("org", "/://a", "org/"),
    ]
    assert [got[i].verdict for i in (3, 4, 5, 8, 9)] == ["allow", "block", "block", "allow", "block"]


def test_url_templates_follow_their_labels(spark):
    rows = [f"http://h{k}.com/de/x/{i}" for k in range(3) for i in range(40)] + [f"http://h{k}.com/en/{i}" for k in range(3) for i in range(40)] + [f"http://g.net/en/{i}" for i in range(9)] + ["http://h1.com/de"] * 3
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = urlfilter.judge(pages)
    assert {r.verdict for r in got.where("host = 'g.net'").collect()} == {"allow"}
    assert {r.verdict for r in got.where("path = '/de'").collect()} == {"block"}
    assert urlfilter.judge(pages.limit(0)).count() == 0


def test_url_wildcards(spark):
    rows = [f"http://h.com/{a}/u{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200) for a in ("fr",)]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    made = dict(urlfilter.steps())
    leaf0 = spark.sql(made["leaf0"], judged=spark.sql(made["judged"], pages=pages))
    wild = spark.sql(made["wild2"], leaf1=leaf0)
    assert leaf0.count() == 200 and wild.first().wild


def parts_by_hand(url, rules):
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut].lower(), rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(r, v) for r, v in rules for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, *(max(fits, key=lambda x: len(x[0])) if fits else (None, None))


def url_verdicts_by_hand(urls, rules=urlfilter.RULES, depth=urlfilter.MOST):
    """The template tree in plain Python."""
    W = urlfilter.WEIGHT
    pages, leaf = [], {}
    for u in urls:
        host, path, rule, verdict = parts_by_hand(u, rules)
        segs = path.split("/")[1:]
        segs = [*segs[: depth - 1], *["/".join(segs[depth - 1 :])] * (len(segs) >= depth)]
        segs = tuple("".join("#" if a else "".join(b) for a, b in itertools.groupby(x, str.isdigit)) for x in [*segs, *[""] * (depth - len(segs))])
        pages.append((host, segs, verdict))
        n = leaf.setdefault((host, segs), [list(segs), 0, 0, 0])
        n[1] += 1
        n[2] += verdict is not None
        n[3] += verdict == "block"
    for d in range(depth):
        nodes = {}
        for (host, _), n in leaf.items():
            nodes.setdefault((host, *n[0][:d]), []).append(n)
        for ns in nodes.values():
            kinds = len({n[0][d] for n in ns})
            if kinds > urlfilter.MANY and sum(n[1] for n in ns) < urlfilter.FEW * kinds:
                for n in ns:
                    n[0][d] = "*"
    root = (sum(n[3] for n in leaf.values()) + 1) / (sum(n[2] for n in leaf.values()) + 2)
    out = {}

    def walk(keys, ns, above, d):
        if d == depth:
            out.update(dict.fromkeys(keys, above))
            return
        children = {}
        for k, n in zip(keys, ns, strict=True):
            children.setdefault(n[0][d], []).append((k, n))
        rated = {True: [], False: []}
        for t, own in children.items():
            lab, bad = sum(n[2] for _, n in own), sum(n[3] for _, n in own)
            if d and not t and not own[0][1][0][d - 1]:
                walk([k for k, _ in own], [n for _, n in own], above, d + 1)
                continue
            rate = (bad + W * above) / (lab + W)
            rated[lab > 0].append((rate, t, lab, bad, rate * (1 - rate) / (lab + W)))
        for group in rated.values():
            branches = []
            for x in sorted(group):
                if not branches or x[0] - branches[-1][-1][0] > urlfilter.Z * math.sqrt(x[4] + branches[-1][-1][4]):
                    branches.append([])
                branches[-1].append(x)
            for b in branches:
                purity = (sum(x[3] for x in b) + W * above) / (sum(x[2] for x in b) + W)
                for x in b:
                    walk([k for k, _ in children[x[1]]], [n for _, n in children[x[1]]], purity, d + 1)

    hosts = {}
    for k, n in leaf.items():
        hosts.setdefault(k[0], []).append((k, n))
    for own in hosts.values():
        lab, bad = sum(n[2] for _, n in own), sum(n[3] for _, n in own)
        walk([k for k, _ in own], [n for _, n in own], (bad + W * root) / (lab + W), 0)
    labelled = {h: sum(n[2] for _, n in own) for h, own in hosts.items()}
    return [v or ("block" if labelled[h] and out[h, s] >= urlfilter.PURE else "allow") for h, s, v in pages]


def test_url_tree_by_hand(spark, sf_dir):
    rng = np.random.default_rng(21)
    rules = [("a.com/x/", "block"), ("a.com/x/ok/", "allow"), ("b.com/p/q/r/s/t/u/ads/", "block"), ("b.com/p/q/r/s/t/u/ok/", "allow"), ("c.com/", "allow")]
    name = lambda: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, 3))
    urls = [f"http://a.com/{rng.choice(['x', 'x/ok', 'y', 'z'])}/{name()}/{rng.integers(99)}" for _ in range(300)]
    urls += [f"http://b.com/p/q/r/s/t/u/{rng.choice(['ads', 'ok', 'other'])}/{rng.integers(9)}" for _ in range(200)]
    urls += [f"http://{rng.choice(['c.com', 'd.net', 'B.com'])}/{'/'.join(str(x) for x in rng.integers(0, 3, rng.integers(0, 9)))}" for _ in range(200)] + URLS + ["http://b.com" + "/deep" * 30, "http://a.com//x///y"] * 2
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in urlfilter.judge(pages, rules).collect()}
    want = url_verdicts_by_hand(urls, rules)
    assert [got[i] for i in range(len(urls))] == want and set(want) == {"allow", "block"}
    ads, ok = (want[urls.index(u)] for u in (next(u for u in urls if "u/ads/" in u), next(u for u in urls if "u/ok/" in u)))
    assert (ads, ok) == ("block", "allow")
    far = spark.createDataFrame([(1, "http://b.com" + "/deep" * 3000)], "page_id long, url string")
    assert urlfilter.judge(far.union(pages.limit(40)), rules).count() == 41
    real = [(r.page_id, r.url) for r in common.table(spark, sf_dir, "pages").collect()]
    got = {r.page_id: r.verdict for r in urlfilter.judge(common.table(spark, sf_dir, "pages")).collect()}
    assert [got[i] for i, _ in real] == url_verdicts_by_hand([u for _, u in real])


@pytest.mark.parametrize("above", [0, 3, 5, 8, 12])
def test_url_slugs_at_any_depth(spark, above):
    """Slugs below a blocked and an allowed prefix, and their unlabelled siblings, however deep."""
    rng = np.random.default_rng(above)
    prefix = "".join(f"p{chr(97 + k)}/" for k in range(above))
    slug = lambda: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, 9))
    rules = [(f"x.com/{prefix}ads/listed", "block"), (f"x.com/{prefix}ok/listed", "allow")]
    urls = [f"http://x.com/{prefix}{kind}/{mark}{slug()}" for kind in ("ads", "ok") for mark in ("listed", "") for _ in range(60)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in urlfilter.judge(pages, rules).collect()}
    assert [got[i] for i in range(240)] == ["block"] * 120 + ["allow"] * 120


# --- 4 BPE


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(bpe.RANKS), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(corpus, odd, reference):
    for df in (corpus.select("doc_id", "text"), odd):
        texts = {(r.doc_id, r.text) for r in df.collect()}
        want = sorted((d if d is not None else -1, reference.encode_ordinary(t or ""), (t or "").encode()) for d, t in texts)
        got = {(r.doc_id if r.doc_id is not None else -1, tuple(np.frombuffer(r.ids, "<u4").tolist()), bytes(r.decoded), r.n_tokens) for r in bpe.round_trip(df).collect()}
        assert sorted((d, list(i), b) for d, i, b, n in got) == want and all(len(i) == n for _, i, _, n in got)


def test_bpe_queue_over_many_pretokens_and_a_small_memory(corpus, reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 50)
    monkeypatch.setattr(bpe, "TOGETHER", 200)
    c = bpe.Codec(public_tokenizers.path(bpe.RANKS))
    texts = [r.text for r in corpus.select("text").limit(60).collect()]
    for at in range(0, 60, 7):
        ids = c.encode_all(texts[at : at + 7])
        assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [reference.encode_ordinary(t or "") for t in texts[at : at + 7]]
        assert c.decode_all(ids) == [(t or "").encode() for t in texts[at : at + 7]]
    rng = np.random.default_rng(5)
    items = [bytes(rng.integers(0, 256, rng.integers(1, 30)).astype(np.uint8)) for _ in range(500)] + [b"aaaa" * 20, b"ababab"]
    assert [np.frombuffer(x, "<u4").tolist() for x in c.encode_pieces(items)] == [reference._encode_single_piece(x) for x in items]


def test_bpe_long_pretokens_and_separate_steps(spark, reference):
    c = bpe.Codec(public_tokenizers.path(bpe.RANKS))
    rng = np.random.default_rng(3)
    for t in ["ab" * 9000, "é" * 5001, "".join(chr(97 + i) for i in rng.integers(0, 26, 20000)), "!?" * 3000, "a" * 64]:
        assert np.frombuffer(c.encode(t), "<u4").tolist() == reference.encode_ordinary(t)
    assert bpe.round_trip(spark.createDataFrame([], DOCS)).count() == 0 and c.encode_all([]) == [] and c.encode_all([None, ""]) == [b"", b""] and c.decode_all([b"", b""]) == [b"", b""]
    df = spark.createDataFrame([(1, "hello wörld")], "doc_id long, text string")
    r = bpe.digests(bpe.decode(bpe.encode(df))).first()
    assert r.decoded_sha256 == hashlib.sha256("hello wörld".encode()).hexdigest()
    assert r.ids_sha256 == hashlib.sha256(np.array(reference.encode_ordinary("hello wörld"), "<u4").tobytes()).hexdigest()


# --- 5 lines


def cleaned(rows, min_docs=3, min_chars=20):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= min_chars:
                holders.setdefault(key(x), set()).add(d)
    hot = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or key(x) not in hot or hot[key(x)] == d]
        out.append((d if d is not None else -1, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


LINES = [(i, f"A line that many documents hold\n own {i}\n  a LINE that many documents hold\t") for i in range(5)] + [(7, "two hold this line, no more\nx"), (8, "two hold this line, no more"), (9, None), (9, ""), (None, "A line that many documents hold")]


@pytest.mark.parametrize("broadcast", [linededup.BROADCAST, 0])
def test_lines_against_brute_force(spark, odd, broadcast):
    for rows in (LINES, [(r[0], r[1]) for r in ODD] * 1 + [(20 + i, "line one is long enough to count") for i in range(3)]):
        got = linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), broadcast=broadcast)
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.text or "", r.n_lines, r.n_dropped) for r in got.collect()) == cleaned(rows)
    assert linededup.dedup(odd, broadcast=broadcast, counts=False).columns == odd.columns and linededup.dedup(odd, broadcast=broadcast).where("text is null").count() == 1
    assert linededup.dedup(odd).columns == [c for c in odd.columns if c != "n_lines"] + ["n_lines", "n_dropped"]


def test_lines_are_reversible(spark, none):
    a = spark.createDataFrame(LINES, "doc_id long, text string")
    more = spark.createDataFrame([(30, "two hold this line, no more")], "doc_id long, text string")
    held = linededup.postings(a)
    hot = linededup.hot_keys(held)
    grown = linededup.add(held, more)
    new_hot = linededup.hot_keys(grown)
    added = new_hot.join(hot, "key", "left_anti")
    filters = linededup.update_filters(linededup.build_filters(hot), added, None)
    key = next(k for k in linededup.keys_of("two hold this line, no more", 20) if k)
    inside = lambda fs, k: any(linededup.Cuckoo.load(r["filter"]).contains(linededup.halves([k]))[0] for r in fs.collect() if r.shard == linededup.shard_of(linededup.halves([k]), linededup.SHARDS)[0])
    assert added.count() == 1 and inside(filters, key)
    back = linededup.remove(grown, more)
    gone = new_hot.join(linededup.hot_keys(back), "key", "left_anti")
    filters = linededup.update_filters(filters, gone.limit(0), gone)
    assert not inside(filters, key) and sorted(map(tuple, back.collect())) == sorted(map(tuple, held.distinct().collect()))
    assert linededup.dedup(none).count() == 0


def test_a_full_filter_holds_all_until_it_is_made_anew(spark):
    key = lambda i: hashlib.md5(str(i).encode()).digest()
    table = lambda ids: spark.createDataFrame([(key(i),) for i in ids], "key binary")
    docs = spark.createDataFrame([(i, f"a line that is long enough to count {i}") for i in range(400)], "doc_id long, text string")
    hot = linededup.postings(docs).select("key")
    small = linededup.build_filters(table(range(10)), 2)
    full = linededup.update_filters(small, hot, None)
    assert full.where("filter is null").count() == 2 and linededup.count_of(full) == 2
    assert linededup.candidates(docs, full).count() == linededup.candidates(docs, full, broadcast=-1).count() == 400
    again = linededup.update_filters(full, table([]), None)
    assert again.where("filter is null").count() == 2
    anew = linededup.update_filters(small, hot, None, hot=hot.union(table(range(10))))
    assert anew.where("filter is null").count() == 0 and linededup.count_of(anew) == 2
    for limit in (1 << 20, 0):
        assert linededup.candidates(docs, anew, broadcast=limit).count() == 400
        strangers = spark.createDataFrame([(i, f"another line that isn't in any filter {i}") for i in range(300)], "doc_id long, text string")
        assert linededup.candidates(strangers, anew, broadcast=limit).count() < 10


def test_filters_know_their_shards(spark):
    docs = spark.createDataFrame([(i, f"a line that is long enough to count {i % 40}") for i in range(200)], "doc_id long, text string")
    hot = linededup.hot_keys(linededup.postings(docs))
    for shards in (1, 7, 100):
        filters = linededup.build_filters(hot, shards)
        assert linededup.candidates(docs, filters).count() == linededup.candidates(docs, linededup.update_filters(filters, hot.limit(0), None)).count() == 200
    with pytest.raises(ValueError):
        linededup.count_of(linededup.build_filters(hot, 7).union(linededup.build_filters(hot, 9)))



def test_cuckoo_filter():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 2**63, (3000, 2)).astype(np.uint64)
    f = linededup.Cuckoo(3000)
    assert f.insert(keys[:2000]) and f.contains(keys[:2000]).all()
    assert f.contains(keys[2000:]).mean() < 0.01
    f.delete(keys[:1000])
    assert f.contains(keys[1000:2000]).all() and f.contains(keys[:1000]).mean() < 0.01
    small = linededup.Cuckoo(8)
    assert not small.insert(keys[:500])


# --- 6 n-gram join


def linked_by_hand(rows, k, percent):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + min(k, len(w))]) for i in range(len(w) - min(k, len(w)) + 1)} if w else set()
    own = {d: d for d in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = own[a], own[b]
            for d in own:
                if own[d] == max(p, q):
                    own[d] = min(p, q)
    return sorted((d, len(sets[d]), own[d]) for d in sets)


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_ngram_join_against_brute_force(spark, corpus, none, k, percent):
    rng = np.random.default_rng(k)
    base = [f"w{i}" for i in rng.integers(0, 400, 90)]
    rows = [(r.doc_id, r.text) for r in corpus.select("doc_id", "text").limit(60).collect()]
    for i in range(80):
        w = list(base)
        for j in rng.integers(0, len(w), rng.integers(0, 5)):
            w[j] = f"z{rng.integers(0, 50)}"
        rows.append((10_000 + i, " ".join(w)))
    rows += [(20_000 + i, " ".join(base)) for i in range(10)] + [(30_001, None), (30_002, " "), (30_003, "a b"), (30_004, "A  b"), (30_005, "a")]
    got = ngramjoin.components_of(spark.createDataFrame(rows, "doc_id long, text string"), k, percent)
    assert sorted(map(tuple, got.collect())) == linked_by_hand(rows, k, percent)
    assert ngramjoin.components_of(none, k, percent).count() == 0


@pytest.mark.parametrize("ids", [0, 4_000_000])
def test_ngram_join_of_hot_heads(spark, monkeypatch, ids):
    """Many near copies of one text, verified in lots, with ids sent to the workers or joined."""
    monkeypatch.setattr(ngramjoin, "PAIRS", 3)
    monkeypatch.setattr(ngramjoin, "IDS", ids)
    rng = np.random.default_rng(8)
    base, rows = [f"w{i}" for i in range(60)], []
    for i in range(60):
        w = list(base)
        for j in rng.integers(0, 60, rng.integers(0, 3)):
            w[j] = f"z{i}"
        rows += [(i, " ".join(w)), (100 + i, " ".join(f"o{i}x{j % 20}" for j in range(30)))]
    rows += [(200 + i, rows[2 * i][1]) for i in range(20)]
    got = ngramjoin.components_of(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)
    assert sorted(map(tuple, got.collect())) == linked_by_hand(rows, 5, 80)


def test_ngram_join_odd(odd):
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in ngramjoin.components_of(odd, 3, 90).collect())
    assert len(got) == len(ODD) and [g for g in got if g[0] in (5, 6)] == [(5, 4, 5), (5, 4, 5), (6, 4, 5)]


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    own = {x: x for p in pairs for x in p}
    for a, b in pairs:
        p, q = own[a], own[b]
        for d in own:
            if own[d] == max(p, q):
                own[d] = min(p, q)
    want = {n: c for n, c in own.items() if sum(1 for v in own.values() if v == c) > 1}
    assert {r.node: r.component_id for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()} == want


@pytest.mark.parametrize("small", [graph.SMALL, 0])
def test_components_of_long_chains_and_hubs(spark, small):
    """small = 0: the joins dealt out by salts."""
    long, wide = (3000, 1500) if small else (40, 100)
    pairs = [(i, i + 1) for i in range(long)] + [(5000, 5001 + i) for i in range(wide)] + [(9000, 9000)]
    got = {r.node: r.component_id for r in graph.components(spark.createDataFrame(pairs, "a long, b long"), small=small).collect()}
    assert got == {**dict.fromkeys(range(long + 1), 0), **dict.fromkeys(range(5000, 5001 + wide), 5000)}
    assert graph.components(spark.createDataFrame([], "a long, b long"), small=small).count() == 0


def test_components_tell_when_they_do_not_settle(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    with pytest.raises(RuntimeError):
        graph.components(chain, max_rounds=2)


# --- 7 benchmark


def plain_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment_against_the_full_matrix():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = rng.integers(0, 5, rng.integers(1, 14)), rng.integers(0, 5, rng.integers(1, 20))
        assert decontam.align(a, b)[0] == plain_alignment(a, b)


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def test_leaks(spark, odd, none):
    w = ITEM.split()
    edited = [x if i % 7 else "changed" for i, x in enumerate(w)]
    docs = spark.createDataFrame(
        [(1, f"some words before {ITEM} and after"), (2, "intro " + " ".join(edited) + " outro"), (3, "nothing of it"), (4, " ".join(w[:4]) + " and then other things entirely"), (5, None), (6, ITEM.upper().replace(" ", ", ")), (7, "the start " + " ".join(w[:12]))],
        "doc_id long, text string",
    )
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, "ab"), (4, "")], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.leaks(docs, bench).collect()}
    assert set(got) == {1, 2, 6, 7} and got[1].score == 1.0 and (got[1].first_word, got[1].last_word) == (3, 22)
    assert sorted(r.doc_id for r in decontam.without_leaks(docs, bench).collect()) == [3, 4, 5]
    assert decontam.leaks(odd, bench).count() == 0 and decontam.without_leaks(odd, bench).count() == len(ODD)
    assert decontam.leaks(none, bench).count() == 0 and decontam.leaks(docs, bench.limit(0)).count() == 0


def test_leaks_against_brute_force(spark, sf_dir, corpus):
    bench = common.table(spark, sf_dir, "benchmark")
    items = [(r.item_id, decontam.plain_words(r.text.encode())) for r in bench.collect()]
    want = set()
    for r in corpus.select("doc_id", "text").collect():
        w = decontam.plain_words(r.text.encode())
        ids = {x: i for i, x in enumerate(set(w))}
        passage = np.array([ids[x] for x in w])
        for i, item in items:
            if len(set(item) & set(w)) * 2 >= len(set(item)) and decontam.align(np.array([ids.get(x, -1) for x in item]), passage)[0] >= 2 * len(item) * decontam.LEAK:
                want.add((r.doc_id, i))
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(corpus, bench).collect()} == want


def test_leaks_of_short_edited_items(spark):
    """Random substitutions in items of 15 to 25 words, whose n-grams are held by unequal numbers of documents."""
    rng = np.random.default_rng(11)
    items = [[f"i{k}w{j}" for j in range(rng.integers(15, 26))] for k in range(12)]
    texts = []
    for w in items:
        for _ in range(25):
            edited = [f"z{rng.integers(1 << 40)}" if rng.random() < 0.25 else x for x in w]
            if rng.random() < 0.3:  # and some words put in
                edited[8:8] = [f"z{rng.integers(1 << 40)}" for _ in range(rng.integers(1, 12))]
            texts.append([f"b{rng.integers(1 << 40)}" for _ in range(20)] + edited + ["end"])
        for j in range(len(w) - 2):  # runs of three on their own
            texts += [["x", *w[j : j + 3], "y"]] * int(rng.integers(0, 4))
    want = set()
    for d, t in enumerate(texts):
        for i, w in enumerate(items):
            ids = {x: n for n, x in enumerate(t)}
            if plain_alignment([ids.get(x, -1) for x in w], [ids[x] for x in t]) >= 2 * len(w) * decontam.LEAK:
                want.add((d, i))
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()}
    assert len(want) > 100 and got <= want and len(got) >= 0.98 * len(want)


def test_seeds_lose_no_leak():
    """Words replaced, dropped and put in at any rate, few or many different words: what reaches LEAK is found, nothing else."""
    rng, found = np.random.default_rng(3), 0
    for trial in range(600):
        item = rng.integers(0, rng.choice([3, 10, 1000]), rng.integers(3, 40)).tolist()
        drop, other, more = rng.random(3) * rng.choice([0.2, 0.4, 0.6])
        text = [9_000 + i for i in range(rng.integers(1, 30))]
        for x in item:
            if rng.random() >= drop:
                text.append(int(rng.integers(0, 1500)) if rng.random() < other else x)
            while rng.random() < more or (trial % 7 == 0 and text[-1] < 2_000):
                text.append(2_000 + len(text))
        leak = decontam.align(np.array(item), np.array(text))[0] >= len(item)
        block = decontam.Bench([7, 8], [" ".join(f"q{x}" for x in item).encode()] * 2)
        assert [x[0] for x in block.leaks(" ".join(f"q{x}" for x in text).encode())] == [7, 8] * leak
        found += leak
    assert found > 200


def test_frequent_pairs_of_large_benchmarks_are_no_seeds():
    """Items of few, unequally frequent words: a text that holds no leak meets few of them, however many there are."""
    rng = np.random.default_rng(5)
    share = 1 / np.arange(1, 1001)
    items = [" ".join(f"w{x}" for x in rng.choice(1000, 60, p=share / share.sum())).encode() for _ in range(3_000)]
    block = decontam.Bench(list(range(len(items))), items)
    clean = rng.choice(1000, 2_000, p=share / share.sum())
    h = common.hashes([f"w{x}".encode() for x in clean])
    k = np.minimum(np.searchsorted(block.known, h), len(block.known) - 1)
    assert len(list(block.candidates(np.where(block.known[k] == h, k, -1)))) < 60
    assert {x[0] for x in block.leaks(b"so " + items[17] + b" it goes")} >= {17}


def test_windows_of_long_texts(monkeypatch):
    monkeypatch.setattr(decontam, "WINDOW", 64)
    block = decontam.Bench([1], [ITEM.encode()])
    for before in range(0, 200, 7):
        assert [x[:1] + x[2:] for x in block.leaks(b"filler " * before + ITEM.encode() + b" filler" * 100)] == [(1, before, before + 19)]


EDITS = [("replace", k) for k in (3, 4, 5, 6, 7, 8, 10)] + [("insert", k) for k in (1, 2, 3, 4, 5)] + [("delete", k) for k in (4, 6)]


def edited_by(w, kind, k):
    out = []
    for i, x in enumerate(w, 1):
        here = i % k == 0
        if not (kind == "delete" and here):
            out.append(f"zz{i}" if kind == "replace" and here else x)
        if kind == "insert" and here:
            out.append(f"zz{i}")
    return out


@pytest.mark.parametrize("exact_too", [False, True])
def test_leaks_of_edited_copies(spark, exact_too):
    """Each item in one edited copy between other words, by itself or beside an exact copy, against full alignment of all pairs."""
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items = {r.item_id: [w.decode() for w in decontam.plain_words(r.text.encode())] for r in bench.collect()}
    texts, about = [], []
    for kind, k in EDITS:
        for i, w in items.items():
            texts.append([*[f"f{len(texts)}x{j}" for j in range(40)], *edited_by(w, kind, k), "end"])
            about.append((kind, k))
    texts += [w for w in items.values()] if exact_too else []
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()}
    want = set()
    for d, t in enumerate(texts):
        ids = {x: n for n, x in enumerate(t)}
        passage = np.arange(len(t)) if len(ids) == len(t) else np.array([ids[x] for x in t])
        for i, w in items.items():
            if decontam.align(np.array([ids.get(x, -1) for x in w]), passage)[0] >= 2 * len(w) * decontam.LEAK:
                want.add((d, i))
    assert got <= want and len(got) >= 0.98 * len(want)
    for edit in EDITS:
        mine = {x for x in want if x[0] < len(about) and about[x[0]] == edit}
        assert len(mine) >= len(items) and len(mine & got) >= 0.95 * len(mine)


def test_leaks_in_long_texts_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 30)
    other = "one two three four five six seven eight nine ten eleven twelve"
    bench = spark.createDataFrame([(1, ITEM), (2, other), (3, "two words"), (4, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "filler " * 50_000 + ITEM + " filler" * 50_000, 0), (2, other, 0), (3, "nothing " * 9, 0), (4, "just two words here", 0)], "doc_id long, text string, item_id int")
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()} == {(1, 1), (2, 2), (4, 3)}
    assert [r.doc_id for r in decontam.without_leaks(docs, bench).collect()] == [3] and len(list(decontam.blocks(bench))) > 1


# --- 8 language model


def lm_by_hand(rows, learned, model):
    """n, v, and for each document its tokens, known tokens, base and score, from plain counts of words and pairs."""
    one, two = {}, {}
    seq = {d: ["", *(t or "").lower().split(), ""] for d, t in rows}
    for d, w in seq.items():
        for a, b in zip(w, w[1:], strict=False):
            if learned(d):
                one[b], two[a, b] = one.get(b, 0) + 1, two.get((a, b), 0) + 1
    n, v = sum(one.values()), len(one)

    def p(a, b):
        c = one.get(a, 0)
        m = model.mix[min(lm.BUCKETS - 1, int(math.log2(c + 1) + 1e-12))]
        return m[0] * two.get((a, b), 0) / max(1, c) + m[1] * one.get(b, 0) / max(1, n) + m[2] / (v + 1)

    out = {}
    for d, w in seq.items():
        base = sum(math.log10((one.get(x, 0) + 1) / (n + v + 1)) for x in w[1:])
        out[d] = (len(w) - 1, sum(x in one for x in w[1:]), base, sum(math.log10(p(a, b)) for a, b in zip(w, w[1:], strict=False)))
    return n, v, out, p, one


def lm_rows(df, model):
    return {r.doc_id: (r.n_tokens, r.n_known, r.base_score, r.score) for r in df.collect()}


@pytest.mark.parametrize("head,looked,per", [(5, 20, 300), (3, 3, 50), (1024, 200_000, 2_000_000)])
def test_lm_scores_by_hand(spark, monkeypatch, head, looked, per):
    """From the counts of all words and pairs, with few words looked up and several buckets, and with production parameters."""
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "LOOKED_UP", looked)
    monkeypatch.setattr(lm, "PER_BUCKET", per)
    rng = np.random.default_rng(13)
    rows = [(i, " ".join(f"w{min(int(x), 60)}" for x in rng.zipf(1.4, rng.integers(0, 30)))) for i in range(120)] + [(200, "Never seen w1 w2 never seen"), (201, None), (202, "")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, word string").repartition(3)
    scored, model = lm.score(df, F.col("doc_id") < 100, F.col("doc_id") % 2 == 0)
    assert model.classes.heads <= head and len(model.classes.n) <= looked
    n, v, want, p, one = lm_by_hand(rows, lambda d: d < 100, model)
    got = lm_rows(scored, model)
    assert (model.n, model.v) == (n, v) and all(got[d] == pytest.approx(want[d]) for d, _ in rows)
    assert all(sum(p(a, b) for b in [*one, "never seen"]) == pytest.approx(1) for a in [*one, "never seen"])
    assert np.allclose(model.mix.sum(1), 1) and (model.mix >= 0).all()


def test_lm_weights_are_those_of_plain_maximisation(spark):
    """The cells of an eighth of an octave give what maximisation over all held-out pairs gives."""
    rng = np.random.default_rng(14)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.3, 40) if x < 500)) for i in range(200)]
    _, model = lm.score(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True), F.col("doc_id") % 2 == 0)
    counts = [({}, {}), ({}, {})]
    for d, t in rows:
        one, two = counts[1 - d % 2]
        w = ["", *t.split(), ""]
        for a, b in zip(w, w[1:], strict=False):
            one[b], two[a, b] = one.get(b, 0) + 1, two.get((a, b), 0) + 1
    flat, mixes = 1 / (len({*counts[0][0], *counts[1][0]}) + 1), []
    for (one, two), (_, held) in (counts, counts[::-1]):
        n = sum(one.values())
        at = np.array([min(lm.BUCKETS - 1, int(math.log2(one.get(a, 0) + 1) + 1e-12)) for a, _ in held])
        p = np.array([[two.get((a, b), 0) / max(1, one.get(a, 0)), one.get(b, 0) / n, flat] for a, b in held])
        times, m = np.array(list(held.values())), np.full((lm.BUCKETS, 3), 1 / 3)
        for _ in range(200):
            x = m[at] * p
            x *= (times / x.sum(1))[:, None]
            m = np.stack([np.bincount(at, x[:, k], lm.BUCKETS) for k in range(3)], 1) + 1e-6
            m /= m.sum(1, keepdims=True)
        mixes.append(m)
    want = np.mean(mixes, 0)
    assert np.abs(model.mix[1:] - want[1:]).max() < 0.03


def test_lm_held_out_beats_the_base(corpus):
    scored, _ = lm.score(corpus, common.fold(7) != 2, common.fold(2) == 0)
    s = scored.join(corpus.where(common.fold(7) == 2).select("doc_id"), "doc_id").agg(F.sum("score"), F.sum("base_score")).first()
    assert s[0] > s[1]


def test_lm_odd_and_empty(spark, odd, none):
    scored, model = lm.score(none, F.lit(True), F.lit(True))
    assert scored.count() == 0 and (model.n, model.v) == (0, 0)
    scored, _ = lm.score(odd, F.lit(False), F.lit(True))
    assert {(r.base_score, r.score, r.n_known) for r in scored.collect()} == {(0.0, 0.0, 0)}
    scored, model = lm.score(odd, F.lit(True), F.col("doc_id") % 2 == 0)
    assert scored.where("score is null or score > 0 or score = double('-Infinity')").count() == 0 and scored.count() == len(ODD)
    # rows without an id have no fold: neither held out nor learned from
    few = spark.createDataFrame([(None, "a b c"), (3, "a"), (5, "b b")], "doc_id long, text string")
    n = few.where(common.fold(7) != 2).agg(F.sum(F.size(F.split("text", " ")) + 1)).first()[0]
    assert lm.score(few, common.fold(7) != 2, common.fold(2) == 0)[1].n == n < 10


# --- 9 quality


def test_quality_held_out(spark, sf_dir, corpus):
    labels = common.table(spark, sf_dir, "labels")
    model = quality.train(corpus, labels, common.fold(5) != 0)
    held = quality.rank(corpus, model).join(labels.where(common.fold(5) == 0), "doc_id").toPandas()
    assert ((held.score >= quality.CUT).astype(int) == held.quality).mean() > 0.9 and held.score.between(0, 1).all()


def test_quality_threshold_takes_the_share_of_all_labels(spark, sf_dir, corpus):
    labels = common.table(spark, sf_dir, "labels")
    model = quality.train(corpus, labels, max_train=20)  # as many rows of each label in the sample, not in the table
    got = quality.rank(corpus, model).join(labels, "doc_id").toPandas()
    assert (got.quality == 0).sum() > 20 or (got.quality == 1).sum() > 20
    assert (got.score < quality.CUT).sum() == (got.quality == 0).sum()


def test_quality_sample_and_quantile(spark, sf_dir, corpus):
    rng = np.random.default_rng(9)
    raw, y = rng.normal(size=501), (rng.random(501) > 0.2).astype(int)
    got = quality.place(spark.createDataFrame(list(zip(y.tolist(), raw.tolist(), strict=True)), "quality int, raw double"))
    assert got["cut"] == pytest.approx(np.quantile(raw, np.mean(y == 0)))
    labels = common.table(spark, sf_dir, "labels")
    a, b = (quality.train(corpus, t, max_train=20) for t in (labels.repartition(7), labels.orderBy(F.desc("doc_id"))))
    assert np.allclose(np.sort(a["mean"]), np.sort(b["mean"])) and np.allclose(a["std"], b["std"])  # the same rows


def test_quality_score_by_hand(spark, sf_dir, corpus):
    """The weights are where the gradient of the pairwise loss vanishes, and scores follow from features, weights and threshold."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(120, 5)), rng.integers(0, 2, 120)
    x[:, 0] += y
    m = quality.fit(x, y)
    z = (x - m["mean"]) / m["std"]
    good, bad = z[y == 1], z[y == 0]
    pairs = np.random.default_rng(7)
    n = quality.PAIRS * max(len(good), len(bad))
    d = good[pairs.integers(0, len(good), n)] - bad[pairs.integers(0, len(bad), n)]
    loss = lambda w: np.log1p(np.exp(-d @ w)).mean() + 5e-4 * w @ w
    assert all(loss(m["w"]) <= loss(m["w"] + e) for e in np.concatenate([np.eye(5), -np.eye(5)]) * 1e-2)
    model = quality.train(corpus, common.table(spark, sf_dir, "labels"))
    for r in quality.rank(corpus, model).join(corpus.select("doc_id", "text"), "doc_id").limit(40).collect():
        raw = sum(float(np.clip((a - b) / c, -8, 8) * w) for a, b, c, w in zip(quality.features(r.text.encode()), model["mean"], model["std"], model["w"], strict=True))
        assert r.score == pytest.approx(1 / (1 + math.exp(-((raw - model["cut"]) / model["scale"] + math.log(0.3 / 0.7)))), rel=1e-6)


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(5, 1, None), (8, 0, None), (9, 0, 1), (4, 1, 0), (4, None, 0), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(odd, labels)
    assert quality.rank(odd, model).where("score between 0 and 1").count() == len(ODD)
    assert quality.keep(odd, model).columns == odd.columns
    for bad in (labels.limit(0), labels.where("quality = 1")):
        assert {r.score for r in quality.rank(odd, quality.train(odd, bad)).collect()} == {0.5}
    assert quality.rank(none, model).count() == 0 and quality.train(none, labels) == {}


# --- 10 vectors


def test_e8_decoding_is_nearest():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 8)) * 2
    p = e8dedup.nearest_e8(x)
    near = ((x - p) ** 2).sum(1)
    for v in e8dedup.roots():
        assert (near <= ((x - p - v) ** 2).sum(1) + 1e-9).all()
    assert len(e8dedup.roots()) == 240


def vectors_by_hand(rows, least=0.95):
    ok = {}
    for i, v in rows:
        if v and not any(x is None or not math.isfinite(x) for x in v) and any(v):
            ok[i] = np.array(v, float) / np.linalg.norm(v)
    own, n = {i: i for i, _ in rows}, {i: 0 for i, _ in rows}
    for a, b in itertools.combinations(sorted(ok), 2):
        if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= least:
            n[a] += 1
            n[b] += 1
            p, q = own[a], own[b]
            for d in own:
                if own[d] == max(p, q):
                    own[d] = min(p, q)
    return sorted((i, n[i], own[i], own[i] == i) for i in own)


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(e8dedup, "BLOCK", 16)  # large cells are dealt out in chunks
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(60)]
    hub = rng.normal(size=16)
    rows += [(100 + i, (hub + rng.normal(size=16) * 0.12).tolist()) for i in range(60)]
    rows += [(200 + i, hub.tolist()) for i in range(20)] + [(300, (hub * 3).tolist())]
    rows += [(400, None), (401, []), (402, [0.0] * 16), (403, [float("nan")] * 16), (404, [1.0, None]), (405, [float("inf"), 1.0]), (406, [1.0, 2.0]), (407, [2.0, 4.0]), (408, [-0.0, 1.0]), (409, [0.0, 1.0])]
    df = spark.createDataFrame([(i, v, "z", "z") for i, v in rows], "vec_id long, embedding array<double>, class string, cell string")
    got = sorted(map(tuple, e8dedup.linked(df).collect()))
    assert got == vectors_by_hand(rows)
    assert e8dedup.linked(df.limit(0)).count() == 0


def test_vector_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want, got = vectors_by_hand(rows), sorted(map(tuple, e8dedup.linked(df).collect()))
    assert sum(g[1] for g in got) >= 0.9 * sum(w[1] for w in want)


def test_vector_links_do_not_depend_on_size(spark, monkeypatch):
    """Pairs just over the threshold, and the same in a table that counts as many rows."""
    rng = np.random.default_rng(12)
    rows = []
    for i in range(1000):
        a, b = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
        rows += [(2 * i, a.tolist()), (2 * i + 1, (0.951 * a + math.sqrt(1 - 0.951**2) * b).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    small = sorted(map(tuple, e8dedup.linked(df).collect()))
    assert sum(r[1] for r in small) >= 0.99 * 2000
    monkeypatch.setattr(type(df), "count", lambda self: 60_000_000)
    assert sorted(map(tuple, e8dedup.linked(df).collect())) == small


def test_folds(spark):
    df = spark.createDataFrame([(1,), (22,), (None,)], "doc_id long").select(common.fold(7).alias("f"))
    assert [r.f for r in df.collect()] == [zlib.crc32(b"1") % 7, zlib.crc32(b"22") % 7, None]
