"""Language by segmentation-marginalised unigrams.

For each language, each piece of a fixed public vocabulary has a probability. A word's likelihood is the sum over all its
segmentations into pieces, by the forward algorithm; a text's is the product over its words (runs of letters,
lower-cased, with a word-start mark). Probabilities are learned by expectation-maximisation on a bounded sample of
labelled rows: about PER_LANG rows of each language, by a hash of their id; the word counts and the expected counts are
made and summed by Spark, and the driver only sees one number per language and piece.

Prediction is one pass over all texts without a shuffle: the distinct words of a batch meet in a trie, so shared prefixes
are computed once.

Defined cases: a null text, or one without a letter, is `und` with score 0; so is every text when nothing could be
learned; null languages and ids aren't learned from; ties go to the language that sorts first; repeated rows are
predicted each; other columns are left out.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixeltide.llm.bpe import parts
from pixeltide.llm.common import checkpoint, ids_in, ids_out, importable
from pixeltide.llm.pieces import WORD_START, Automaton, codes, over_trie, vocabulary

VOCABULARY = "piece_bpe_32k.model"
PER_LANG, ROUNDS, SMOOTH = 3_000, 3, 0.05
ROWS, CHARS = 5000, 16 << 20  # of texts whose words share a trie
_WORDS = re.compile(r"[^\W\d_]+")  # letters, and numbers that are no digits


def letter_words(text: str | None) -> list[str]:
    """Runs of letters (Unicode category L), lower-cased."""
    found = _WORDS.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    return [w for x in found for w in "".join(ch if ch.isalpha() else " " for ch in x).split()]


class Model:
    def __init__(self, path: str, langs: list[str]):
        self.path, self.langs = path, langs
        self.pieces = sorted({p for p in vocabulary(path) if (x := p.replace(WORD_START, "")) and x.isalpha() and x == x.lower() and p.rfind(WORD_START) <= 0})
        self.log = np.full((len(self.pieces), len(langs)), -np.log(max(1, len(self.pieces))))
        self.prior = np.zeros(len(langs))
        self.unseen = -18.0  # of a character that ends no segmentation otherwise

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "auto"}

    def automaton(self) -> Automaton:
        if "auto" not in self.__dict__:
            self.auto = Automaton(self.pieces)
        return self.auto

    def words(self, items: list[str]) -> np.ndarray:
        """log P(word) in each language."""
        log, unseen = self.log, self.unseen

        def forward(chars, ends, parents):
            new = parents + unseen
            for rows, pieces, values in ends:
                new[rows] = np.logaddexp(new[rows], values + log[pieces])
            return new

        return over_trie(self.automaton(), [WORD_START + w for w in items], np.zeros(len(self.langs)), forward)

    def expected(self, items: list[str], lang: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Expected counts of each piece in each language, words of one length at a time."""
        auto, out = self.automaton(), np.zeros_like(self.log)
        lens = np.fromiter(map(len, items), np.int64, len(items)) + 1
        for size in np.unique(lens):
            rows = np.flatnonzero(lens == size)
            flat, _ = codes([WORD_START + items[i] for i in rows])
            x, own = flat.reshape(-1, size), lang[rows]
            spans = []
            fore = np.full((len(rows), size + 1), -np.inf)
            fore[:, 0] = 0
            for end in range(1, size + 1):
                fore[:, end] = fore[:, end - 1] + self.unseen
                for begin, r, p in ((b, r, p) for b, r, p, e in spans if e == end):
                    fore[r, end] = np.logaddexp(fore[r, end], fore[r, begin] + self.log[p, own[r]])
                if end == 1:  # all spans, once
                    for b in range(size):
                        r, st = np.arange(len(rows)), np.zeros(len(rows), np.int64)
                        for e in range(b + 1, min(size, b + auto.longest) + 1):
                            st = auto.step(st, x[r, e - 1])
                            r, st = r[st >= 0], st[st >= 0]
                            p = auto.piece[st]
                            if (ok := p >= 0).any():
                                spans.append((b, r[ok], p[ok], e))
                            if not len(r):
                                break
                    for begin, r, p in ((b, r, p) for b, r, p, e in spans if e == 1):
                        fore[r, 1] = np.logaddexp(fore[r, 1], fore[r, begin] + self.log[p, own[r]])
            back = np.full((len(rows), size + 1), -np.inf)
            back[:, size] = 0
            for begin in range(size - 1, -1, -1):
                back[:, begin] = back[:, begin + 1] + self.unseen
                for r, p, e in ((r, p, e) for b, r, p, e in spans if b == begin):
                    back[r, begin] = np.logaddexp(back[r, begin], self.log[p, own[r]] + back[r, e])
            for b, r, p, e in spans:
                w = np.exp(fore[r, b] + self.log[p, own[r]] + back[r, e] - fore[r, size]) * n[rows[r]]
                np.add.at(out, (p, own[r]), w)
        return out


def train(docs: DataFrame, learn=None, path: str | None = None, per_lang: int = PER_LANG, rounds: int = ROUNDS) -> Model:
    """The model, from docs(doc_id, text, lang); learn: a condition on its rows."""
    path = path or public_tokenizers.path(VOCABULARY)
    spark = docs.sparkSession
    importable(spark)
    own = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("doc_id is not null and lang is not null")
    own = own if learn is None else own.where(learn)
    sizes = {r.lang: r["count"] for r in own.groupBy("lang").count().collect()}  # one row per language
    model = Model(path, sorted(sizes))
    if not sizes:
        return model
    total = sum(sizes.values())
    model.prior = np.log([sizes[x] / total for x in model.langs])
    million = 1_000_000
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(million))
    share = F.create_map(*[F.lit(y) for x in model.langs for y in (x, min(million, 1 + million * per_lang // sizes[x]))])
    lang_no = {x: i for i, x in enumerate(model.langs)}

    def count(batches):
        for b in batches:
            n: dict = {}
            for lang, text in zip(b.lang, b.text, strict=True):
                i = lang_no[lang]
                for w in letter_words(text):
                    n[i, w] = n.get((i, w), 0) + 1
            if n:
                yield pd.DataFrame({"lang": [k[0] for k in n], "word": [k[1] for k in n], "n": list(n.values())})

    counts = own.where(hashed < share[F.col("lang")]).mapInPandas(count, "lang int, word string, n long")
    counts = checkpoint(counts.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    for _ in range(rounds):
        def estimate(batches, model=model):
            total = np.zeros_like(model.log)
            for b in batches:
                total += model.expected(list(b.word), b.lang.values.astype(np.int64), b.n.values.astype(float))
            p, i = np.nonzero(total > 1e-6)
            yield pd.DataFrame({"piece": p, "lang": i, "n": total[p, i]})

        got = counts.mapInPandas(estimate, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        n = np.full(model.log.shape, SMOOTH)
        n[got.piece.values, got.lang.values] += got.n.values
        model.log = np.log(n / n.sum(0))
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred string, score double for each row of docs(doc_id, text)."""
    importable(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a number per language and piece

    def run(batches):
        m = shared.value
        for part in parts(batches, ROWS, CHARS):
            index: dict[str, int] = {}
            new = index.setdefault
            ids = [np.array([new(w, len(index)) for w in letter_words(t)], np.int64) for t in part.text]
            langs, scores = ["und"] * len(part), np.zeros(len(part))
            if index and m.langs:
                logs = m.words(list(index))
                for i, own in enumerate(ids):
                    if len(own):
                        x = logs[own].sum(0) + m.prior
                        k = int(x.argmax())
                        langs[i], scores[i] = m.langs[k], 1 / np.exp(x - x[k]).sum()
            yield pd.DataFrame({"doc_id": part.doc_id.array, "lang_pred": langs, "score": scores})

    return ids_out(docs.select(ids_in(), "text").mapInPandas(run, "doc_id long, lang_pred string, score double"))
