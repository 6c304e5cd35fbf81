"""Token counts under a unigram vocabulary by dynamic programming over a trie of pre-tokens.

The distinct pre-tokens (runs between white space, with a word-start mark) of at most ROWS texts and about CHARS characters
go into a trie. A node has the forward score of its prefix: the best log-probability over the segmentations of the prefix
into pieces, and the number of tokens of that segmentation (of the fewest where scores tie). It depends on the prefix
alone, so each shared prefix is computed once; the last node of a pre-token holds its count. Characters without a piece
fall back to their UTF-8 bytes, one token each.

The public vocabulary has ranks, not probabilities; a piece of rank r has probability proportional to 1 / (r + RANK_SHIFT)
(Zipf's law). The model is a parameter: log_probs takes any others.

One pass over whole texts, no shuffle. Defined cases: a null, empty or blank text has 0 pre-tokens, 0 tokens and score 0;
repeated rows are counted each; other columns are left out.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame

from pixeltide.llm.bpe import parts
from pixeltide.llm.common import ids_in, ids_out, importable
from pixeltide.llm.pieces import WORD_START, Automaton, over_trie, vocabulary

VOCABULARY = "piece_bpe_32k.model"
RANK_SHIFT = 100
ROWS, CHARS = 5000, 16 << 20  # of texts whose pre-tokens share a trie
BYTE = -12.0  # log-probability of a byte token


def log_probs(n: int) -> np.ndarray:
    p = 1 / (np.arange(n) + RANK_SHIFT)
    return np.log(p / p.sum())


class Counter:
    def __init__(self, pieces: list[str], logs: np.ndarray):
        keep = [i for i, p in enumerate(pieces) if p]
        self.auto, self.logs = Automaton([pieces[i] for i in keep]), logs[keep]

    def words(self, items: list[str]) -> np.ndarray:
        """Score and token count of each item."""

        def best(chars, ends, parents):
            size = np.where(chars < 0x80, 1, np.where(chars < 0x800, 2, np.where(chars < 0x10000, 3, 4)))
            new = parents + np.stack([size * BYTE, size], 1)
            for rows, pieces, values in ends:
                score, n = values[:, 0] + self.logs[pieces], values[:, 1] + 1
                old = new[rows]
                win = (score > old[:, 0]) | (score == old[:, 0]) & (n < old[:, 1])
                new[rows[win]] = np.stack([score[win], n[win]], 1)
            return new

        return over_trie(self.auto, [WORD_START + w for w in items], np.zeros(2), best)


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    pieces = vocabulary(path)
    return Counter(pieces, log_probs(len(pieces)))


def count(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_pretokens long, n_tokens long, score double for each row of docs(doc_id, text)."""
    path = path or public_tokenizers.path(VOCABULARY)
    importable(docs.sparkSession)

    def run(batches):
        c = counter(path)
        for part in parts(batches, ROWS, CHARS):
            index: dict[str, int] = {}
            new = index.setdefault
            ids = [np.array([new(w, len(index)) for w in (t or "").split()], np.int64) for t in part.text]
            got = c.words(list(index)) if index else np.zeros((0, 2))
            sums = np.array([got[i].sum(0) if len(i) else np.zeros(2) for i in ids]).reshape(-1, 2)
            yield pd.DataFrame({"doc_id": part.doc_id.array, "n_pretokens": [len(i) for i in ids], "n_tokens": sums[:, 1].astype(np.int64), "score": sums[:, 0]})

    return ids_out(docs.select(ids_in(), "text").mapInPandas(run, "doc_id long, n_pretokens long, n_tokens long, score double"))
