"""documents -> quality -> line dedup -> near-duplicate removal -> benchmark decontamination -> token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs, in order, with
any names: a stage reads doc_id and text (line dedup also writes n_chars, where there is one).

Defined cases of every stage: a null text is handled as an empty one and stays null; very long texts are read whole;
rows without doc_id are judged by their text, but never dropped for lines or texts that other documents hold; rows that
repeat a doc_id are judged each, and lines and near duplicates see them as one document; ties go to the smallest doc_id
(line dedup: the largest, which keeps a line); an empty table stays empty, with its columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixeltide.llm import bpe, decontam, linededup, ngramjoin, quality
from pixeltide.llm.common import Saved, checkpoint, fold, table

SHINGLE, PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the threshold go; all stay where `labels` has not both kinds."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), fold(5) != 0)
    return quality.keep(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least three documents hold stay in one of them; n_chars follows the text."""
    done = linededup.dedup(docs, counts=False)
    if "n_chars" not in docs.columns:
        return done
    return done.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays. Texts without words are in no group."""
    found = ngramjoin.components_of(docs, SHINGLE, PERCENT)
    gone = checkpoint(found.where("doc_id <> component_id").select("doc_id").distinct())
    if gone.count() <= ngramjoin.IDS:  # else the texts are shuffled
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or most of one, go."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded_sha256 (of the bytes that the ids decode to)."""
    coded = bpe.round_trip(docs)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("byte-level BPE", token_stage),
]

#: Learned scores, alignments and BPE merges have no SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        saved = Saved(stage(spark, docs, sf_dir))
        if before:
            before.drop()
        docs, before = saved.df, saved
    return STAGES[-1][1](spark, docs, sf_dir)
