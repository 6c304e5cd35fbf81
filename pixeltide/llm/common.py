"""What the corpus operators share: tables, folds, checkpoints and words."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Python workers that share this machine's folders find the package as the driver does."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where none is named on a local master, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder; on a cluster it has to be one that all machines share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", at)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(at)
    return at


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder; with spark.cleaner.referenceTracking.cleanCheckpoints Spark drops its files when no plan refers to them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession) -> str:
    """A place in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/pixeltide/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


class Saved:
    """A table written to the shared folder, for larger steps: columnar and compressed, dropped by hand once it is used up."""

    def __init__(self, df: DataFrame):
        spark = self.spark = df.sparkSession
        self.path = new_path(spark)
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


_NO_ID = -(1 << 63)


def ids_in(col: str = "doc_id") -> Column:
    """An id as it goes to pandas: a null would turn a whole batch of 64-bit ids into floats, so -2^63 stands for it."""
    return F.coalesce(F.col(col).cast("long"), F.lit(_NO_ID)).alias(col)


def ids_out(df: DataFrame, col: str = "doc_id") -> DataFrame:
    return df.withColumn(col, F.nullif(F.col(col), F.lit(_NO_ID)))


def fold(n: int, col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n; null ids have none."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def words(text: bytes | None) -> list[bytes]:
    """Runs of [^\\x20\\x09-\\x0D] after A-Z are lower-cased, which is what bytes.lower and bytes.split do."""
    return text.lower().split() if text else []


def hashes(items: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, items), np.uint64, len(items))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words; for fewer words, one for the whole sequence; none without words."""
    if not len(h):
        return h
    k = min(k, len(h))
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
            out ^= out >> np.uint64(29)
        if k:
            out = out + np.uint64(k)
    return mix(out)
