"""Session helpers of the corpus operators."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest object, in bytes, that an operator of this subpackage broadcasts.
BROADCAST_BYTES = 64 << 20
#: Rows and bytes of text that go to a Python worker at once; both sides hold some such batches.
BATCH_ROWS, BATCH_BYTES = 1000, "8m"


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package when it is not on their path already, and keeps their batches small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: Column) -> Column:
    """Unsigned CRC-32 of the value's decimal text; null counts as empty."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a private one only where that is unset and all runs on one machine (tests)."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or f"file:///tmp/countloom-{os.getuid()}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: the lineage ends there, on storage that outlives executors."""
    spark = df.sparkSession
    at = shared_folder(spark)
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._written_at = at
    return out


def forget(df: DataFrame) -> None:
    """Deletes what :func:`cut` wrote for ``df``."""
    spark = df.sparkSession
    for f in {df._written_at} if hasattr(df, "_written_at") else {str(x).rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """What an operator writes on the way; all but the result is deleted at the end."""

    def __init__(self):
        self.held: list[DataFrame] = []

    def own(self, written: DataFrame) -> DataFrame:
        self.held.append(written)
        return written

    def cut(self, df: DataFrame) -> DataFrame:
        return self.own(cut(df))

    def finish(self, df: DataFrame) -> DataFrame:
        out = cut(df)
        for x in self.held:
            forget(x)
        return out


def small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """``df``, to be broadcast if it has at most ``rows`` rows (of a few numbers each); joined by key beyond."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _bits(values: DataFrame, column: str, bits: int) -> DataFrame:
    """(w, v): 64 bits in each v; at most 2^(bits - 6) rows."""
    at = F.pmod(F.col(column), F.lit(1 << bits))
    return values.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))).alias("v"))


def _wide(values: DataFrame, most: int) -> int:
    return min(most, max(16, (8 * values.count()).bit_length()))


def split_by_sieve(df: DataFrame, key: str, values: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows of ``df`` whose long ``key`` may be among ``values``, rows whose key is not), without Python workers or a shuffle.

    The sieve is a broadcast table of at most 2^18 rows; beyond some million values more and more rows are in the first part.
    """
    bits = _wide(values, 24)
    at = F.pmod(F.col(key), F.lit(1 << bits))
    asked = df.withColumn("__w", F.shiftright(at, 6)).join(F.broadcast(_bits(values, column, bits).withColumnsRenamed({"w": "__w", "v": "__v"})), "__w", "left")
    held = F.coalesce(F.call_function("shiftright", F.col("__v"), (at % 64).cast("int")).bitwiseAND(1) != 0, F.lit(False))
    asked = asked.withColumn("__held", held)
    return tuple(asked.where(c).drop("__w", "__v", "__held") for c in ("__held", "not __held"))


class Sieve:
    """A bit for each of some 64-bit values: says at once that a value is not among them, or that it may be.

    At most 2^most bits (16 MB) are gathered and broadcast; beyond some hundred
    million values more and more others pass, and what follows must sort them out.
    """

    def __init__(self, values: DataFrame, column: str, most: int = 27):
        self.bits = _wide(values, most)
        words = _bits(values, column, self.bits).toArrow()
        self.words = np.zeros(1 << (self.bits - 6), np.int64)
        self.words[words["w"].to_numpy()] = words["v"].to_numpy()

    def may_hold(self, values: np.ndarray) -> np.ndarray:
        at = values.view(np.int64) & ((1 << self.bits) - 1)
        return (self.words[at >> 6] >> (at & 63)) & 1 == 1
