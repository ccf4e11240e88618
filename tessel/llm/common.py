"""What the operators of this subpackage share: sessions, shared storage, words and hashes.

Words are runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``. Texts travel to
Python as UTF-8 bytes, because ``bytes.split()`` cuts at exactly those white
space bytes and ``bytes.lower()`` lowers exactly A-Z.
"""

from __future__ import annotations

import ctypes
import functools
import inspect
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch sent to Python, so that batches of long texts stay small.
ARROW_ROWS = 1000

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_S29, _S32 = np.uint64(29), np.uint64(32)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, and a checkpoint folder where the session names none.

    On a cluster ``spark.checkpoint.dir`` is set and left alone; the temporary
    folder is only for single-machine sessions such as tests.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    shared_dir(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tessel-")
        sc.setCheckpointDir(named)
    elif not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    It cuts the lineage, lets several consumers use one computation and
    survives lost executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessel/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_by_key(df: DataFrame, key: str) -> DataFrame:
    """``df`` stored like ``stored``, in as many buckets of ``key`` as shuffles have partitions.

    Joins on ``key`` send the other side to the buckets and leave these rows
    where they are. The name that the buckets are read by is taken back by
    ``forget``; the files stay.
    """
    spark = df.sparkSession
    name = f"tessel_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/tessel/{name}"
    df.write.format("parquet").option("path", path).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).saveAsTable(name)
    out = spark.table(name)
    out._tessel_name = name
    return out


def forget(df: DataFrame) -> None:
    """Take back the name of rows that were stored by key and are not read any more."""
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._tessel_name}")


def release() -> None:
    """Give memory that is free within this process back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim is not None:
        trim(0)


def released(run):
    """``run`` for a Python worker that keeps no free memory afterwards.

    Workers live on from task to task, and each would keep the pages of the
    largest task it ever had. ``run`` makes batches, or a table of a group.
    """
    if inspect.isgeneratorfunction(run):

        @functools.wraps(run)
        def held(batches):
            try:
                yield from run(batches)
            finally:
                release()

    else:

        @functools.wraps(run)
        def held(table):
            out = run(table)
            release()
            return out

    return held


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a frame's bytes; it runs no job."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


#: An estimate beyond this may be no more than a plan's default, and is measured.
UNSURE_BYTES = 1 << 40


def bucket_count(df: DataFrame, bytes_each: int, least: int = 12, text: str = "text") -> int:
    """How many buckets keep each under about ``bytes_each`` of compressed input."""
    size = plan_bytes(df)
    if size > UNSURE_BYTES:
        size = (df.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0) // 2
    return max(least, size // bytes_each + 1)


def text_bytes(name: str = "text") -> F.Column:
    """A text column as UTF-8 bytes; null becomes empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary").alias(name)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> _S29)) * _MIX
    return x ^ (x >> _S32)


def fold(acc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The hash of a sequence, one element longer."""
    return mix(acc * _MUL + value)


class WordHashes(dict):
    """64-bit hashes of words, kept for the words seen lately."""

    def __init__(self, seed: int = 0, most: int = 400_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: A side of at most this many bytes as Parquet is sent to all executors; a larger one is shuffled.
BROADCAST_BYTES = 2 << 20

#: Ways in which a key's rows are spread where the other side is shuffled.
SALTS = 16


def sized_join(left: DataFrame, right: DataFrame, key: str, spread: list[str]) -> DataFrame:
    """Left join on ``key`` with a stored side that has one row per key.

    The stored side's size is looked up: a small one is broadcast, a larger one
    is repeated for each salt, so that a key with a third of all rows is spread
    by a hash of the ``spread`` columns.
    """
    if plan_bytes(right) <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), key, "left")
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)))
    each = right.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(each, [key, "__salt"], "left").drop("__salt")
