"""Shared helpers of the training-data operators: input shape, shared scratch tables, hashing.

Every operator reads only the columns it names (``doc_id``, ``text`` ...), so further
columns of any name, including names the operator uses inside, never clash. A null text counts
as the empty text.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch.
BATCH_ROWS = 20_000
#: Bytes in one: texts can be long, rows of numbers are short.
BATCH_BYTES = 4 << 20


def tune(spark: SparkSession) -> SparkSession:
    """Bound the memory that an Arrow batch of long texts takes in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` as long, ``text`` never null, and the further columns named."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        *[F.col(c) for c in more],
    )


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is absent and everything runs on this machine, as in tests, a local
    folder is made.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = getattr(spark, "_lexiloom_scratch", None)
        if root is None:
            root = "file://" + tempfile.mkdtemp(prefix="lexiloom-")
            spark._lexiloom_scratch = root
    return f"{root.rstrip('/')}/lexiloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; for when the results that read them are written."""
    folder = scratch_dir(spark).rsplit("/", 1)[0]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: its lineage ends there, so a lost
    executor costs a reread and not a recomputation."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexiloom_path = path
    return out


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for df in frames:
        path = jvm.org.apache.hadoop.fs.Path(df._lexiloom_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def crc_bucket(id_col: Column, modulus: int) -> Column:
    """``crc32(doc_id as text) mod modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % modulus


def tokens_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, as UTF-8.

    ``bytes.split`` and ``bytes.lower`` know ASCII only, which is exactly this rule.
    """
    return text.encode("utf-8", "replace").lower().split()


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64 on uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def cuts(values: list[str], rows: int, chars: int = 1 << 19):
    """Ranges of texts: of at most so many rows, and of about so many characters."""
    lo, size = 0, 0
    for i, t in enumerate(values):
        if i > lo and (i - lo >= rows or size + len(t) > chars):
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(values):
        yield lo, len(values)


def release() -> None:
    """Give memory that is free inside this process back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def lean(run):
    """A task's function that gives its memory back when it ends: Python workers outlive their tasks, and
    an executor has several."""

    @functools.wraps(run)
    def wrapped(frames):
        try:
            yield from run(frames)
        finally:
            release()

    return wrapped


def crc_of(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def small_side(df: DataFrame, rows: int, most: int) -> DataFrame:
    """``df`` marked for broadcast if its counted rows are within the bound, else as it is."""
    return F.broadcast(df) if rows <= most else df
