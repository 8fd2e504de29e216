"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourcast.session import checkpoint_dir
from hourcast.sources.tables import read_table

#: Rows of an Arrow batch sent to Python; bounds a worker's memory on long texts.
BATCH_ROWS = 1000
#: Bytes that separate words in every word contract: space and \t \n \v \f \r.
WS_CLASS = r"\x20\x09-\x0D"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return read_table(spark, sf_dir, name)


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage with files that every executor sees, keeps column pruning,
    and survives lost executors.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return memory that a task has freed to the system; a worker keeps it for itself otherwise, and the
    next stage's workers add to it."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def lean(parts: Iterable) -> Iterator:
    """A task's batches; memory that earlier tasks of the worker have freed is given back before the first,
    what these batches took after the last."""
    give_back()
    yield from parts
    give_back()


def sparing(parts: Iterable) -> Iterator:
    """As ``lean``, and after every batch too, for functions whose batches take much."""
    for part in lean(parts):
        yield part
        del part
        give_back()


def byte_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8 bytes; ``bytes.split`` cuts at exactly these six bytes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def share(key: str | F.Column, seed: int):
    """A reproducible uniform number in (0, 1) from a key column."""
    col = F.col(key) if isinstance(key, str) else key
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), col), 11)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
