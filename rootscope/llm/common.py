"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..tables import file_system, shared_dir, stored, unique_name  # noqa: F401

#: A-Z to a-z and every other byte but 0-9, a-z and non-ASCII to a space: splitting then gives the
#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of a lower-cased text.
ALNUM = bytes(
    i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256)
)
#: Only A-Z to a-z.
LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def released() -> None:
    """Give memory that is no longer used back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim is not None:
        trim(0)
