"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the white space of every word and normalisation contract, \x20 and \x09-\x0D.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: Fixed value: a word is a longest run without that white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables, whole."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of the whole text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) made from the md5 of the parts, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def parts_for(rows: int, per_part: int, most: int = 1 << 20) -> int:
    """How many groups hold ``rows`` at about ``per_part`` each."""
    return max(1, min(most, -(-rows // per_part)))


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Tables written inside hand Python workers at most ``rows`` rows at a time, so long texts stay few in memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


#: Rows that Python workers are given at a time where the session doesn't say: texts may be long.
TEXTS_AT_A_TIME = 1000


def few_texts(spark: SparkSession) -> None:
    """From now on this session hands Python workers ``TEXTS_AT_A_TIME`` rows at most, if it has no limit of its own.

    For queries and stages whose result is read later, outside of ``arrow_batches``.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(TEXTS_AT_A_TIME))


def give_back() -> None:
    """Return freed memory to the machine: a worker that waits for its next task holds only what it needs."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
