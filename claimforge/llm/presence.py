"""Fixed-size bit filters over a table's values, made by the executors, that spare rows a shuffle."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimforge.llm.common import give_back

#: Bits of one slice of a filter: slices travel and are joined apart.
SLICE_BITS = 20
#: Bits of a filter of row ids: it has this size whatever the table's; beyond it, it only spares less.
ID_BITS = 25

#: A value marks two bits.
_MIXES = tuple(map(np.uint64, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)))


def summed_slices(parts: DataFrame, merge: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], slices: int) -> list:
    """The slices that tasks made, merged in two steps, so that no task reads what all tasks sent of a slice.

    ``merge`` reads its input as a stream and holds one accumulator a slice. What comes to the driver is one row a slice.
    """
    spark = parts.sparkSession
    near = parts.withColumn("part", F.spark_partition_id()).repartition(spark.sparkContext.defaultParallelism, "part").drop("part")
    return near.mapInArrow(merge, parts.schema).repartition(min(slices, 64), "slice").mapInArrow(merge, parts.schema).collect()


def _places(values: np.ndarray, bits: int) -> list[np.ndarray]:
    v = values.view(np.uint64)
    return [((v ^ (v >> np.uint64(31))) * mix >> np.uint64(64 - bits)).astype(np.int64) for mix in _MIXES]


def _set(bitmap: np.ndarray, values: np.ndarray, bits: int) -> None:
    for at in _places(values, bits):
        np.bitwise_or.at(bitmap, at >> 3, (0x80 >> (at & 7)).astype(np.uint8))


def holds(bitmap: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
    """Which of the int64 ``values`` may be in the filter."""
    one, two = ((bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 for at in _places(values, bits))
    return one & two == 1


def bit_filter(values: DataFrame, bits: int, least: int = 1) -> np.ndarray:
    """Packed bits that are marked by every value which occurs ``least`` (1 or 2) times, and by few others.

    The values are int64, in the first column, or lists of them. A task holds two arrays of ``2**bits`` bits.
    """
    size = 1 << (min(SLICE_BITS, bits) - 3)
    slices = (1 << bits) // 8 // size

    def batch_of(once: dict, twice: dict) -> pa.RecordBatch:
        rows = [(i, zlib.compress(once[i].tobytes(), 1), zlib.compress(twice[i].tobytes(), 1)) for i in sorted(once)]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["slice", "once", "twice"])

    def marked(batches):
        once, twice = (np.zeros((1 << bits) // 8, np.uint8) for _ in range(2))
        for batch in batches:
            column = batch.column(0)
            flat = column.flatten() if pa.types.is_list(column.type) else column
            found, n = np.unique(flat.to_numpy(zero_copy_only=False), return_counts=True)
            _set(twice, found[(n > 1) | holds(once, found, bits)], bits)
            _set(once, found, bits)
        cut = {i: once[i * size : (i + 1) * size] for i in range(slices)}
        cut = {i: x for i, x in cut.items() if x.any()}
        yield batch_of(cut, {i: twice[i * size : (i + 1) * size] for i in cut})
        del once, twice, cut
        give_back()

    def merge(batches):
        once, twice = {}, {}
        for batch in batches:
            for i, a, b in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
                a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
                if i in once:
                    twice[i] |= b | (once[i] & a)
                    once[i] |= a
                else:
                    once[i], twice[i] = a.copy(), b.copy()
        yield batch_of(once, twice)

    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in summed_slices(values.mapInArrow(marked, "slice int, once binary, twice binary"), merge, slices):
        out[row["slice"] * size : (row["slice"] + 1) * size] = np.frombuffer(zlib.decompress(row["once" if least == 1 else "twice"]), np.uint8)
    return out


def maybe_in(keys: DataFrame, key: str) -> Callable[[Column], Column]:
    """A test of ids (long, null among them) that is never false for one in the column ``key`` of ``keys``.

    Rows that fail it need no join with ``keys``, so their texts stay where they lie.
    """
    bits = keys.sparkSession.sparkContext.broadcast(bit_filter(keys.select(F.xxhash64(key)), ID_BITS))

    @F.pandas_udf("boolean")
    def test(hashes: pd.Series) -> pd.Series:
        return pd.Series(holds(bits.value, hashes.to_numpy(np.int64), ID_BITS))

    return lambda ids: test(F.xxhash64(ids))


def whole_rows(docs: DataFrame) -> Column:
    """The caller's row as one struct, out of reach of an operator's own column names."""
    return F.struct(*(docs[c] for c in docs.columns))


def first_of_each(rows: DataFrame, keys: list[str], order: list[Column], row: str = "row") -> DataFrame:
    """One ``row`` struct of each key: the smallest by ``order``, then by all its columns that can be ordered.

    Partial minima go before the shuffle, so a key of any size is never gathered.
    """
    fields = rows.schema[row].dataType.fields
    sortable = [F.col(row)[f.name] for f in fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant", "calendar"))]
    place = F.struct(*(c.alias(f"o{i}") for i, c in enumerate([*order, *sortable])))
    return rows.groupBy(*keys).agg(F.min_by(row, place).alias(row)).select(row)
