"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.checkpoints import checkpointed  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Open one table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def total_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes in a text column; one pass that reads only that column."""
    return int(df.agg(F.sum(F.octet_length(F.col(text)).cast("bigint"))).first()[0] or 0)


#: Of the bitmaps that are broadcast: 64-bit words at most (16 MB), and bits for each key as long as these are enough.
WORDS, BITS_A_KEY = 1 << 20, 16


def named_by(rows: DataFrame, found: DataFrame, key: list[str], name: str) -> DataFrame:
    """``rows`` with a boolean: true for every row whose key ``found`` has, and by chance for some others. Joins a bitmap of at most WORDS rows, without a shuffle of ``rows``."""
    words = 1
    while words < min(WORDS, found.count() * BITS_A_KEY // 64):
        words *= 2
    place, bit = f"shiftrightunsigned(xxhash64({', '.join(key)}), 6) & {words - 1}L", f"shiftleft(1L, cast(xxhash64({', '.join(key)}) & 63 AS int))"
    bits = found.select(F.expr(place).alias("__nb_word"), F.expr(bit).alias("__nb_bit")).groupBy("__nb_word").agg(F.bit_or("__nb_bit").alias("__nb_bits"))
    hit = F.coalesce(F.col("__nb_bits").bitwiseAND(F.expr(bit)) != 0, F.lit(False))
    return rows.withColumn("__nb_word", F.expr(place)).join(F.broadcast(bits), "__nb_word", "left").withColumn(name, hit).drop("__nb_word", "__nb_bits")


def without_ids(docs: DataFrame, dropped: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose id ``dropped`` (column __nb_id, distinct) has. Only rows that a bitmap of these ids names are shuffled, for the exact anti-join."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    dropped = checkpointed(dropped.select("__nb_id"))
    marked = named_by(docs.select(*own, F.col(f"`{doc_id}`").cast("bigint").alias("__nb_own")), dropped.withColumnRenamed("__nb_id", "__nb_own"), ["__nb_own"], "__nb_named")
    doubtful = marked.where("__nb_named").join(dropped, F.col("__nb_own").eqNullSafe(F.col("__nb_id")), "left_anti")
    return marked.where("NOT __nb_named").select(*own).unionByName(doubtful.select(*own))


def with_fields(schema: T.StructType, added: str, drop: int = 0) -> T.StructType:
    """A schema with fields at its end, given as in SQL, without its last ``drop`` fields."""
    kinds = {"int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "array<int>": T.ArrayType(T.IntegerType())}
    return T.StructType(schema.fields[: len(schema.fields) - drop] + [T.StructField(name, kinds[kind]) for name, kind in (x.split() for x in added.split(", "))])


def with_columns_of(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], added: str, drop: int = 0) -> DataFrame:
    """``df`` without its last ``drop`` columns and with fields that ``run`` puts at the end of each batch. While it runs, columns are named c0, c1 and so on, as ``mapInArrow`` doesn't take any name."""
    names = df.columns[: len(df.columns) - drop]
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    return plain.mapInArrow(run, with_fields(plain.schema, added, drop)).toDF(*names, *[x.split()[0] for x in added.split(", ")])


def utf8_column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets, without a copy where Arrow allows it; null counts as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data, offsets


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """A string column as a list; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what is made of them is small."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def release() -> None:
    """Give freed memory back to the system: workers are kept, and what one task has needed would count for all later ones."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Yield (first, last) row ranges of about ``most`` bytes; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last
