"""Exact cosine search over one or two vector columns, as one scan and a bounded top-k; for a table of queries as products of blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from codeloom.checkpoints import checkpointed
from codeloom.functions import cosine_to, name_from_id

TOP_K, QUERY_BLOCK, STEP = 10, 4096, 2048


def knn(rows: DataFrame, vector: Sequence[float], column: str, top_k: int = TOP_K, key: str = "id") -> DataFrame:
    """The ``top_k`` rows nearest by cosine, with _distance; vectors without length are left out, equal distances go by key."""
    scored = rows.withColumn("_distance", F.lit(1.0) - cosine_to(F.col(column), vector))
    return scored.where(F.col("_distance").isNotNull()).orderBy("_distance", key).limit(top_k)


def _by_length(batch: pa.RecordBatch, columns: int) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """Rows of a batch (key, vectors ...) by the lengths of their vectors: their numbers, a matrix of unit rows for each column, and which rows of each have a length. A null, or a vector with a null or a number that isn't finite, has none."""
    flats, starts, sizes = [], [], []
    for k in range(1, columns + 1):
        column = batch.column(k)
        size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flats.append(pc.fill_null(column.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False))
        starts.append(np.cumsum(size) - size)
        sizes.append(size)
    lengths = np.stack(sizes, 1)
    for own in np.unique(lengths, axis=0):
        at = np.flatnonzero((lengths == own).all(1))
        matrices, usable = [], np.zeros((columns, len(at)), bool)
        for k in range(columns):
            matrix = flats[k][starts[k][at, None] + np.arange(own[k])] if own[k] else np.zeros((len(at), 0))
            length = np.sqrt((matrix**2).sum(1))
            usable[k] = np.isfinite(length) & (length > 0)
            matrices.append(np.divide(matrix, length[:, None], out=np.zeros_like(matrix), where=usable[k][:, None]))
        yield at, matrices, usable


_BLOCKS = "lengths array<int>, usable binary, matrices binary"


def _blocks(table: DataFrame, key: str, columns: Sequence[str], most: int) -> DataFrame:
    """A table's vectors in blocks of at most ``most`` rows of one length, sorted by key: keys, lengths, usable and matrices. Rows without any vector of a length are left out."""
    kind = table.schema[key].dataType
    n = len(columns)
    form = pa.schema([("keys", pa.list_(to_arrow_type(kind))), ("lengths", pa.list_(pa.int32())), ("usable", pa.binary()), ("matrices", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, most):
                batch = whole.slice(first, most)
                keys = batch.column(0).to_pylist()
                for at, matrices, usable in _by_length(batch, n):
                    some = [k for k in sorted(range(len(at)), key=lambda k: keys[at[k]]) if usable[:, k].any()]
                    if some:
                        row = {"keys": [keys[at[k]] for k in some], "lengths": [m.shape[1] for m in matrices], "usable": usable[:, some].tobytes(), "matrices": b"".join(m[some].tobytes() for m in matrices)}
                        yield pa.RecordBatch.from_pylist([row], form)

    source = table.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), *[F.col(c).cast("array<double>").alias(f"v{k}") for k, c in enumerate(columns)])
    return source.mapInArrow(run, T.StructType([T.StructField("keys", T.ArrayType(kind)), *T.StructType.fromDDL(_BLOCKS).fields]))


def _unpacked(row: dict, prefix: str) -> tuple[list[np.ndarray], np.ndarray]:
    lengths, n, low, out = row[f"{prefix}lengths"], len(row[f"{prefix}keys"]), 0, []
    for size in lengths:
        out.append(np.frombuffer(row[f"{prefix}matrices"], np.float64, n * size, low).reshape(n, size))
        low += 8 * n * size
    return out, np.frombuffer(row[f"{prefix}usable"], bool).reshape(len(lengths), n)


def search_many(rows: DataFrame, queries: DataFrame, columns: Sequence[str], query_column: str | None = None, top_k: int = TOP_K, key: str = "id", block: int = QUERY_BLOCK, salts: int | None = None) -> DataFrame:
    """query, ``key``, similarity and column (its number in ``columns``) of the ``top_k`` rows nearest to each of a table of queries (``key``, ``query_column``), exactly: by the greatest of the similarities of ``columns``; of equal ones the first column is named.

    Both tables are packed into blocks, of ``block`` queries and STEP rows. Rows' blocks are dealt to ``salts`` places, by default the session's number of partitions, and queries' blocks go to each, so that every pair of blocks meets once in a matrix product, where the rows' blocks are; a plan of one
    size however many queries there are, nothing of which passes the driver. A place keeps the best of the query block it is at, so what is shuffled then are top_k rows for each query and place. Similarities count to nine decimals, and equal ones go by key. Vectors that are null, hold a
    null or a number that isn't finite, have no length or another one than the query's, and null keys, are left out.
    """
    spark, kind, n, step = rows.sparkSession, rows.schema[key].dataType, len(columns), STEP
    salts = salts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = _blocks(queries, key, [query_column or columns[0]], block)
    asked = checkpointed(asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns], F.monotonically_increasing_id().alias("q_block")))  # a number that stays, as the table is stored with it
    held = _blocks(rows, key, columns, step)
    held = held.select(*[F.col(c).alias(f"r_{c}") for c in held.columns], F.pmod(F.xxhash64("matrices", "keys"), F.lit(salts)).cast("int").alias("salt"))
    met = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).join(held, "salt")
    kind_of = to_arrow_type(kind)
    form = pa.schema([("query", kind_of), ("key", kind_of), ("similarity", pa.float64()), ("column", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, names, vectors, best, least = None, [], None, [], None

        def given() -> Iterator[pa.RecordBatch]:
            out = [(q, k, -v, c) for q, own in zip(names, best, strict=True) for v, k, c in own]
            for first in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out[first : first + 10_000]], f.type) for i, f in enumerate(form)], schema=form)

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["q_block"] != at:
                    yield from given()
                    at, names = row["q_block"], row["q_keys"]
                    vectors = _unpacked(row, "q_")[0][0]
                    best, least = [[] for _ in names], np.full(len(names), -2.0)
                matrices, usable = _unpacked(row, "r_")
                keys = row["r_keys"]
                scores, column = np.full((len(names), len(keys)), -3.0), np.zeros((len(names), len(keys)), np.int8)
                for c in range(n):
                    if matrices[c].shape[1] == vectors.shape[1]:
                        own = np.where(usable[c], np.round(vectors @ matrices[c].T, 9), -3.0)
                        column[own > scores] = c
                        scores = np.maximum(scores, own)
                rank = np.round(scores * 1e9).astype(np.int64) * len(keys) - np.arange(len(keys))  # of equal ones the lesser key
                cut = np.argpartition(-rank, min(top_k, len(keys)) - 1, axis=1)[:, :top_k]
                chosen = np.take_along_axis(scores, cut, 1)
                for q in np.flatnonzero((chosen.max(1) >= least) & (chosen.max(1) > -2)).tolist():
                    best[q] = sorted(best[q] + [(-v, keys[k], int(column[q, k])) for v, k in zip(chosen[q].tolist(), cut[q].tolist(), strict=True) if v > -2])[:top_k]
                    least[q] = -best[q][-1][0] if len(best[q]) == top_k else -2.0
        yield from given()

    fields = ["q_block", "q_keys", "q_lengths", "q_usable", "q_matrices", "r_keys", "r_lengths", "r_usable", "r_matrices"]
    found = met.select(*fields).mapInArrow(run, T.StructType([T.StructField("query", kind), T.StructField("key", kind), T.StructField("similarity", T.DoubleType()), T.StructField("column", T.IntegerType())]))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "key"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top_k).select("query", F.col("key").alias(key), "similarity", "column")


def knn_many(rows: DataFrame, queries: DataFrame, column: str, top_k: int = TOP_K, key: str = "id", block: int = QUERY_BLOCK) -> DataFrame:
    """query, ``key`` and similarity of the ``top_k`` rows nearest to each of a table of queries (``key``, ``column``), as ``search_many`` has it."""
    return search_many(rows, queries, [column], top_k=top_k, key=key, block=block).drop("column")


def search_vectors(rows: DataFrame, vector: Sequence[float], first: str = "description_vector", second: str = "signature_vector", names: tuple[str, str] = ("description", "signature"), top_k: int = TOP_K, key: str = "id") -> DataFrame:
    """The ``top_k`` rows by the greater of two similarities, with similarity and match_field.

    One pass stands for two searches and a merge: a row among the best by the greater of both is among the best by that column, too. On equal
    similarities the first column is named.
    """
    scored = rows.withColumns({"__first": cosine_to(F.col(first), vector), "__second": cosine_to(F.col(second), vector)})
    best = F.greatest("__first", "__second")
    field = F.when((F.col("__second") > F.col("__first")) | F.col("__first").isNull(), F.lit(names[1])).otherwise(F.lit(names[0]))
    return scored.withColumns({"similarity": best, "match_field": field}).where(F.col("similarity").isNotNull()).drop("__first", "__second").orderBy(F.col("similarity").desc(), key).limit(top_k)


def at_least(found: DataFrame, min_similarity: float = 0.0) -> DataFrame:
    """Drop results below a similarity, after the top-k; zero drops none, not even negative ones."""
    return found.where(F.col("similarity") >= min_similarity) if min_similarity > 0 else found


def search_results(found: DataFrame) -> DataFrame:
    """The eight fields of a search result, without vectors."""
    return found.select("id", "file_path", name_from_id(F.col("id")).alias("name"), "kind", "description", "signature", "similarity", "match_field")


def format_results(found: DataFrame) -> DataFrame:
    """A printed line for each result."""
    return found.select(F.format_string("%6.3f  %-8s  %s::%s  (%s)", "similarity", "kind", "file_path", "name", "match_field").alias("line"))
