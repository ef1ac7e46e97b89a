"""Whitening of embeddings by hierarchical merging of singular value decompositions.

Each partition of the fit list keeps a state: its number of vectors, their mean, and all singular values and right vectors of the centred vectors. Two states merge by stacking both scaled bases and one more row,
sqrt(n1 n2 / (n1 + n2)) times the difference of the means, and decomposing the stack again: what comes out is the decomposition of both sets together, with every dimension kept. Partitions fold their batches so, and
their states meet FAN at a time, level by level, so no task holds more than FAN states of the square of the dimension, and the driver gets one. Vectors are centred before any product; sums are Python integers, so means and deviations are exact.
A second decomposition of the same kind, of the whitened fit list, gives the error against the identity.

The fit list is each distinct vector once, grouped by Spark with a partial aggregate, so a vector that a third of the rows have is shuffled once for each task; it is checkpointed, being read twice.

Defined results: a row whose vector is null, or holds a null, NaN, infinite entry or one of 1e17 and more (which has no 64-bit x), is dropped. The dimension is the commonest length (of equally common ones the greatest); rows of other
lengths are another space and dropped, as are empty vectors. Rows that repeat an id, or a vector, or are null in the id each get their rows. Equal eigenvalues go in the order that the decomposition gives, the same for all rows; the greatest entry of a
component is positive. A component without variance (to within rounding) has whitened and explained 0 and doesn't count in identity_error; with one distinct vector that is all of them. A deviation that is no 64-bit number is null. An empty table gives no rows.
Other columns are left out, so their names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm._common import checkpointed, release

SCALE, COMPONENTS, FAN, BLOCK = 64, 16, 8, 4096
#: Entries from here on have no 64-bit x.
TOO_LARGE = 1e17
#: Of the greatest singular value, times the dimension: less is rounding.
NOISE = 1e-14
STATE = "node bigint, n bigint, totals array<string>, mean array<double>, scale array<double>, basis array<double>"


@dataclass
class State:
    """A set of vectors: their number, exact sums (of whole numbers only), mean, singular values and right vectors."""

    n: int
    totals: list[int]
    mean: np.ndarray
    scale: np.ndarray
    basis: np.ndarray

    def row(self, node: int) -> dict:
        return {"node": node, "n": self.n, "totals": [str(x) for x in self.totals], "mean": self.mean.tolist(), "scale": self.scale.tolist(), "basis": self.basis.ravel().tolist()}

    @classmethod
    def of(cls, row: dict) -> State:
        return cls(row["n"], [int(x) for x in row["totals"]], np.array(row["mean"]), np.array(row["scale"]), np.array(row["basis"]).reshape(-1, len(row["mean"])))


def decomposed(vectors: np.ndarray) -> State:
    """The state of the rows of a matrix; sums are exact where its numbers are whole."""
    totals: list[int] = []
    if vectors.dtype == np.int64:
        totals = [(int(high) << 32) + int(low) for high, low in zip((vectors >> 32).sum(0), (vectors & 0xFFFFFFFF).sum(0), strict=True)]
    values = vectors.astype(np.float64)
    mean = np.array([t / len(vectors) for t in totals]) if totals else values.mean(0)
    _, scale, basis = np.linalg.svd(values - mean, full_matrices=False)
    return State(len(vectors), totals, mean, scale, basis)


def merged(a: State, b: State) -> State:
    """The state of both sets together."""
    n = a.n + b.n
    totals = [x + y for x, y in zip(a.totals, b.totals, strict=True)]
    correction = np.sqrt(a.n / n * b.n) * (a.mean - b.mean)
    _, scale, basis = np.linalg.svd(np.vstack([a.scale[:, None] * a.basis, b.scale[:, None] * b.basis, correction]), full_matrices=False)
    return State(n, totals, np.array([t / n for t in totals]) if totals else a.mean + (b.mean - a.mean) * (b.n / n), scale, basis)


_FORM = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("totals", pa.list_(pa.string())), ("mean", pa.list_(pa.float64())), ("scale", pa.list_(pa.float64())), ("basis", pa.list_(pa.float64()))])


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def fit(vectors: DataFrame, size: int) -> State | None:
    """The state of a table of vectors (its only column) of one length, or None if it is empty."""
    fan, block = FAN, max(BLOCK, 4 * size)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for first in range(0, batch.num_rows, block):
                own = decomposed(_matrix(batch.column(0).slice(first, block), size))
                state = own if state is None else merged(state, own)
        if state is not None:
            yield pa.RecordBatch.from_pylist([state.row(TaskContext.get().partitionId())], _FORM)
        release()

    def meet(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["node"])
        state = State.of(rows[0])
        for row in rows[1:]:
            state = merged(state, State.of(row))
        return pa.Table.from_pylist([state.row(rows[0]["node"] // fan)], _FORM)

    states = checkpointed(vectors.mapInArrow(fold, STATE))
    nodes = states.agg(F.max("node")).first()[0]
    while nodes:
        states, nodes = states.groupBy(F.floor(F.col("node") / fan)).applyInArrow(meet, STATE), nodes // fan
    rows = states.collect()
    return State.of(rows[0].asDict()) if rows else None


def whole_numbers(vector: Column) -> Column:
    """floor(SCALE c) of each entry: x without its offset, which changes neither covariances nor deviations."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("bigint"))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are numbers of a 64-bit x."""
    return F.coalesce(F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < TOO_LARGE, F.lit(False))), F.lit(False))


def deviations(values: np.ndarray, n: int, totals: list[int]) -> list[int | None]:
    """The sum of (n y - S)^2 over each row's entries, exactly; None where it has no 64 bits."""
    rough = ((values.astype(np.float64) * n - np.array([float(t) for t in totals])) ** 2).sum(1)
    if rough.max(initial=0) < 2.0**62 and float(np.abs(values).max(initial=0)) * n < 2.0**62 and max(map(abs, totals), default=0) < 2**62:
        return ((values * n - np.array(totals, np.int64)) ** 2).sum(1).tolist()
    exact = [sum((n * int(y) - t) ** 2 for y, t in zip(row, totals, strict=True)) for row in values]
    return [x if x < 2**63 else None for x in exact]


def axes(state: State, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The leading components as rows divided by the root of their eigenvalue (zeros for those without variance), their shares of the trace, and which have variance."""
    k = min(most, len(state.mean))
    scale, basis = np.zeros(len(state.mean)), np.zeros((len(state.mean), len(state.mean)))
    scale[: len(state.scale)], basis[: len(state.scale)] = state.scale, state.basis
    real = scale > scale.max(initial=0) * len(scale) * NOISE
    greatest = np.take_along_axis(basis, np.abs(basis).argmax(1)[:, None], 1)
    root = np.sqrt(scale**2 / state.n)
    rows = np.divide(basis * np.where(greatest < 0, -1.0, 1.0), root[:, None], out=np.zeros_like(basis), where=real[:, None])
    shares = np.where(real, scale**2, 0.0) / ((scale**2).sum() or 1.0)
    return rows[:k], shares[:k], real[:k]


def whiten(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """For each usable row and leading component: ``key``, component, n, deviation, whitened, explained, identity_error."""
    spark, kind = rows.sparkSession, rows.schema[key].dataType
    own = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("vector")).where(usable(F.col("vector"))).select("key", whole_numbers(F.col("vector")).alias("y"))
    common = own.groupBy(F.size("y").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    result = T.StructType([T.StructField(key, kind), T.StructField("component", T.IntegerType()), *[T.StructField(c, k) for c, k in (("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType()))]])
    if common is None or not common["size"]:
        return spark.createDataFrame([], result)
    size = common["size"]
    own = own.where(F.size("y") == size)
    listed = checkpointed(own.select("y").distinct())
    state = fit(listed, size)
    projection, shares, real = axes(state, components)
    mean, n, totals = state.mean, state.n, state.totals

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = ((_matrix(batch.column(0), size) - mean) @ projection.T).ravel()
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, len(projection)), pa.int32()), pa.array(flat))], ["w"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _matrix(batch.column(1), size)
            flat = ((values - mean) @ projection.T).ravel()
            white = pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, len(projection)), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviations(values, n, totals), pa.int64()), white], ["key", "deviation", "w"])

    seen = fit(listed.mapInArrow(project, "w array<double>"), len(projection))
    covariance = (seen.basis.T * seen.scale**2 / n) @ seen.basis
    error = float(np.abs(covariance - np.eye(len(projection)))[np.ix_(real, real)].max(initial=0.0))
    placed = own.mapInArrow(place, T.StructType([T.StructField("key", kind), T.StructField("deviation", T.LongType()), T.StructField("w", T.ArrayType(T.DoubleType()))]))
    each = placed.select("key", "deviation", F.posexplode("w").alias("at", "whitened"))
    share = F.element_at(F.array(*[F.lit(float(x)) for x in shares]), F.col("at") + 1)
    return each.select(F.col("key").alias(key), (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
