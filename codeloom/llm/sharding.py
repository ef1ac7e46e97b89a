"""Reproducible shuffle into shards: a Feistel permutation over global row numbers, in DataFrame operations only.

Rows get a global number without a global sort: id, size and checksum of the text are hashed into buckets, so that a null or repeated id is spread by its texts; a row's number is the count of the
buckets before its own plus its rank within it. The numbers are permuted by an alternating numeric Feistel network
over a x b >= rows; positions beyond the last row walk the cycle until they fall inside. Position p lies in shard
p mod shards at slot p div shards, so shard and slot of any row number can be computed without the data.

The law is ``rows``: counts of two shards differ by one at most, slots are gapless. Bucket counts are bounded by
MAX_BUCKETS rows, hence the broadcast has a proven bound (1 MB). The result depends on the rows only, not on
partitioning. Defined results: null text has 0 bytes; rows with equal ids are ordered by size and checksum; rows equal in
all three are interchangeable and share a bucket, whose window sorts them by spilling. Very long texts are read whole; other columns may have any name, but those that start with __sh_. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm._common import checkpointed

ROUNDS, ROWS_PER_BUCKET, MAX_BUCKETS, WALK = 6, 20_000, 65_536, 64


def _network(p: Column, a: int, b: int, seed: int) -> Column:
    """One pass of the permutation over [0, a * b)."""
    a_, b_ = F.lit(a).cast("bigint"), F.lit(b).cast("bigint")
    right = F.pmod(p, b_)
    halves = F.struct(((p - right) / b_).cast("bigint").alias("l"), right.alias("r"))

    def step(s: Column, i: Column) -> Column:
        left = F.when(i % 2 == 0, F.pmod(s.l + F.pmod(F.xxhash64(F.lit(seed), i, s.r), a_), a_)).otherwise(s.l)
        right = F.when(i % 2 == 1, F.pmod(s.r + F.pmod(F.xxhash64(F.lit(seed), i, s.l), b_), b_)).otherwise(s.r)
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), halves, step, lambda s: s.l * b_ + s.r)


def permuted(row: Column, rows: int, seed: int) -> tuple[Column, Column]:
    """The column ``__sh_first`` for a row number, and from it the row's place after the shuffle of ``rows`` rows.

    The domain a * b exceeds ``rows`` by less than its square root, so a walk of WALK steps ends by certainty for
    up to WALK squared rows and beyond that but for a chance below rows ** -31; a walk that did not end raises.
    """
    a = max(1, math.isqrt(max(rows, 1) - 1) + 1)
    b = max(1, -(-rows // a))
    n = F.lit(rows).cast("bigint")
    first = _network(row, a, b, seed)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.col("__sh_first"), lambda p, _: F.when(p < n, p).otherwise(_network(p, a, b, seed)))
    return first, F.when(F.col("__sh_first") < n, F.col("__sh_first")).otherwise(walked)


def shard(docs: DataFrame, shards: int, seed: int = 0, text: str = "text", doc_id: str = "doc_id", columns: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` (or some columns) with size, text_crc32, shard and slot; columns of these names are replaced.

    One shuffle, on the bucket, with only the asked columns. Where these are the id at most, its table with size and checksum is checkpointed, so that texts are read once. To write shards: partition by shard, sort by slot.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    columns = [c for c in (docs.columns if columns is None else columns) if c not in ("size", "text_crc32", "shard", "slot")]
    rows = docs.count()
    buckets = min(MAX_BUCKETS, max(1, rows // ROWS_PER_BUCKET))
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    size, crc = (F.octet_length(body) + 8).cast("bigint"), F.crc32(body).cast("bigint")
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(f"`{doc_id}`"), size, crc), F.lit(buckets).cast("bigint")).cast("int")
    keyed = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{doc_id}`").alias("__sh_id"), bucket.alias("__sh_bucket"), size.alias("size"), crc.alias("text_crc32"))
    if set(columns) <= {doc_id}:
        keyed = checkpointed(keyed)
    counts = keyed.groupBy("__sh_bucket").count()
    before = Window.orderBy("__sh_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__sh_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__sh_start"))
    rank = F.row_number().over(Window.partitionBy("__sh_bucket").orderBy("__sh_id", "size", "text_crc32")) - 1
    numbered = keyed.withColumn("__sh_rank", rank).join(F.broadcast(starts), "__sh_bucket").withColumn("__sh_row", F.col("__sh_start") + F.col("__sh_rank"))
    first, place = permuted(F.col("__sh_row"), rows, seed)
    placed = numbered.withColumn("__sh_first", first).withColumn("__sh_place", place)
    n = F.lit(shards).cast("bigint")
    checked = F.when(F.col("__sh_place") < rows, F.col("__sh_place")).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("bigint"))
    placed = placed.withColumn("__sh_place", checked)
    return placed.select(
        *[F.col(f"`{c}`") for c in columns], "size", "text_crc32", F.pmod(F.col("__sh_place"), n).cast("int").alias("shard"),
        ((F.col("__sh_place") - F.pmod(F.col("__sh_place"), n)) / n).cast("bigint").alias("slot"),
    )
