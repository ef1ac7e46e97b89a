"""What model calls cost: a fact table of calls and a dimension of rates, nothing kept in a process."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import dollars
from codeloom.schema import RATES

#: Public list prices in dollars per million tokens: input, output, cache read, cache write.
RATE_CARD = {
    "gpt-5.5": (5.00, 30.00, 0.50, 0.0),
    "gpt-5.4": (2.50, 15.00, 0.25, 0.0),
    "gpt-5.4-mini": (0.75, 4.50, 0.075, 0.0),
    "gpt-5.4-nano": (0.20, 1.25, 0.02, 0.0),
    "gpt-4.1": (2.00, 8.00, 0.0, 0.0),
    "gpt-4.1-mini": (0.40, 1.60, 0.0, 0.0),
    "gpt-4.1-nano": (0.10, 0.40, 0.025, 0.0),
    "text-embedding-3-small": (0.02, 0.0, 0.0, 0.0),
}


def rates(spark: SparkSession, card: dict[str, tuple[float, float, float, float]] | None = None) -> DataFrame:
    return spark.createDataFrame([(m, *r) for m, r in (card or RATE_CARD).items()], RATES)


def priced(calls: DataFrame, card: DataFrame) -> DataFrame:
    """Calls with their dollars; a model without a rate costs nothing. The rate card is a handful of rows by construction."""
    joined = calls.join(F.broadcast(card), "model", "left")
    counted = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("input_tokens", "output_tokens", "cache_read", "cache_creation", "embedding_tokens")}
    names = {"input": F.col("input"), "output": F.col("output"), "cache_read": card["cache_read"], "cache_write": F.col("cache_write")}
    generated = dollars(counted["input_tokens"], counted["output_tokens"], F.coalesce(calls["cache_read"], F.lit(0)), counted["cache_creation"], names)
    embedded = counted["embedding_tokens"] * F.coalesce(F.col("input"), F.lit(0.0)) / 1e6
    return joined.select(*[calls[c] for c in calls.columns], (generated + embedded).alias("dollars"))


def totals(priced_calls: DataFrame, by_model: bool = True) -> DataFrame:
    """Sums for each model and, with model null, over all; cache_hit_rate is 0 where nothing could be cached."""
    sums = [F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("input_tokens", "output_tokens", "cache_read", "cache_creation", "embedding_tokens")]
    grouped = priced_calls.rollup("model") if by_model else priced_calls.groupBy()
    summed = grouped.agg(F.count("*").alias("calls"), *sums, F.sum("dollars").alias("dollars"))
    return summed.withColumn("cache_hit_rate", F.coalesce(F.try_divide(F.col("cache_read"), F.col("input_tokens") + F.col("cache_creation")), F.lit(0.0)))


def call_dollars(model: str, usage: dict[str, int], card: dict[str, tuple[float, float, float, float]] | None = None) -> float:
    """What one call of the driver's costs."""
    fresh, out, read, write = (card or RATE_CARD).get(model, (0.0, 0.0, 0.0, 0.0))
    count = {k: usage.get(k) or 0 for k in ("input_tokens", "output_tokens", "cache_read", "cache_creation", "embedding_tokens")}
    billed = max(count["input_tokens"] - count["cache_read"], 0) + count["embedding_tokens"]
    return (billed * fresh + count["output_tokens"] * out + count["cache_read"] * read + count["cache_creation"] * write) / 1e6
