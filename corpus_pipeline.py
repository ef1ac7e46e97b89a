"""A corpus pipeline of five stages over ``documents``; each works on all that its predecessor kept.

Language identification drops documents without a language (no letters, or undecided between languages); exact dedup keeps the largest id of equal texts; near-dedup
keeps the smallest id of each group of texts whose word sets have a similarity of 0.8 or more, estimated by wide SimHash fingerprints; suffix dedup cuts passages of 50 bytes and more that an earlier document holds; packing lays out training sequences.
Nulls, empty texts, repeated rows and empty tables follow the operators' definitions. Columns of any name pass the stages up to the last as they are, but for text and n_chars, which suffix dedup changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import exact_dedup, langid, near_copies, packing, suffix_dedup
from codeloom.llm._common import checkpointed
from codeloom.llm.queries import BYTE_BPE

#: Below this score a text is undecided between languages. A text that is clearly of one language scores over 0.9, a single word over 0.5.
UNDECIDED = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.predict(docs, langid.train(docs), pred="__cp_lang", score="__cp_score")
    return found.where((F.col("__cp_lang") != "und") & (F.col("__cp_score") >= UNDECIDED)).drop("__cp_lang", "__cp_score")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.drop_near_copies(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = suffix_dedup.remove_repeats(docs, counts=False)
    return cleaned.withColumn("n_chars", F.length("text").cast("bigint")).select(*[F.col(f"`{c}`") for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, BYTE_BPE)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeated_passages),
    ("packing", pack_sequences),
]

#: SQL can express neither the learnt model nor the fingerprints; tests hold the stages against brute force and planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is checkpointed, as the next one reads it more than once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
    return docs
