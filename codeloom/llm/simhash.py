"""Near-duplicate groups by SimHash fingerprints, linked through deletion-variant signatures.

A fingerprint bit is set if it is set in over half the XXH64 hashes of the text's 3-word shingles. Fingerprints that differ in ``BITS`` = 2 bits or fewer link. The
64 bits are cut into two segments, so one of them differs by one bit at most; each segment is indexed under its 32 one-wildcard variants, and
fingerprints that share a variant are joined and verified on all 64 bits.

Copies cost nothing: equal fingerprints are grouped first, and only distinct ones are indexed. Buckets of more than ``HOT`` fingerprints aren't joined pairwise but refined: members of a bucket agree in 31 bits of
one segment and differ in two bits of the other at most, so if that is cut into three parts, one part is equal. Sub-buckets by bucket and part agree in 41 bits and more. So a fingerprint has 64 signatures, and 256 if all
its buckets are crowded, which by chance they are from some 7 * 10^10 fingerprints on. The fingerprints of a sub-bucket that still has more than HOT are near each other by nature; they
are indexed under all 2016 two-wildcard variants of the whole fingerprint, where each bucket is by definition a set of linked fingerprints (four at most) and
links to its smallest member suffice. So every link is found, and the work is linear in the number of fingerprints. Components come from repeated label
contraction over the links, with a checkpoint in each round.

Defined results: null and empty texts and texts without words have fingerprint 0, which links like any other; a text of one or two words is one shingle. A null id
gets its own component's smallest non-null id; repeated rows give repeated results. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm._common import checkpointed, parts, texts, without_ids

SHINGLE, SEED, BITS, HOT, ROUNDS = 3, 42, 2, 32, 60
_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_CHUNK = 1 << 16


def fingerprint(text: str, words: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a whole text, as an unsigned number."""
    found = _WORDS(text.lower() if text.isascii() else text.translate(_LOWER))
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    digest = xxhash.xxh64_intdigest
    sums = np.zeros(64, np.int64)
    for first in range(0, n, _CHUNK):
        last = min(first + _CHUNK, n)
        part = found[first : last + words - 1]
        shingles = map(" ".join, zip(*[part[k:] for k in range(words)], strict=False)) if len(found) >= words else [" ".join(found)]
        hashes = np.fromiter((digest(x, SEED) for x in shingles), ">u8", last - first)
        sums += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(sums * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and its fingerprint as a signed bigint, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found = np.array([fingerprint(x) for x in texts(batch, text)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found)], ["doc_id", "fp"])

    return docs.select(doc_id, text).mapInArrow(run, "doc_id bigint, fp bigint")


def _one_wildcard() -> str:
    """SQL for the 64 signatures of fp: segment and wildcard number in the key's upper bits, the other 31 bits of the segment below."""
    low, high = "fp & 4294967295", "shiftrightunsigned(fp, 32)"
    return f"transform(sequence(0, 63), i -> shiftleft(cast(i AS bigint), 32) | ((CASE WHEN i < 32 THEN {low} ELSE {high} END) & ~shiftleft(1L, i % 32)))"


def _two_wildcards() -> str:
    """SQL for the 2016 signatures of fp: the pair of wildcard bits, and fp without them."""
    return "flatten(transform(sequence(0, 62), i -> transform(sequence(i + 1, 63), j -> struct(i * 64 + j AS w, fp & ~(shiftleft(1L, i) | shiftleft(1L, j)) AS m))))"


def indexed(distinct: DataFrame) -> DataFrame:
    """fp and key, 64 rows for each fingerprint, dealt by the key."""
    n = distinct.count()
    spread = distinct.repartition(max(1, n // 20_000), "fp").select("fp", F.explode(F.expr(_one_wildcard())).alias("key"))  # a few bytes that become many
    return spread.repartition(max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * 64 // 1_000_000), "key")


def refined(crowded: DataFrame) -> DataFrame:
    """fp, key and part, three rows for each row: parts of 11, 11 and 10 bits of the segment that the key isn't about."""
    other = "CASE WHEN shiftrightunsigned(key, 32) < 32 THEN shiftrightunsigned(fp, 32) ELSE fp & 4294967295 END"
    parts_of = f"transform(sequence(0, 2), p -> p * 2048 + (shiftrightunsigned({other}, 11 * p) & 2047))"
    return crowded.select("fp", "key", F.explode(F.expr(parts_of)).alias("part"))


def buckets(rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` whose key several fingerprints have, with n, how many; checkpointed."""
    several = F.min("fp") < F.max("fp")  # says the same as n > 1, and reads the columns that let both sides share a shuffle
    sizes = rows.groupBy(*key).agg(F.count("*").alias("n"), several.alias("several")).where("several").select(*key, "n")
    return checkpointed(rows.join(sizes, key))


def linked(rows: DataFrame, key: list[str]) -> DataFrame:
    """The pairs (a, b), a < b, of rows with one key that differ in BITS bits at most."""
    pairs = rows.select(*key, F.col("fp").alias("a")).join(rows.select(*key, F.col("fp").alias("b")), key)
    return pairs.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS)).select("a", "b")


def links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (a, b), a < b, between the distinct fingerprints of column fp, enough to connect all within BITS bits."""
    by_key = buckets(indexed(distinct), ["key"])
    found = linked(by_key.where(F.col("n") <= hot), ["key"])
    crowded = by_key.where(F.col("n") > hot).select("fp", "key")
    if crowded.isEmpty():
        return found.distinct()
    by_part = buckets(refined(crowded), ["key", "part"])
    found = found.unionByName(linked(by_part.where(F.col("n") <= hot), ["key", "part"]))
    whole = by_part.where(F.col("n") > hot).select("fp").distinct().select("fp", F.explode(F.expr(_two_wildcards())).alias("v")).select("fp", "v.w", "v.m")
    near = whole.groupBy("w", "m").agg(F.sort_array(F.collect_list("fp")).alias("f")).where(F.size("f") > 1)
    return found.unionByName(near.select(F.col("f")[0].alias("a"), F.explode(F.slice("f", 2, 4)).alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root for every node of the undirected edges (a, b): the smallest node of its component.

    Alternating star contraction: in each round every node links its larger neighbours, then its smaller ones, to the least of them. Nothing but counts reaches the driver.
    """
    edges = checkpointed(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    for _ in range(ROUNDS):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a != b").distinct()
        lower = large.groupBy("b").agg(F.min("a").alias("m"))
        small = checkpointed(large.join(lower, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a != b").distinct())
        stable = small.groupBy("b").agg(F.count("*").alias("n")).where("n > 1").isEmpty() and small.join(small.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty()
        edges = small
        if stable:
            break
    else:
        raise RuntimeError("components didn't settle")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (signed bigint) and component_id of every row.

    The table of ids and fingerprints, 16 bytes a row, is checkpointed: texts are read once.
    """
    rows = checkpointed(fingerprints(docs, doc_id, text))
    distinct = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    return with_components(rows, distinct, components(links(distinct.select("fp"))), "fp")


def hex_fingerprint(fp: Column) -> Column:
    """A signed fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of ``docs`` without the rows whose id isn't the smallest of a component."""
    return without_ids(docs, not_least(near_groups(docs, doc_id, text)), doc_id)


def not_least(groups: DataFrame) -> DataFrame:
    """The ids (column __nb_id) that aren't the smallest of a component in any of their rows."""
    least = F.max(F.col("component_id").eqNullSafe(F.col("doc_id")))
    return groups.groupBy(F.col("doc_id").alias("__nb_id")).agg(least.alias("least")).where("NOT least").select("__nb_id")


def with_components(rows: DataFrame, distinct: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """``rows`` with component_id: the least id (column least of ``distinct``) of all whose keys have one root; a key without a root stands alone."""
    rooted = roots.withColumnRenamed("node", "__cc_node")
    classes = distinct.join(rooted, F.col(key) == F.col("__cc_node"), "left").select(key, "least", F.coalesce("root", key).alias("root"))
    smallest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(smallest, "root").select(F.col(key).alias("own"), "component_id")
    return rows.join(named, rows[key] == named.own, "left").drop("own")
