"""Near copies by wide SimHash fingerprints of word sets, linked through the deletion-variant signatures of ``simhash``.

Near copies here are texts whose sets of words have a Jaccard similarity of ``ALIKE`` = 0.8 or more. With J the similarity, the sets' cosine is 2 J / (1 + J) for sets of one size, and a bit of their fingerprints
differs with a probability of acos(cosine) / pi: 0.1515 at 0.8. In 64 bits that is 10 bits, far more than segments could guarantee; so the fingerprint is as wide as it must be for segments of ``width`` bits
that differ in one bit at most to be likely. Texts of which a segment differs in one bit at most are joined and verified on all bits: at most FLIPPED of them may differ. Segments that differ in one bit differ in parity, so each is indexed under itself, and
those of odd parity also visit all that differ from them in one bit: half as many signatures as one-wildcard variants, and a pair meets once for each such segment, where equal segments share all their variants.

The width follows the number of fingerprints, so that buckets don't fill by chance, and the number of segments follows the width, so that a pair with a share of EXPECTED differing bits (a similarity of 0.87) is missed with a
probability of MISSED at most: 24 bits and 14 segments up to a million texts, 28 and 21 up to 16 million, 41 and 85 for 10^11. A text has (1 + width / 2) * segments signatures of 16 bytes on average: 3 KB, 5 KB and 29 KB. That is the price of the
method: fingerprints of texts that are alike by 0.8 are far apart.

First each node is joined with a few near owners of its buckets, which is linear and finds most groups: OFFERS * PICKS at most, by orders that are the same for all nodes, however many of its buckets a group shares. The groups so far give each node a root, and buckets with several roots are joined
pairwise, but for pairs of one root: so no link is lost, and large groups of near copies cost little here. Pairs of such buckets are compared on MORE bits before they meet all their segments: of those that meet by chance, most differ there.
A bucket of more than ``HOT`` nodes is cut into parts of about HOT by a hash, and each part meets each other, in tasks of their own: no pair of a bucket is left out. The work on a bucket is the square of its nodes only where many of them share a segment and are in different groups, as
texts of one template may be; by chance, buckets don't fill.

Defined results: words are those of ``simhash``, A-Z lower-cased; null and empty texts and texts without words are one node, equal to each other only. Texts with one set of words are one node, so copies cost nothing. A null id
gets its component's smallest non-null id; repeated rows give repeated results; very long texts count whole. An empty table gives no rows. Other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm._common import checkpointed, named_by, parts, release, texts, without_ids
from codeloom.llm.simhash import _LOWER, _WORDS, components, not_least, with_components

ALIKE, EXPECTED, MISSED, LEAST_WIDTH, HOT, OFFERS, PICKS = 0.8, 0.12, 0.05, 24, 4096, 4, 3
FLIPPED = math.acos(2 * ALIKE / (1 + ALIKE)) / math.pi
CHECK, CHECK_FLIPPED = 32, 12  # bits of a node's number that are bits of the fingerprint, and how many of them may differ: of pairs at FLIPPED some 6 in 10,000 have more
MORE, MORE_FLIPPED = 48, 24  # bits of the segments that nodes of crowded keys compare besides, and how many of these and of the CHECK bits may differ together: of pairs at FLIPPED some 2 in 10,000 have more
_CHUNK = 1 << 12


def shape(n: int) -> tuple[int, int]:
    """Width and number of the segments for ``n`` fingerprints."""
    width = max(LEAST_WIDTH, math.ceil(math.log2(max(n, 1))) + 4)
    like = (1 - EXPECTED) ** width + width * EXPECTED * (1 - EXPECTED) ** (width - 1)
    return width, math.ceil(math.log(MISSED) / math.log(1 - like))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def bits(text: str | None, n: int) -> np.ndarray:
    """The first ``n`` bits of the text's fingerprint: set where more than half of its words have them."""
    text = text or ""
    found = set(_WORDS(text.lower() if text.isascii() else text.translate(_LOWER)))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in found), np.uint64, len(found))
    lanes = np.arange(1, -(-n // 64) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sums = np.zeros(len(lanes) * 64, np.int64)
    for first in range(0, len(hashes), _CHUNK):
        lane = _mixed(hashes[first : first + _CHUNK, None] + lanes)
        sums += np.unpackbits(lane.view(np.uint8).reshape(len(lane), -1), axis=1).sum(0, dtype=np.int64)
    return (sums * 2 > len(found))[:n]


def fingerprints(docs: DataFrame, width: int, segments: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, node and segments of every row. A node's upper half is bits of the fingerprint, its lower half a hash of all of them."""
    values = 1 << np.arange(width, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 500):
            found = np.array([bits(x, CHECK + width * segments) for x in texts(batch, text)])
            check = np.packbits(found[:, :CHECK], axis=1).view(">u4").ravel().astype(np.int64)
            hashed = np.array([xxhash.xxh32_intdigest(row.tobytes()) for row in np.packbits(found, axis=1)], np.int64)
            cut = found[:, CHECK:].reshape(-1, width) @ values
            lists = pa.ListArray.from_arrays(np.arange(0, len(cut) + 1, segments, dtype=np.int32), pa.array(cut))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(check << 32 | hashed), lists], ["doc_id", "node", "segments"])
        release()

    return docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).mapInArrow(run, "doc_id bigint, node bigint, segments array<bigint>")


def signatures(distinct: DataFrame, width: int) -> DataFrame:
    """node, key and own: number and value of a segment, which is the node's own or, for own ones of odd parity, differs from it in one bit. Of two nodes with one key, at least one of them its owner, the segment differs in one bit at most; and two such nodes have one such key for the segment. A column more of ``distinct`` is kept."""
    kept = [c for c in distinct.columns if c == "more"]
    cut = distinct.select("node", *kept, F.posexplode("segments").alias("s", "v")).select("node", *kept, "s", "v", F.explode(F.expr(f"sequence(-1, if(bit_count(v) % 2 = 1, {width - 1}, -1))")).alias("i"))
    return cut.select("node", *kept, F.expr("shiftleft(cast(s AS bigint), 48) | if(i < 0, v, v ^ shiftleft(1L, i))").alias("key"), F.expr("i < 0").alias("own"))


def further(width: int) -> Column:
    """MORE bits of the first segments."""
    bits = " | ".join(f"shiftleft(segments[{k}], {k * width})" for k in range(-(-MORE // width)))
    return F.expr(f"({bits}) & {(1 << MORE) - 1}L")


_NEAR = f"a < b AND bit_count(shiftrightunsigned(a ^ b, 32)) <= {CHECK_FLIPPED}"


def _near(a: str, b: str, more_a: str, more_b: str) -> str:
    """Of nodes with more bits: as many of both differ as may."""
    return f"bit_count(shiftrightunsigned({a} ^ {b}, 32)) + bit_count({more_a} ^ {more_b}) <= {MORE_FLIPPED}"


def proposed(distinct: DataFrame, width: int) -> tuple[DataFrame, DataFrame | None]:
    """Pairs (a, b), a < b, of the distinct nodes (node, segments, perhaps more) that are near in the bits that they have at hand: those of keys of two, and ``picked`` ones of other keys. And the signatures of keys that have an owner and more than two nodes.

    A key's least and greatest node are the pair of a key of two, which most shared keys are. Only signatures of keys with more nodes are made again, named by a bitmap, and joined.
    """
    signed = signatures(distinct.repartition(max(1, distinct.count() // 5_000), "node"), width)
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = [F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("b"), F.min(F.when(F.col("own"), F.col("node"))).alias("low")]
    sizes = signed.select("key", "node", "own").repartition(max(parts, distinct.count() * 256 // 2_000_000), "key").groupBy("key").agg(*counted)
    shared = checkpointed(sizes.where(f"low IS NOT NULL AND a < b AND (n > 2 OR {_NEAR})"))
    pairs, several = shared.where("n = 2").select("a", "b"), shared.where("n > 2").select("key", "n", "low")
    if several.isEmpty():
        return pairs.distinct(), None
    more = "more" if "more" in distinct.columns else F.lit(0).cast("bigint").alias("more")
    rows = checkpointed(named_by(signed, several, ["key"], "named").where("named").select("key", "node", "own", more).join(several, "key"))
    return pairs.unionByName(picked(rows)).distinct(), rows


def picked(rows: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of each node with near owners of its keys: a key offers OFFERS owners, the first in as many orders by a hash, and a node takes of each the first in PICKS orders, nearer ones (by eights of bits) before others.
    The orders are the same for all, so nodes of a group meet in few owners; a node has OFFERS * PICKS pairs at most, however many of its keys a group shares."""
    first = [F.min_by(F.col(c), F.xxhash64("node", F.lit(k))).alias(f"{c}{k}") for k in range(OFFERS) for c in ("node", "more")]
    offered = rows.where("own").groupBy("key").agg(*first)
    flipped = [f"bit_count(shiftrightunsigned(node{k} ^ node, 32)) + bit_count(more{k} ^ more)" for k in range(OFFERS)]
    order = [f"if(node{k} <> node AND {x} <= {MORE_FLIPPED}, shiftleft(cast(({x}) div 8 AS bigint), 60) | shiftrightunsigned(xxhash64(node{k}, {{j}}), 4), NULL)" for k, x in enumerate(flipped)]
    taken = F.array_distinct(F.array(*[F.min_by(f"node{k}", F.expr(order[k].format(j=OFFERS * j + k))) for k in range(OFFERS) for j in range(PICKS)]))
    owners = rows.select("key", "node", "more").join(offered, "key").groupBy("node").agg(taken.alias("owners"))
    return owners.select("node", F.explode("owners").alias("o")).where("o IS NOT NULL").select(F.least("o", "node").alias("a"), F.greatest("o", "node").alias("b"))


def across(rows: DataFrame, roots: DataFrame, hot: int) -> DataFrame:
    """All pairs of a key's owners with each other and with its visitors that are near in the CHECK bits and in more and have no common root yet. A key of more than ``hot`` nodes is cut into parts of about so many, and a pair of parts is joined by itself."""
    known = roots.select(F.col("node").alias("known"), "root")
    named = named_by(rows.select("key", "n", "node", "own", "more"), roots.select("node"), ["node"], "named")  # most nodes of crowded keys have no root but themselves
    found = named.where("named").drop("named").join(known, F.col("node") == F.col("known"), "left").select("key", "n", "node", "own", "more", F.coalesce("root", "node").alias("root"))
    rooted = checkpointed(found.unionByName(named.where("NOT named").drop("named").withColumn("root", F.col("node"))))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    rooted = checkpointed(named_by(rooted, checkpointed(mixed), ["key"], "mixed").where("mixed").drop("mixed").join(mixed, "key"))
    count = F.greatest(F.ceil(F.col("n") / hot).cast("int"), F.lit(1))
    parted = rooted.where(F.col("n") > hot).withColumns({"parts": count, "part": F.pmod(F.xxhash64("key", "node"), count).cast("int")})
    other, zero = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), F.lit(0)
    whole = rooted.where(F.col("n") <= hot)

    def owners(some: DataFrame, i: Column, j: Column) -> DataFrame:
        return some.where("own").select("key", F.col("node").alias("p"), F.col("more").alias("u"), F.col("root").alias("x"), i.alias("i"), j.alias("j"))

    def nodes(some: DataFrame, i: Column, j: Column) -> DataFrame:
        return some.select("key", F.col("node").alias("q"), F.col("more").alias("v"), F.col("root").alias("y"), "own", i.alias("i"), j.alias("j"))

    left, right = owners(parted, F.col("part"), other).unionByName(owners(whole, zero, zero)), nodes(parted, other, F.col("part")).unionByName(nodes(whole, zero, zero))
    met = left.join(right, ["key", "i", "j"]).where("x <> y AND (NOT own OR p < q) AND " + _near("p", "q", "u", "v"))
    return met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def verified(pairs: DataFrame, distinct: DataFrame, width: int, segments: int) -> DataFrame:
    """The pairs of which at most FLIPPED of all bits differ."""
    left, right = distinct.select(F.col("node").alias("a"), F.col("segments").alias("x")), distinct.select(F.col("node").alias("b"), F.col("segments").alias("y"))
    flipped = " + ".join(f"bit_count(x[{k}] ^ y[{k}])" for k in range(segments))
    return pairs.join(left, "a").join(right, "b").where(f"{flipped} <= {math.floor(FLIPPED * width * segments)}").select("a", "b")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, node and component_id of every row; texts are read once."""
    width, segments = shape(docs.count())
    rows = checkpointed(fingerprints(docs, width, segments, doc_id, text))
    distinct = checkpointed(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("segments").alias("segments")).withColumn("more", further(width)))
    pairs, signed = proposed(distinct, width)
    roots = components(verified(pairs, distinct, width, segments))
    if signed is not None:
        roots = checkpointed(roots)
        links = verified(across(signed, roots, hot), distinct, width, segments)
        roots = components(links.unionByName(roots.select(F.col("root").alias("a"), F.col("node").alias("b"))))
    return with_components(rows.select("doc_id", "node"), distinct.select("node", "least"), roots, "node")


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of ``docs`` without the rows whose id isn't the smallest of a component."""
    return without_ids(docs, not_least(near_groups(docs, doc_id, text)), doc_id)
