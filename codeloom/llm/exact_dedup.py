"""Exact deduplication by progressive refinement, in DataFrame operations only.

Texts are equal when identical after lower-casing A-Z. Groups are refined in three steps: byte length, then a hash of a short prefix, then SHA-256 of the whole text. Lengths and prefix
hashes are counted first, a row for each key and task; the keys that several rows share go into a bitmap, which is broadcast: WORDS words of 64 bits at most (16 MB), whatever the data. A scan asks it for each row and
makes the SHA-256 of those it names only; a row that it names by chance is a group of one. So only ids and digests are shuffled, no text. Where there are more shared keys than bits, the bitmap names
more rows by chance and more digests are made and shuffled, with the same result: at 16 bits a key 6 % of the others, at one bit a key 63 %.

Every grouping is pre-aggregated before its shuffle, so a group with a third of all rows arrives as one row for each id and task, and the joins
that carry the group's verdict back to its rows are plain equi-joins, which adaptive execution splits when skewed.
``drop_exact_copies`` puts the rows to drop into a second bitmap: rows that it doesn't name pass from the scan as they are, and only the others - the copies and 6 % of the rest - are shuffled, for an exact anti-join.

Defined results: null text counts as empty, so null and empty texts form one group. A null id never wins over
another id; a group of null ids only has keep_id null and keeps all its rows. Rows that repeat both id and text are
one document: each gets the same verdict, and ``drop_exact_copies`` keeps one of them. Very long texts are hashed whole. An empty table gives no rows.
Other columns may have any name: internal names are prefixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm._common import checkpointed, named_by

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_CHARS = 64
_ID, _TEXT, _N, _P, _H, _X, _KEEP, _SIZE, _ROWS = ("__xd_id", "__xd_text", "__xd_len", "__xd_prefix", "__xd_hash", "__xd_as_is", "__xd_keep", "__xd_size", "__xd_rows")


def normalized(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else changed; null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _body(text: str) -> Column:
    return F.coalesce(F.col(f"`{text}`"), F.lit(""))


def _keys(text: str, prefix_chars: int) -> list[Column]:
    return [F.octet_length(_body(text)).alias(_N), F.xxhash64(normalized(F.substring(_body(text), 1, prefix_chars))).alias(_P)]


def shared_prefixes(docs: DataFrame, text: str, prefix_chars: int) -> DataFrame:
    """The (length, prefix hash) keys that more than one row has, checkpointed: steps one and two."""
    lengths = checkpointed(docs.groupBy(F.octet_length(_body(text)).alias(_N)).count().where("count > 1").select(_N))
    keyed = docs.select(*_keys(text, prefix_chars)).groupBy(_N, _P).count()  # a row for each key and task at most meets a common length
    return checkpointed(keyed.join(lengths, _N, "left_semi").where("count > 1").select(_N, _P))


def suspected(docs: DataFrame, text: str, doc_id: str, prefix_chars: int) -> DataFrame:
    """Id, text, keys, and ``__xd_shared``: whether the keys may be another row's, too."""
    rows = docs.select(F.col(f"`{doc_id}`").alias(_ID), _body(text).alias(_TEXT), *_keys(text, prefix_chars))
    return named_by(rows, shared_prefixes(docs, text, prefix_chars), [_N, _P], "__xd_shared")


def surviving(rows: DataFrame) -> DataFrame:
    """Id, keys, a hash of the text as it stands and the SHA-256 of the rows that may have a copy, checkpointed: step three."""
    digest = F.unhex(F.sha2(normalized(F.col(_TEXT)), 256))
    return checkpointed(rows.where("__xd_shared").select(_ID, _N, _P, F.xxhash64(_TEXT).alias(_X), digest.alias(_H)))


def groups_of(survivors: DataFrame) -> DataFrame:
    """Groups of equal texts of two rows or more: digest, kept id, size, and how many rows have the kept id. Checkpointed: a join with a finished table is one that skewed keys can be split in."""
    counts = survivors.groupBy(_H, _ID).agg(F.count("*").alias("__xd_n"))
    groups = counts.groupBy(_H).agg(F.max(_ID).alias(_KEEP), F.sum("__xd_n").alias(_SIZE), F.max_by("__xd_n", _ID).alias(_ROWS))
    return checkpointed(groups.where(F.col(_SIZE) > 1))


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", prefix_chars: int = PREFIX_CHARS, digest: str | None = None) -> DataFrame:
    """One row per row of ``docs``: its id, keep_id, group_size, kept, and if ``digest`` names a column, the SHA-256 of its normalised text, which is then made of every row."""
    rows = suspected(docs, text, doc_id, prefix_chars)
    survivors = surviving(rows).select(_ID, _H)
    found = survivors.join(groups_of(survivors), _H, "left").select(_ID, _KEEP, _SIZE, F.lower(F.hex(_H)).alias("__xd_hex"))
    alone = rows.where("NOT __xd_shared").select(_ID, F.lit(None).cast(docs.schema[doc_id].dataType).alias(_KEEP), F.lit(None).cast("bigint").alias(_SIZE), F.sha2(normalized(F.col(_TEXT)), 256).alias("__xd_hex"))
    keep = F.when(F.col(_SIZE).isNull(), F.col(_ID)).otherwise(F.col(_KEEP))
    columns = [F.col(_ID).alias(doc_id), keep.alias("keep_id"), F.coalesce(F.col(_SIZE), F.lit(1)).cast("bigint").alias("group_size"), keep.eqNullSafe(F.col(_ID)).alias("kept")]
    return found.unionByName(alone).select(*columns, *([F.col("__xd_hex").alias(digest)] if digest else []))


def drop_exact_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """The columns of ``docs`` for one row of each group of equal texts: the row with the largest id.

    The rows to drop are named by id, keys and a hash of the text as it stands, and taken out by an anti-join of those that their bitmap names. Where rows repeat an id and its text, one of those rows stays.
    """
    survivors = surviving(suspected(docs, text, doc_id, prefix_chars))
    judged = survivors.join(groups_of(survivors), _H)
    key, other = [_ID, _N, _P, _X], ["__xd_i", "__xd_l", "__xd_p", "__xd_x"]
    stays = F.col(_KEEP).eqNullSafe(F.col(_ID))
    dropped = checkpointed(judged.where(~stays | (F.col(_ROWS) > 1)).select(*key, _H, stays.alias("__xd_once")))  # not grouped, so that a large group's rows can be split in the join
    own = [F.col(f"`{c}`") for c in docs.columns]
    marked = named_by(docs.select(*own, F.col(f"`{doc_id}`").alias(_ID), *_keys(text, prefix_chars), F.xxhash64(_body(text)).alias(_X)), dropped, key, "__xd_dropped")
    again = dropped.select(*[F.col(a).alias(b) for a, b in zip(key, other, strict=True)], _H, "__xd_once")
    same = F.col(_ID).eqNullSafe(F.col("__xd_i")) & (F.col(_N) == F.col("__xd_l")) & (F.col(_P) == F.col("__xd_p")) & (F.col(_X) == F.col("__xd_x"))
    clear, doubtful = marked.where("NOT __xd_dropped").select(*own), marked.where("__xd_dropped")
    kept = clear.unionByName(doubtful.join(again, same, "left_anti").select(*own))
    repeated = again.where("__xd_once").drop("__xd_once").distinct()
    if repeated.isEmpty():
        return kept
    return kept.unionByName(doubtful.join(repeated, same).dropDuplicates([_H]).select(*own))
