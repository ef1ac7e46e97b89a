"""Document fingerprints by Order MinHash, which follow the edit distance and not only the set of words.

The k-mers of a text (of code points) are numbered by occurrence, so that the second copy of one is another element. Each of SKETCHES sketches has an order of all elements, takes the TUPLE least of them, puts them back into
their order in the text and hashes that tuple to 16 bits; a fingerprint is the sketches' hashes. Two texts agree in a sketch if the same elements stand there in the same order, and their likeness is the share of sketches in
which they agree. The orders are ORDERS random ones, each turned to SHIFTS starting points: elements are sorted once for each random order, and a turned order's least elements are those that follow its starting point. So a sketch costs a search in what is sorted. The share is as
expected of independent orders; on texts of fewer elements than sketches it varies more.

``compare_neighbours`` compares each text with the next document and with a text edited by it. Documents are dealt once by ranges of descending id; a task walks its range in order, so each text meets the next with one text held. The last text of each range
meets the first of the next range in a second, small step: a text for each range at most, joined by the number of the range, of which the driver sorts the numbers. Rows of one id are ordered by a hash of their text, and equal rows by their place in
the input, so that neither an id nor a repeated row lands in one range; that place must be the same when a task is made again, so ``docs`` is to be a stored table or a checkpoint.

Defined results: null text counts as empty; a text of fewer than K code points is one element. A text with fewer elements than TUPLE makes tuples of those it has. The fingerprint of an empty text is all zeros; two empty texts have likeness 1, an empty and another one 0. Equal
texts have equal fingerprints. Null ids stand last. A single document is its own next. Very long texts are taken whole, one in memory at a time. An empty table gives no rows. Other columns are left out, so their names don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm._common import checkpointed, parts, release, texts

K, ORDERS, SHIFTS, TUPLE = 8, 2, 32, 2
SKETCHES = ORDERS * SHIFTS
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_RULE = np.random.default_rng(12)
_TIMES = (_RULE.integers(0, 1 << 32, ORDERS, np.uint64) | np.uint64(1)).astype(np.uint32)
_STARTS = np.sort(_RULE.integers(0, 1 << 32, (ORDERS, SHIFTS), np.uint64), axis=1) << np.uint64(32)
_SKETCH = _RULE.integers(0, 1 << 63, SKETCHES, np.uint64)
_LOW = np.uint64(0xFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _MIX
    x ^= x >> np.uint64(29)
    return x


def elements(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A 32-bit hash of each occurrence-numbered k-mer of a text, and its position."""
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    if not len(h):
        return np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    if len(h) < K:
        h = np.concatenate([h, np.zeros(K - len(h), np.uint64)])
    span, times = 1, _ODD
    with np.errstate(over="ignore"):
        while span < K:  # a polynomial of twice as many code points each time
            h, span, times = h[:-span] * times + h[span:], span * 2, times * times
    h = _mixed(h * _ODD)
    bits = np.uint64(max(1, len(h).bit_length()))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    order = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    order.sort()  # equal k-mers together, in order of position
    at = order & mask
    order >>= bits
    again = np.flatnonzero(order[1:] == order[:-1]) + 1
    h = h[at.astype(np.int64)]
    if len(again):  # runs of equal ones are few: number them by themselves
        run = np.concatenate([[True], np.diff(again) > 1])
        starts = again[run] - 1
        h[again] += (again - starts[np.cumsum(run) - 1]).astype(np.uint64) * _ODD
    return (h * _MIX >> np.uint64(32)).astype(np.uint32), at


def fingerprint(text: str) -> np.ndarray:
    """The SKETCHES 16-bit hashes of a text."""
    own, at = elements(text)
    if not len(own):
        return np.zeros(SKETCHES, np.uint16)
    size, chosen = min(TUPLE, len(own)), []
    for times, starts in zip(_TIMES, _STARTS, strict=True):
        order = (own * times).astype(np.uint64)
        order <<= np.uint64(32)
        order |= at
        order.sort()
        chosen.append(order[(np.searchsorted(order, starts)[:, None] + np.arange(size)) % len(order)])
    chosen = np.concatenate(chosen)
    chosen = np.sort((chosen << np.uint64(32)) | (chosen >> np.uint64(32)), axis=1) & _LOW  # in order of position
    h = _SKETCH
    for k in range(TUPLE):
        h = _mixed((h + (chosen[:, k] if k < size else _LOW + np.uint64(1))) * _ODD)
    return (h >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray, a_empty: bool, b_empty: bool) -> float:
    """The share of equal sketches."""
    if a_empty or b_empty:
        return float(a_empty and b_empty)
    return float((a == b).mean())


def edited(text: str, other: str) -> str:
    """``text`` with its last half (rounded down) replaced by as much of the beginning of ``other``, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


FOUND = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_FORM = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_ENDS = [("end", pa.int32()), ("part", pa.int32()), ("text", pa.string())]
FIRST, LAST = 1, 2


def _stored(sketches: np.ndarray) -> bytes:
    return sketches.astype(">u2").tobytes()


def compared(doc_id: int | None, text: str, own: np.ndarray, other: str, next_own: np.ndarray) -> dict:
    """A document's row, given the next document's text and both fingerprints."""
    new = edited(text, other)
    new_own = own if new == text else next_own if new == other else fingerprint(new)
    return {
        "doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), "fingerprint": _stored(own), "edited_fingerprint": _stored(new_own),
        "near_edited": likeness(own, new_own, not text, not new), "near_next": likeness(own, next_own, not text, not other),
    }


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one range, in order: each but the last compared with the next; the first and the last also as ends with their text."""
    form, part, held = pa.schema([*_FORM, *_ENDS]), TaskContext.get().partitionId(), None
    for batch in parts(batches, 200):
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch, "text"), strict=True):
            own = fingerprint(text)
            if held is None:
                rows.append({"doc_id": doc_id, "end": FIRST, "part": part, "text": text})
            else:
                rows.append(compared(*held, text, own) | {"end": 0})
            held = doc_id, text, own
        yield pa.RecordBatch.from_pylist(rows, form)
    if held is not None:
        yield pa.RecordBatch.from_pylist([{"doc_id": held[0], "end": LAST, "part": part, "text": held[1]}], form)
    release()


def _bridge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ends (doc_id, text, other) compared."""
    for batch in batches:
        rows = zip(batch.column(0).to_pylist(), texts(batch, "text"), texts(batch, "other"), strict=True)
        yield pa.RecordBatch.from_pylist([compared(i, a, fingerprint(a), b, fingerprint(b)) for i, a, b in rows], _FORM)


def compare_neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """Per row: id, n_chars, edited_sha256, both fingerprints in hexadecimal, near_edited and near_next."""
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumns({"mark": F.xxhash64("text"), "at": F.monotonically_increasing_id()})
    order = [F.col("doc_id").desc_nulls_last(), F.col("mark"), F.col("at")]
    ranged = keyed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("doc_id", "text")
    walked = checkpointed(ranged.mapInArrow(_walk, f"{FOUND}, end int, part int, text string"))
    names = [x.split()[0] for x in FOUND.split(", ")]
    ends = walked.where("end > 0").select("end", "part", "doc_id", "text")
    used = sorted(r.part for r in ends.where(F.col("end") == FIRST).select("part").collect())  # a number for each range
    after = spark.createDataFrame(list(zip(used, used[1:] + used[:1], strict=True)), "part int, following int")
    first = ends.where(F.col("end") == FIRST).select(F.col("part").alias("following"), F.col("text").alias("other"))
    pairs = ends.where(F.col("end") == LAST).join(after, "part").join(first, "following").select("doc_id", "text", "other")
    rows = walked.where("end = 0").select(*names).unionByName(pairs.mapInArrow(_bridge, FOUND))
    return rows.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
