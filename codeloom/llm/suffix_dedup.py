"""Removal of repeated passages with a multi-document suffix order, built column by column.

Every byte covered by a ``SPAN``-byte string that also starts in a document with a smaller id is removed; strings are judged on the input. The suffix order of a collection is built
as for an extended Burrows-Wheeler transform: in each round one more symbol of every string is inserted, from the ends backwards. A round reads the transform and the common prefixes in sequence, block by block, to find where the
new suffixes go and what they share with their neighbours, and then writes the next generation of transform, common prefixes and start positions in sequence. These tapes lie in external files once they exceed ``MEMORY`` bytes; a worker
holds a block of each, the strings and a few numbers for each string. Suffixes that share ``SPAN`` bytes stand next to each other at the end; the least id of
such a group says where the string starts first.

The files are in the folder that ``spark.checkpoint.dir`` names, which pyarrow opens; they live as long as their task's group, and a task that is made again makes its own. A task whose store pyarrow can't open fails and says so.
Tapes of lost tasks are dropped by a later call, when they are a day old.

Distribution. A document that repeats the whole text of an earlier one is removed whole and takes no further part. A window of SPAN bytes is dealt by the least hash of its 20-byte grams, so
equal windows meet, and neighbouring windows with the same least hash travel as one string of 81 bytes at most, which bounds the rounds. Documents are dealt into blocks by a hash of id and text; all that
concerns a block travels packed, in few rows.
 1. Each task sends every distinct hash once, with its text if that is the only one; hashes of one text only need no suffix order and go no further.
 2. Blocks of documents meet the shared hashes of their documents and send the strings of those alone, equal strings of a block once, with the block's least id; all
    other occurrences in the block are repeats already and pass as spans.
 3. For each bucket of hashes the suffix order of its distinct strings is built, and spans are returned to the blocks,
    which meet their texts again: these are shuffled once for both meetings.
A hash in more than HOT different surroundings (a very common line between ever new ones; copies of the same surroundings count once for each task) would load one bucket: its windows travel singly, dealt
by a hash of all SPAN bytes. Such hashes are marked in a bitmap of CROWD_BITS bits (8 MB), which is broadcast; another hash with the same bit travels singly as well, everywhere, which changes no result.

Defined results: null text is empty; texts shorter than SPAN bytes lose nothing; a null id is never compared, its text stays whole; rows with one id are one document for the comparison,
each text of it is cleaned by itself, rows that repeat it once for all; very long texts count whole; an empty table gives no rows. In cleaned texts, characters that a cut splits are dropped.
"""

from __future__ import annotations

import hashlib
import re
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codeloom.checkpoints import folder
from codeloom.llm._common import checkpointed, named_by, release, slices, total_bytes, utf8_column, with_fields

SPAN, GRAM, RUN, HOT, CROWD_BITS = 50, 20, 32, 100_000, 1 << 26
SLICE, BATCH, MEMORY, HASH_BUCKET, STRING_BUCKET, BLOCK, PART, STEP = 1 << 20, 12 << 20, 4 << 20, 24 << 20, 6 << 20, 8 << 20, 256 << 20, 1 << 16
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


def _power(exponent: int) -> np.uint64:
    return np.uint64(pow(_BASE, exponent, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` bytes from each position, by doubling."""
    power, out, done = _BYTES[data], None, 0
    size = 1
    while size <= length:
        if length & size:
            out = power if out is None else out[: len(power) - done] * _power(size) + power[done:]
            done += size
        power = power[: max(len(power) - size, 0)] * _power(size) + power[size:] if size * 2 <= length else power
        size *= 2
    return _mix(out[: max(len(data) - length + 1, 0)])


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` neighbours from each position."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: -(width - size)], x[width - size :]) if width > size else x


class Runs:
    """Runs of neighbouring windows with one least hash, in the rows of a batch: row, first byte in the row, windows, key, and a hash of both ends of the run's string."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        found = [self._of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], a) for a, b in slices(offsets, SLICE)]
        self.row, self.start, self.windows, self.key, self.ends = (np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found, strict=True) if found else [()] * 5))

    @staticmethod
    def _of(data: np.ndarray, offsets: np.ndarray, first_row: int) -> tuple[np.ndarray, ...]:
        n = len(data) - SPAN + 1
        if n < 1:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
        grams = gram_hashes(data, GRAM)
        key = _least(grams, SPAN - GRAM + 1) & np.uint64(_ALL - 1)
        ends = offsets[1:]
        edge = np.zeros(len(data) + 1, np.int32)
        np.add.at(edge, np.maximum(ends - SPAN + 1, offsets[:-1]), 1)
        np.add.at(edge, ends, -1)
        valid = np.cumsum(edge[:n]) == 0
        change = np.ones(n, bool)
        change[1:] = (key[1:] != key[:-1]) | (valid[1:] != valid[:-1])
        start = np.flatnonzero(change)
        length = np.diff(np.append(start, n))
        own = valid[start]
        start, length = start[own], length[own]
        pieces = -(-length // RUN)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, length = np.repeat(start, pieces) + nth * RUN, np.minimum(np.repeat(length, pieces) - nth * RUN, RUN)
        row = np.searchsorted(offsets, start, "right") - 1
        return row + first_row, start - offsets[row], length, key[start], grams[start] * np.uint64(_BASE) + grams[start + length - 1 + SPAN - GRAM]


def packed(*arrays: np.ndarray) -> bytes:
    head = np.array([a.nbytes for a in arrays], "<i8").tobytes()
    return zstandard.compress(head + b"".join(a.tobytes() for a in arrays), 1)


def unpacked(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    sizes, at, out = np.frombuffer(raw, "<i8", len(kinds)), 8 * len(kinds), []
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def id_hash(ids: np.ndarray, seed: int | np.ndarray = 42) -> np.ndarray:
    """Spark's xxhash64 of a bigint column, as unsigned numbers."""
    with np.errstate(over="ignore"):
        p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # fixed values of the XXH64 format
        turn = lambda x, n: x << np.uint64(n) | x >> np.uint64(64 - n)
        x = (np.uint64(seed) + p5 + np.uint64(8)) ^ turn(ids.astype(np.int64).view(np.uint64) * p2, 31) * p1
        x = turn(x, 27) * p1 + p4
        x = (x ^ x >> np.uint64(33)) * p2
        x = (x ^ x >> np.uint64(29)) * p3
        return x ^ x >> np.uint64(32)


def _block(ids: np.ndarray, texts: np.ndarray, blocks: int) -> np.ndarray:
    """The block of each document, as ``pmod(xxhash64(id, hash of the text), blocks)`` has it: rows that share an id are spread by their texts."""
    return (id_hash(texts, id_hash(ids)).view(np.int64) % np.int64(blocks)).astype(np.int32)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    differs = np.zeros(len(columns[0]), bool)
    differs[0] = True
    for c in columns:
        differs[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(differs)


def tidy(work: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """``work`` on one group, after which its memory goes back to the system."""

    def run(group: pa.Table, *more: pa.Table) -> pa.Table:
        out = work(group, *more)
        release()
        return out

    return run if work.__code__.co_argcount > 1 else lambda group: run(group)


def _copies(docs: DataFrame) -> DataFrame:
    """block, doc_id and text hash of the documents that repeat the whole text of one with a smaller id, checkpointed. No text is shuffled: two hashes stand for it."""
    marks = docs.select("block", "doc_id", "hash", F.xxhash64(F.lit("again"), "text").alias("check"))
    classes = checkpointed(marks.groupBy("hash", "check").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("hash", "check", "least"))
    return checkpointed(marks.join(classes, ["hash", "check"]).where("doc_id > least").select("block", "doc_id", "hash"))


def _packed_by(where: np.ndarray, *columns: np.ndarray) -> tuple[list[int], list[bytes]]:
    """The places that occur in ``where``, which is sorted, and the packed columns of each; a column of int64 is packed as differences."""
    cut = np.append(_starts(where), len(where))
    of = lambda c: np.diff(c, prepend=0) if c.dtype == np.int64 else c
    return where[cut[:-1]].tolist(), [packed(*[of(c[a:b]) for c in columns]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _hits(h: np.ndarray, d: np.ndarray, t: np.ndarray, blocks: int) -> tuple[list[int], list[bytes]]:
    """Hashes and the documents they concern, once, packed by block; half a hash is enough within a document."""
    where = _block(d, t, blocks)
    order = np.lexsort((h, d, where))
    h, d, where = h[order], d[order], where[order]
    once = _starts(where, d, h)
    return _packed_by(where[once], d[once], h[once].astype("<u4"))


def _rows(names: list[str], *columns: list) -> pa.RecordBatch:
    kinds = {"bucket": pa.int32(), "block": pa.int32(), "blob": pa.binary(), "kind": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for n, c in zip(names, columns, strict=True)], names)


HITS, HASHES, CROWD = 0, 1, 2


def _dealt(rows: DataFrame, key: str, size: int) -> DataFrame:
    """``rows`` dealt by a key into parts of PART bytes of the input at most, where the session has fewer partitions than that."""
    parts = -(-size // PART)
    return rows.repartition(parts, key) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def _shared_hashes(docs: DataFrame, size: int, blocks: int) -> DataFrame:
    """Rows (block, kind, blob): HITS, the hashes of a block's documents that other texts have, too; CROWD, hashes in more than HOT surroundings."""
    buckets = max(1, -(-size // HASH_BUCKET))
    hot = HOT
    names, layout = ["bucket", "block", "kind", "blob"], "bucket int, block int, kind int, blob binary"

    def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in slices(utf8_column(batch, "text")[1], BATCH):
                yield batch.slice(first, last - first)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            ids, texts = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "hash"))
            runs = Runs(*utf8_column(batch, "text"))
            h = short(runs.key)
            order = np.lexsort((runs.ends, h))
            h, ends, doc, text = h[order], runs.ends[order], ids[runs.row[order]], texts[runs.row[order]]
            group = _starts(h)
            if not len(group):
                continue
            several = np.minimum.reduceat(text, group) < np.maximum.reduceat(text, group)
            many = np.repeat(several, np.diff(np.append(group, len(h))))
            places, blobs = _hits(h[many], doc[many], text[many], blocks)  # shared within this batch: known without asking
            yield _rows(names, [p % buckets for p in places], places, [HITS] * len(places), blobs)
            # one message for each hash: its different surroundings, counted below zero where texts differ, the text and the least id that has it
            new = np.zeros(len(h), np.int64)
            new[_starts(h, ends)] = 1
            c = np.add.reduceat(new, group)
            h, d, t, c = h[group], np.minimum.reduceat(doc, group), text[group], np.where(several, -c, c).astype("<i4")
            where = (h % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((h, d, where))
            h, d, t, c = h[order], d[order], t[order], c[order]
            places, blobs = _packed_by(where[order], h.astype("<u4"), (h >> np.uint64(32)).astype("<u2"), d, t, c)
            yield _rows(names, places, [0] * len(places), [HASHES] * len(places), blobs)

    def meet(table: pa.Table) -> pa.Table:
        out = [table.filter(pc.equal(table["kind"], HITS)).select(names[1:])]
        parts = [unpacked(b, "<u4", "<u2", "<i8", "<i8", "<i4") for b in table.filter(pc.equal(table["kind"], HASHES))["blob"].to_pylist()]
        if parts:
            h = np.concatenate([p[0] for p in parts]).astype(np.uint64) | np.concatenate([p[1] for p in parts]).astype(np.uint64) << np.uint64(32)
            d, t = (np.concatenate([np.cumsum(p[k]) for p in parts]) for k in (2, 3))
            c = np.concatenate([p[4] for p in parts])
            order = np.argsort(h, kind="stable")
            h, d, t, c = h[order], d[order], t[order], c[order]
            group = _starts(h)
            shared = (np.minimum.reduceat(t, group) < np.maximum.reduceat(t, group)) | (np.minimum.reduceat(c, group) < 0)
            crowded = h[group[np.add.reduceat(np.abs(c), group, dtype=np.int64) > hot]]
            known = np.repeat(shared, np.diff(np.append(group, len(h)))) & (c > 0)
            places, blobs = _hits(h[known], d[known], t[known], blocks)
            out += [pa.Table.from_batches([_rows(names[1:], places, [HITS] * len(places), blobs)]), pa.Table.from_batches([_rows(names[1:], *([x] * (len(crowded) > 0) for x in (0, CROWD, crowded.tobytes())))])]
        return pa.concat_tables(out)

    return _dealt(docs.select("doc_id", "hash", "text").mapInArrow(send, layout), "bucket", size).groupBy("bucket").applyInArrow(tidy(meet), "block int, kind int, blob binary")


def short(key: np.ndarray) -> np.ndarray:
    """48 well mixed bits of a hash: two that agree by chance only cost a needless comparison."""
    return _mix(key) >> np.uint64(16)


class Tape:
    """Numbers that are written in sequence, block by block, and read again so: in memory or, beyond the store's bound, in an external file."""

    def __init__(self, store: Store) -> None:
        self.store, self.blocks, self.sizes, self.out, self.path = store, [], [], None, ""

    def write(self, block: np.ndarray) -> None:
        self.sizes.append(len(block))
        if self.out is None and self.store.held + block.nbytes > self.store.memory and (opened := self.store.create()):
            self.path, self.out = opened
            for earlier in self.blocks:
                self._put(earlier)
                self.store.held -= earlier.nbytes
            self.blocks, self.kind = [], block.dtype
        if self.out is None:
            self.blocks.append(block)
            self.store.held += block.nbytes
        else:
            self._put(block)

    def _put(self, block: np.ndarray) -> None:
        self.out.write(pa.py_buffer(np.ascontiguousarray(block)))
        self.store.written += block.nbytes

    def read(self) -> Iterator[np.ndarray]:
        """All blocks in order; the tape is closed for writing."""
        if self.out is None:
            yield from self.blocks
            return
        self.out.close()
        with self.store.open(self.path) as file:
            for n in self.sizes:
                yield np.frombuffer(file.read(n * self.kind.itemsize), self.kind)

    def drop(self) -> None:
        if self.out is None:
            self.store.held -= sum(x.nbytes for x in self.blocks)
        else:
            self.out.close()
            self.store.remove(self.path)
        self.blocks = []


class Store:
    """What the tapes of one order may hold in memory, and where their files are."""

    def __init__(self, folder: str | None = None, memory: int = MEMORY) -> None:
        self.memory, self.held, self.written, self.files, self.open_files = memory, 0, 0, None, set()
        if folder:  # where pyarrow can't open it, this raises
            self.files, self.root = fs.FileSystem.from_uri(re.sub("^file:/+", "/", folder.replace("s3a://", "s3://")))

    def create(self) -> tuple[str, pa.NativeFile] | None:
        if self.files is None:
            return None
        path = f"{self.root}/suffix-order-{uuid.uuid4().hex}"
        self.open_files.add(path)
        return path, self.files.open_output_stream(path, buffer_size=0)

    def open(self, path: str) -> pa.NativeFile:
        return self.files.open_input_stream(path)

    def remove(self, path: str) -> None:
        self.open_files.discard(path)
        self.files.delete_file(path)

    def close(self) -> None:
        for path in list(self.open_files):
            with suppress(OSError):
                self.remove(path)


END = 255  # no byte of UTF-8: stands in the transform where a string begins
_MOST = 254  # common prefixes are counted so far
_SHIFT, _POSITION = np.uint32(17), np.uint32((1 << 17) - 1)  # a block has less than two STEPs
_EDGES = np.arange(257, dtype=np.uint32) << _SHIFT


class Gap:
    """What one pass over transform and common prefixes knows of each symbol: how often it has come, and the least common prefix since it came last."""

    def __init__(self, counts: np.ndarray) -> None:
        self.lower = np.cumsum(counts) - counts  # suffixes that begin with a lower symbol, ends not counted
        self.seen = np.zeros(256, np.int64)
        self.since = np.full(256, _MOST, np.uint8)
        self.waiting = np.full(256, -1)  # the rank behind a new suffix whose next equal symbol hasn't come yet
        self.least = np.full(256, _MOST, np.uint8)
        self.below: list[tuple[np.ndarray, np.ndarray]] = []

    def step(self, b: np.ndarray, shared: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the symbols at positions ``q`` of a block among all equal and lower ones, and the common prefixes of the suffixes that they begin with those before."""
        symbol, n = b.astype(np.uint32) << _SHIFT, len(b)
        keys = np.sort(symbol | np.arange(n, dtype=np.uint32))  # by symbol, then position
        first = np.searchsorted(keys, _EDGES)
        first, count = first[:-1], np.diff(first)
        place = lambda k: (keys[k] & _POSITION).astype(np.int64)
        own, mine = b[q], np.searchsorted(keys, symbol[q] | q.astype(np.uint32))
        head = np.minimum.accumulate(shared)
        nth = mine - first[own]
        rank = self.lower[own] + self.seen[own] + nth
        common = np.zeros(len(q), np.uint8)
        near = nth > 0
        common[near] = np.minimum(_least_between(shared, place(mine[near] - 1) + 1, q[near] + 1), _MOST) + 1
        far = ~near & (self.seen[own] > 0)
        common[far] = np.minimum(self.since[own[far]], head[q[far]]) + 1
        new = np.zeros(n, bool)
        new[q] = True
        # the old suffix behind a new one shares with it what lies between them; a new suffix behind has looked up by itself
        here = np.flatnonzero((self.waiting >= 0) & (count > 0))
        at = place(first[here])
        old = ~new[at]
        self.below.append((self.waiting[here][old], np.minimum(self.least[here], head[at])[old] + 1))
        self.waiting[here] = -1
        self.least[self.waiting >= 0] = np.minimum(self.least[self.waiting >= 0], head[-1])
        last = nth + 1 == count[own]
        behind = place(np.minimum(mine + 1, n - 1))
        near = ~last & ~new[behind]
        self.below.append((rank[near] + 1, np.minimum(_least_between(shared, q[near] + 1, behind[near] + 1), _MOST) + 1))
        come = np.flatnonzero(count)
        ends = place((first + count)[come] - 1)
        tail = _least_from(shared, ends + 1)
        self.since = np.minimum(self.since, head[-1])
        self.since[come] = tail
        self.seen += count
        slot = np.searchsorted(come, own[last])
        self.waiting[own[last]] = rank[last] + 1
        self.least[own[last]] = tail[slot]
        return rank, common


def _least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least value in each range."""
    if not len(low):
        return np.zeros(0, values.dtype)
    return np.minimum.reduceat(np.append(values, np.uint8(_MOST)), np.stack([low, high], 1).ravel())[::2]


def _least_from(values: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The least value from each of the positions on."""
    order = np.argsort(low)
    parts = np.minimum.reduceat(np.append(values, np.uint8(_MOST)), low[order])
    out = np.empty(len(low), np.uint8)
    out[order] = np.minimum(np.minimum.accumulate(parts[::-1])[::-1], _MOST)
    return out


def _merged(tapes: list[Tape], at: np.ndarray, columns: list[np.ndarray], below_at: np.ndarray, below: np.ndarray, store: Store) -> list[Tape]:
    """The next generation of transform, common prefixes and, once there are any, starts: ``columns`` put in at the sorted positions ``at``, and the common prefixes at ``below_at`` corrected."""
    out = [Tape(store) for _ in tapes]
    before = at - np.arange(len(at))  # as many old entries stand before each
    done = low = 0
    sizes = tapes[0].sizes
    for k, blocks in enumerate(zip(*[t.read() for t in tapes], strict=True)):
        last = len(before) if k == len(sizes) - 1 else int(np.searchsorted(before, low + sizes[k]))
        base = low + done
        kept, put = np.ones(sizes[k] + last - done, bool), at[done:last] - base
        kept[put] = False
        made = []
        for block, column in zip(blocks, columns, strict=False):
            both = np.empty(len(kept), block.dtype)
            both[kept], both[put] = block, column[done:last]
            made.append(both)
        a, b = np.searchsorted(below_at, [base, base + len(kept)])
        made[1][below_at[a:b] - base] = below[a:b]
        for first in range(0, len(kept), STEP) if len(kept) >= 2 * STEP else [0]:
            end = first + STEP if len(kept) >= 2 * STEP else len(kept)
            for tape, both in zip(out, made, strict=True):
                tape.write(both[first:end])
        low, done = low + sizes[k], last
    for tape in tapes:
        tape.drop()
    return out


def suffix_order(data: np.ndarray, offsets: np.ndarray, store: Store, least: int = 1) -> list[Tape]:
    """Tapes of the transform, of the symbols each suffix of the UTF-8 strings in ``data`` shares with the one before (255 at most), and of the start positions, in order. The first entries are the strings' ends, one for each.

    Ends sort before symbols, and ends of different strings share nothing. Round j inserts the suffixes of length j. With c the symbol before a suffix of length j - 1, the
    new suffix stands behind all suffixes that begin with lower symbols and behind those that begin with c and whose rest stands before: its rank among equal symbols of the
    transform. It shares one symbol more than its rest does with that of its neighbour: the least common prefix between them.
    Starts are those of suffixes of ``least`` symbols or more; of others, the tape has the length of the data. It is begun in round ``least`` only.
    """
    count, ends = len(offsets) - 1, offsets[1:].astype(np.int64)
    length = np.diff(offsets)
    symbols = np.append(data, np.uint8(END))
    kind = np.int32 if len(data) < 1 << 31 else np.int64
    tapes = [Tape(store), Tape(store)]
    given = [np.where(length > 0, symbols[ends - 1], np.uint8(END)), np.zeros(count, np.uint8)]
    counts = np.bincount(given[0], minlength=256)
    for first in range(0, count, STEP):
        for tape, values in zip(tapes, given, strict=True):
            tape.write(values[first : first + STEP])
    at = strings = np.arange(count)
    for j in range(1, max(int(length.max(initial=0)), least) + 1):
        if j == least:
            tapes.append(Tape(store))
            for n in tapes[0].sizes:
                tapes[2].write(np.full(n, len(data), kind))
        longer = length[strings] >= j
        at, strings = at[longer], strings[longer]
        if not len(at):
            continue
        gap, ranks, commons, done, low = Gap(counts), [], [], 0, 0
        for b, shared in zip(tapes[0].read(), tapes[1].read(), strict=True):
            last = int(np.searchsorted(at, low + len(b)))
            rank, common = gap.step(b, shared, at[done:last] - low)
            ranks.append(rank)
            commons.append(common)
            low, done = low + len(b), last
        rank, common = np.concatenate(ranks), np.concatenate(commons)
        by = np.argsort(rank)
        at, strings = rank[by] + count, strings[by]
        place = ends[strings] - j
        preceding = np.where(length[strings] > j, symbols[place - 1], np.uint8(END))
        below_at, below = (np.concatenate(c) for c in zip(*gap.below, strict=True))
        order = np.argsort(below_at)
        tapes = _merged(tapes, at, [preceding, common[by], place], below_at[order] + count, below[order], store)
        counts += np.bincount(preceding, minlength=256)
    return tapes


def earlier_windows(data: np.ndarray, offsets: np.ndarray, least_id: np.ndarray, folder: str | None = None, memory: int = MEMORY) -> tuple[np.ndarray, int]:
    """For each string the windows of SPAN bytes, as bits, that a string with a smaller id holds as well; and how many bytes went through external files.

    A string has RUN windows at most. The order is read in sequence: what is held are a block and the group that it ends with.
    """
    store, out = Store(folder, memory), np.zeros(len(offsets) - 1, np.uint32)
    try:
        tapes = suffix_order(data, offsets, store, SPAN)
        held, shares = np.zeros(0, np.int64), np.zeros(0, np.uint8)
        blocks = zip(tapes[1].read(), tapes[2].read(), strict=True)
        for k in range(len(tapes[1].sizes)):
            shared, start = next(blocks)
            held, shares = np.append(held, start.astype(np.int64)), np.append(shares, shared)
            group = np.flatnonzero(np.append(True, shares[1:] < SPAN))
            end = len(held) if k == len(tapes[1].sizes) - 1 else int(group[-1])
            group = group[group < end]
            if end:
                owner = np.minimum(np.searchsorted(offsets, held[:end], "right"), len(offsets) - 1) - 1
                full = offsets[owner + 1] - held[:end] >= SPAN
                ids = np.where(full, least_id[owner], np.iinfo(np.int64).max)
                earlier = full & (np.repeat(np.minimum.reduceat(ids, group), np.diff(np.append(group, end))) < ids)
                window = (held[:end] - offsets[owner])[earlier].astype(np.uint32)
                np.bitwise_or.at(out, owner[earlier], np.uint32(1) << window)
            held, shares = held[end:], shares[end:]
        for tape in tapes:
            tape.drop()
        return out, store.written
    finally:
        store.close()


class Block:
    """The documents of one block in a fixed order, by id and text hash: a row's number means the same in both meetings."""

    def __init__(self, docs: pa.Table, copies: pa.Table) -> None:
        keys = [docs[c].to_numpy().astype(np.int64) for c in ("doc_id", "hash")]
        order = np.lexsort((keys[1], keys[0]))
        self.ids, self.hashes = (k[order] for k in keys)
        self.table = docs.take(pa.array(order)).combine_chunks()
        self.batch = self.table.to_batches()[0] if len(order) else None
        again = set(zip(copies["doc_id"].to_pylist(), copies["hash"].to_pylist(), strict=True))
        self.copy = np.array([x in again for x in zip(self.ids.tolist(), self.hashes.tolist(), strict=True)], bool) if again else np.zeros(len(order), bool)


SPANS, STRINGS = 0, 1


def _spans(docs: DataFrame, copies: DataFrame, shared: DataFrame, size: int) -> DataFrame:
    """Rows (block, blob): row numbers in the block and starts and ends of byte spans to remove."""
    buckets = max(1, -(-size // STRING_BUCKET))
    marks = np.zeros(0, np.uint8)
    for row in shared.where(F.col("kind") == CROWD).select("blob").toLocalIterator():
        marks = marks if len(marks) else np.zeros(CROWD_BITS // 8, np.uint8)
        bit = np.frombuffer(row.blob, "<u8") % np.uint64(CROWD_BITS)
        np.bitwise_or.at(marks, bit >> np.uint64(3), np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8))
    hot = docs.sparkSession.sparkContext.broadcast(marks)
    scratch = folder(docs.sparkSession)
    hits = shared.where(F.col("kind") == HITS).select("block", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("hash"), "blob")
    notes = hits.unionByName(copies.withColumn("blob", F.lit(None).cast("binary")))
    names, layout = ["bucket", "block", "kind", "blob"], "bucket int, block int, kind int, blob binary"
    none = _rows(names, [], [], [], [])
    salt = np.uint64(0xD6E8FEB86659FD93)

    def send(docs: pa.Table, notes: pa.Table) -> pa.Table:
        packs = [unpacked(b, "<i8", "<u4") for b in notes.filter(notes["blob"].is_valid())["blob"].to_pylist()]
        if not packs or not len(docs):
            return pa.Table.from_batches([none])
        number = docs["block"][0].as_py()
        block = Block(docs, notes.filter(notes["blob"].is_null()))
        data, offsets = utf8_column(block.batch, "text")
        runs = Runs(data, offsets)
        wanted = np.concatenate([np.cumsum(d).astype(np.uint64) * salt ^ h.astype(np.uint64) for d, h in packs])
        code = short(runs.key)
        asked = np.isin(block.ids[runs.row].astype(np.uint64) * salt ^ code & np.uint64(0xFFFFFFFF), wanted) & ~block.copy[runs.row]
        row, start, windows, key, code = (x[asked] for x in (runs.row, runs.start, runs.windows, runs.key, code))
        if len(hot.value):
            bit = code % np.uint64(CROWD_BITS)
            single = (hot.value[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            each = np.where(single, windows, 1)
            nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            was = np.repeat(single, each)
            row, start, windows, key = np.repeat(row, each), np.repeat(start, each) + nth, np.where(was, 1, np.repeat(windows, each)), np.repeat(key, each)
            at = np.flatnonzero(was)
            for low in range(0, len(at), 1 << 14):
                some = at[low : low + (1 << 14)]
                key[some] = gram_hashes_at(data, offsets[row[some]] + start[some])
        raw, low = memoryview(data), offsets[row] + start
        seen: dict[bytes, int] = {}
        of = np.array([seen.setdefault(bytes(raw[a:b]), len(seen)) for a, b in zip(low.tolist(), (low + windows + SPAN - 1).tolist(), strict=True)], np.int64)
        order = np.lexsort((row, of))  # rows are in order of the id
        row, start, windows, key, of = (x[order] for x in (row, start, windows, key, of))
        doc = block.ids[row]
        cut = _starts(of)
        again = doc > np.repeat(doc[cut], np.diff(np.append(cut, len(of))))
        out = [_rows(names, [number % buckets], [number], [SPANS], [packed_spans(row[again], start[again], (start + windows + SPAN - 1)[again])])]
        row, start, key, of, doc = (x[~again] for x in (row, start, key, of, doc))
        tag, where = (_mix(key) >> np.uint64(32)).astype(np.int64), (_mix(key * np.uint64(_BASE)) % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((of, tag, where))
        row, start, of, doc, where, tag = (x[order] for x in (row, start, of, doc, where, tag))
        cut, strings, blobs = np.append(_starts(where), len(where)), list(seen), []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            change = _starts(of[a:b])
            chosen = [strings[k] for k in of[a:b][change].tolist()]
            times = np.diff(np.append(change, b - a))
            blobs.append(packed(np.frombuffer(b"".join(chosen), np.uint8), np.array([len(x) for x in chosen], "<u1"), np.diff(tag[a:b][change], prepend=0).astype("<u4"), times.astype("<i4"), row[a:b].astype("<i4"), doc[a:b], start[a:b].astype("<i4")))
        out.append(_rows(names, where[cut[:-1]].tolist(), [number] * len(blobs), [STRINGS] * len(blobs), blobs))
        return pa.Table.from_batches(out)

    def meet(table: pa.Table) -> pa.Table:
        passed = table.filter(pc.equal(table["kind"], SPANS)).select(["block", "blob"])
        given = table.filter(pc.equal(table["kind"], STRINGS))
        parts = [unpacked(b, "u1", "<u1", "<u4", "<i4", "<i4", "<i8", "<i4") for b in given["blob"].to_pylist()]
        if not parts:
            return passed
        known: dict[bytes, int] = {}
        number = []
        for text, sizes, *_ in parts:
            raw, ends = memoryview(text), np.cumsum(sizes, dtype=np.int64)
            number.append(np.array([known.setdefault(bytes(raw[a:b]), len(known)) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)], np.int64))
        of = np.concatenate([np.repeat(n, p[3]) for n, p in zip(number, parts, strict=True)])
        block = np.repeat(given["block"].to_numpy(), [len(p[4]) for p in parts])
        row, doc, start = np.concatenate([p[4] for p in parts]), np.concatenate([p[5] for p in parts]), np.concatenate([p[6] for p in parts]).astype(np.int64)
        tag = np.zeros(len(known), np.uint32)
        tag[np.concatenate(number)] = np.concatenate([np.cumsum(p[2], dtype=np.uint32) for p in parts])
        least = np.full(len(known), np.iinfo(np.int64).max)
        np.minimum.at(least, of, doc)
        length = np.array([len(x) for x in known], np.int64)
        _, group, size = np.unique(tag, return_inverse=True, return_counts=True)
        several = np.flatnonzero(size[group] > 1)  # a hash with a single distinct string has nothing to compare
        strings = list(known)
        data = np.frombuffer(b"".join(strings[k] for k in several.tolist()), np.uint8)
        earlier = np.zeros(len(known), np.uint32)
        earlier[several], _ = earlier_windows(data, np.append(0, np.cumsum(length[several])), least[several], scratch, MEMORY)
        whole = doc > least[of]  # another document has the whole string first
        some = np.flatnonzero(~whole & (earlier[of] > 0))
        entry, nth = np.nonzero(earlier[of[some], None] >> np.arange(RUN, dtype=np.uint32) & np.uint32(1))
        entry, first = np.append(np.flatnonzero(whole), some[entry]), np.append(np.zeros(np.count_nonzero(whole), np.int64), nth)
        low = start[entry] + first
        high = np.where(whole[entry], start[entry] + length[of[entry]], low + SPAN)
        order = np.lexsort((low, row[entry], block[entry]))
        where, own, low, high = block[entry][order], row[entry][order], low[order], high[order]
        cut = np.append(_starts(where), len(where))
        blobs = [packed_spans(own[a:b], low[a:b], high[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        return pa.concat_tables([passed, pa.Table.from_batches([_rows(["block", "blob"], where[cut[:-1]].tolist(), blobs)])])

    sent = _dealt(docs, "block", size).groupBy("block").cogroup(_dealt(notes, "block", size).groupBy("block")).applyInArrow(lambda d, n: tidy(send)(d, n), layout)
    return _dealt(sent, "bucket", size).groupBy("bucket").applyInArrow(tidy(meet), "block int, blob binary")


def packed_spans(row: np.ndarray, low: np.ndarray, high: np.ndarray) -> bytes:
    """Spans of rows, those that touch made one."""
    order = np.lexsort((low, row))
    row, low, high = row[order].astype(np.int64), low[order], high[order]
    apart = np.ones(len(row), bool)
    reach = np.maximum.accumulate(high + (row << 40)) if len(row) else high
    apart[1:] = low[1:] + (row[1:] << 40) > reach[:-1]
    first = np.flatnonzero(apart)
    last = np.append(first[1:], len(row))[: len(first)] - 1
    return packed(np.diff(row[first], prepend=0).astype("<i4"), low[first].astype("<i4"), (reach[last] - (row[last] << 40) - low[first]).astype("<i4"))


def gram_hashes_at(data: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """A hash of the SPAN bytes from each of the positions."""
    columns = _BYTES[data[positions[:, None] + np.arange(SPAN)]]
    weights = np.array([pow(_BASE, SPAN - 1 - k, 1 << 64) for k in range(SPAN)], np.uint64)
    return _mix((columns * weights).sum(1, dtype=np.uint64)) & np.uint64(_ALL - 1)


_KEY = ["__sd_id", "__sd_hash", "__sd_check"]


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digests: bool = False, counts: bool = True) -> DataFrame:
    """``docs`` with its text cleaned and, with ``counts``, n_bytes, n_removed and n_spans in place of columns of these names; or with ``digests`` these and kept_sha256 beside doc_id only.

    Rows that repeat both id and text are cleaned once, and the result is joined to each: so no block of documents holds many of them.
    """
    sweep(docs.sparkSession)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keys = [F.col(f"`{doc_id}`").cast("bigint").alias(_KEY[0]), F.xxhash64(body).alias(_KEY[1]), F.xxhash64(F.lit("again"), body).alias(_KEY[2])]
    comparable = F.col(f"`{doc_id}`").isNotNull() & (F.octet_length(body) >= SPAN)
    repeated = checkpointed(docs.where(comparable).select(*keys).groupBy(*_KEY).count().where("count > 1").select(*_KEY))
    if repeated.isEmpty():
        return _remove_repeats(docs, doc_id, text, digests, counts, [])
    own = [F.col(f"`{c}`") for c in docs.columns]
    named = named_by(docs.select(*own, *keys), repeated, _KEY, "__sd_named")
    again = repeated.withColumn("__sd_again", F.lit(True))
    doubtful = named.where("__sd_named").join(again, _KEY, "left")
    many = doubtful.where("__sd_again")
    carried = "struct<id:bigint,hash:bigint,check:bigint>"
    single = named.where("NOT __sd_named").select(*own).unionByName(doubtful.where("__sd_again IS NULL").select(*own)).withColumn("__sd_key", F.lit(None).cast(carried))
    once = many.groupBy(*_KEY).agg(F.first(body).alias("__sd_text"))
    filled = [F.col(_KEY[0]).cast(f.dataType).alias(f.name) if f.name == doc_id else F.col("__sd_text").alias(f.name) if f.name == text else F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields]
    once = once.select(*filled, F.struct(*[F.col(k).alias(n) for k, n in zip(_KEY, ("id", "hash", "check"), strict=True)]).cast(carried).alias("__sd_key"))
    done = checkpointed(_remove_repeats(single.unionByName(once), doc_id, text, digests, counts, ["__sd_key"]))
    names = [c for c in done.columns if c != "__sd_key"]
    kept = [c for c in names if c not in docs.columns or c == text or counts and c in ("n_bytes", "n_removed", "n_spans")]
    found = done.where("__sd_key IS NOT NULL").select(*[F.col(f"__sd_key.{n}").alias(k) for k, n in zip(_KEY, ("id", "hash", "check"), strict=True)], *[F.col(f"`{c}`").alias(f"__sd_{k}") for k, c in enumerate(kept)])
    others = [c for c in names if c not in kept]
    spread = many.select(*_KEY, *[F.col(f"`{c}`") for c in others]).join(found, _KEY)
    spread = spread.select(*[F.col(f"__sd_{kept.index(c)}").alias(c) if c in kept else F.col(f"`{c}`") for c in names])
    return done.where("__sd_key IS NULL").select(*[F.col(f"`{c}`") for c in names]).unionByName(spread)


def sweep(spark: SparkSession, seconds: float = 86_400) -> int:
    """Drop tapes of tasks that were lost, if they are older than that; how many."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder(spark))
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [x.getPath() for x in files.listStatus(at) if x.getPath().getName().startswith("suffix-order-") and x.getModificationTime() < (time.time() - seconds) * 1000] if files.exists(at) else []
    for path in old:
        files.delete(path, False)
    return len(old)


def _remove_repeats(docs: DataFrame, doc_id: str, text: str, digests: bool, counts: bool, carry: list[str]) -> DataFrame:
    """``remove_repeats`` for rows that don't repeat both id and text; ``carry`` names columns that digests have, too."""
    added = ["n_bytes", "n_removed", "n_spans"]
    replaced = added if counts else []
    rest = carry if digests else [c for c in docs.columns if c not in (doc_id, text, *replaced)]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    size = total_bytes(docs, text)
    blocks = max(1, -(-size // BLOCK))
    name = F.col("doc_id") if doc_id == "doc_id" else F.col(f"`{doc_id}`").alias("doc_id")  # an alias that changes nothing would keep Spark from reusing the shuffle of the texts
    place = F.pmod(F.xxhash64(name.cast("bigint"), F.xxhash64(body)), F.lit(blocks).cast("bigint")).cast("int").alias("block")
    columns = ["block", "doc_id", "hash", "text", *(["rest"] if rest else [])]
    rows = docs.select(place, name, F.xxhash64(body).alias("hash"), body.alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest")] if rest else []))
    comparable = F.coalesce(F.col("doc_id").isNotNull() & (F.octet_length("text") >= SPAN), F.lit(False))
    named = rows.where(comparable)
    copies = _copies(named)
    shared = checkpointed(_shared_hashes(named, size, blocks))
    spans = _spans(named, copies, shared, size).select("block", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("hash"), "blob")
    notes = spans.unionByName(copies.withColumn("blob", F.lit(None).cast("binary")))
    fields = with_fields(T.StructType([T.StructField("doc_id", T.LongType()), *([rows.schema["rest"]] if rest else [])]), "n_bytes bigint, n_removed bigint, n_spans bigint, kept string")

    def clean(docs: pa.Table, notes: pa.Table) -> pa.Table:
        if not len(docs):
            return pa.Table.from_batches([], to_arrow_schema(fields))
        block = Block(docs, notes.filter(notes["blob"].is_null()))
        found = [[], [], []]
        for blob in notes.filter(notes["blob"].is_valid())["blob"].to_pylist():
            row, low, length = unpacked(blob, "<i4", "<i4", "<i4")
            for k, x in enumerate((np.cumsum(row, dtype=np.int64), low.astype(np.int64), length.astype(np.int64))):
                found[k].append(x)
        row, low, length = (np.concatenate([np.zeros(0, np.int64), *x]) for x in found)
        return pa.Table.from_batches([cut(block.batch, row, low, length, block.copy)])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = np.zeros(0, np.int64)
        for batch in batches:
            yield cut(batch, nothing, nothing, nothing, np.zeros(batch.num_rows, bool))

    def cut(batch: pa.RecordBatch, row: np.ndarray, low: np.ndarray, length: np.ndarray, copy: np.ndarray) -> pa.RecordBatch:
        get = lambda name: batch.column(batch.schema.get_field_index(name))
        data, offsets = utf8_column(batch, "text")
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        low = np.append(offsets[row] + low, offsets[:-1][copy])
        high = np.append(low[: len(row)] + length, offsets[1:][copy])
        n = len(data) + 1
        gone = np.cumsum(np.bincount(low, minlength=n) - np.bincount(high, minlength=n))[:-1] > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        heads = offsets[:-1][offsets[:-1] < len(data)]
        begins[heads] = gone[heads]
        removed, runs = (np.concatenate([[0], np.cumsum(x)])[offsets] for x in (gone, begins))
        left, ends = data[~gone].tobytes(), (offsets - removed).tolist()
        kept = [left[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        counts = [pa.array(np.diff(x)) for x in (offsets, removed, runs)]
        last = pa.array([hashlib.sha256(k).hexdigest() for k in kept] if digests else [k.decode(errors="ignore") for k in kept], pa.string())
        return pa.RecordBatch.from_arrays([get("doc_id").cast(pa.int64()), *([get("rest")] if rest else []), *counts, last], ["doc_id", *(["rest"] if rest else []), *added, "kept"])

    met = _dealt(named, "block", size).groupBy("block").cogroup(_dealt(notes, "block", size).groupBy("block")).applyInArrow(lambda d, n: tidy(clean)(d, n), fields)
    out = met.unionByName(rows.where(~comparable).mapInArrow(whole, fields))
    if digests:
        return out.select("doc_id", *added, F.col("kept").alias("kept_sha256"), *[F.col("rest").getField(c).alias(c) for c in carry])
    columns = [F.col("doc_id").cast(docs.schema[c].dataType).alias(c) if c == doc_id else F.col("kept").alias(c) if c == text else F.col("rest").getField(c).alias(c) for c in docs.columns if c not in replaced]
    return out.select(*columns, *replaced)
