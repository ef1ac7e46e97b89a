"""Packing documents into training sequences by lexical retrieval.

A document is its token ids and the id 0 after them. Whole windows of a document are sequences by themselves; what is left, its tail, is packed with other tails:
a sharded BM25 inverted index over the tails returns unused neighbours for each seed, which greedily fill its window; those that fit go in whole, and
the best of the rest is cut to fill the window exactly, its remainder staying in the index. So all windows are full but the last of a shard, which is
cut into sequences of powers of two and needs no padding either.

The terms are token ids: the vocabulary bounds the table of document frequencies, which is computed over all tails and then broadcast (8 bytes an id). Shards are ranges of (least hash of a tail's tokens, its two least
hashes weighted by idf, id): the first brings languages together, the others tails that share a rare word, and a key with many rows is cut by the id. A shard of about SHARD tails is
indexed whole; only one of more than BLOCK tails is cut, and an open window goes on into the next block. A worker's memory is one block's postings, whatever the data.
Neighbours in other shards are not found.
QUERY_TERMS best terms of a seed make its query, and TOP candidates are tried whole before one is cut: neither drops a document.

Defined results: null and empty texts are the single id 0. Every id lies in exactly one piece; rows are documents, so repeated rows are packed repeatedly. A null id stays null.
Very long texts are encoded whole and give many windows. Columns but the id and the text are left out, so their names don't matter. An empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codeloom.llm._common import checkpointed, parts, release, texts
from codeloom.llm.bpe import byte_symbols

WINDOW, BLOCK, SHARD, QUERY_TERMS, TOP, K1, B = 1024, 32_768, 16_384, 32, 32, 1.2, 0.75
_GPT_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteBpe:
    """The ids of the tokenizers library, made by tiktoken from the same file where that is faster and certain to agree."""

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        code = {c: b for b, c in enumerate(byte_symbols())}
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocabulary = spec["model"]["vocab"]
        self.size = max([*vocabulary.values(), *special.values()]) + 1
        merges = ["".join(x if isinstance(x, list) else x.split(" ")) for x in spec["model"]["merges"]]
        in_order = all(vocabulary.get(m) == k + 256 for k, m in enumerate(merges)) and len(vocabulary) - len(special.keys() & vocabulary.keys()) == len(merges) + 256
        plain = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.fast = None
        if in_order and plain and not any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"]):
            ranks = {bytes(code[c] for c in t): i for t, i in vocabulary.items() if t not in special}
            self.fast = tiktoken.Encoding("file", pat_str=_GPT_SPLIT, mergeable_ranks=ranks, special_tokens=special)

    @cached_property
    def slow(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None and len(text) < 1 << 20:
            try:
                return np.asarray(self.fast.encode_to_numpy(text, allowed_special="all"), np.uint32)
            except ValueError:  # its regular expression ran out of steps
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_NAMES = [x.split()[0] for x in _PIECES.split(", ")]


def tokenized(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """A row for each whole window (ids null) and each tail (sequence_id null), with its ids and sort key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        kind = "<u2" if bpe.size <= 1 << 16 else "<u4"
        order = np.random.default_rng(0).permutation(bpe.size)
        serial = TaskContext.get().partitionId() << 33
        for batch in parts(batches):
            rows = []
            for name, body in zip(batch.column(0).to_pylist(), texts(batch, text), strict=True):
                ids = np.append(bpe.encode(body), np.uint32(0))
                last = len(ids) // window * window
                for start in range(0, last, window):
                    rows.append((name, start, window, _crc(ids[start : start + window]), len(ids), serial, 0, None, None))
                    serial += 2
                if last < len(ids):
                    tail = ids[last:]
                    rows.append((name, last, len(tail), None, len(ids), None, None, tail.astype(kind).tobytes(), int(order[tail].min())))
            kinds = [pa.int64()] * 7 + [pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [*_NAMES, "ids", "place"])

    return docs.select(doc_id, text).mapInArrow(run, f"{_PIECES}, ids binary, place bigint")


def document_frequencies(tails: DataFrame, kind: str, size: int) -> np.ndarray:
    """Tails that hold each id, over all tails; a row for each id and task is summed, so as many rows as ids reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column(0).to_pylist():
                count[np.unique(np.frombuffer(ids, kind))] += 1
        some = np.nonzero(count)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(count[some], pa.int64())], ["term", "n"])

    out = np.zeros(size, np.int64)
    for row in tails.select("ids").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[row.term] = row.n
    return out


def rare_first(df: np.ndarray, idf: np.ndarray, power: float = 3.0) -> np.ndarray:
    """The place of each id in an order in which of several ids the rarer tends to come first; ids of a single tail come last, as they bring nobody together."""
    hashed = np.random.default_rng(0).exponential(size=len(idf)) / np.where(df > 1, idf, 1e-9) ** power
    return np.argsort(np.argsort(hashed, kind="stable"), kind="stable")


def two_least(ids: np.ndarray, order: np.ndarray) -> tuple[int, int]:
    """The two least places of the ids; equal if there is only one id."""
    places = order[ids]
    first = places.min()
    more = places[places > first]
    return int(first), int(more.min() if len(more) else first)


class Index:
    """A BM25 inverted index over one block of token arrays."""

    def __init__(self, units: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        self.n, size = len(units), len(idf)
        length = np.array([len(u) for u in units])
        pairs, times = np.unique(np.repeat(np.arange(self.n), length) * size + np.concatenate(units), return_counts=True)
        owner, term = pairs // size, pairs % size
        weight = idf[term] * times * (K1 + 1) / (times + K1 * (1 - B + B * length[owner] / mean))
        self.term, self.weight, self.first = term, weight, np.searchsorted(owner, np.arange(self.n + 1))
        by_term = np.argsort(term, kind="stable")
        self.owner, self.posted = owner[by_term], weight[by_term]
        self.lists = np.searchsorted(term[by_term], np.arange(size + 1))

    def drop(self, free: np.ndarray) -> None:
        """Leave out the units that aren't free; the others keep their order and get its numbers."""
        own, posted = np.repeat(free, np.diff(self.first)), free[self.owner]
        self.term, self.weight = self.term[own], self.weight[own]
        self.first = np.concatenate([[0], np.cumsum(np.diff(self.first)[free])])
        self.lists = np.concatenate([[0], np.cumsum(posted)])[self.lists]
        self.owner, self.posted = (np.cumsum(free) - 1)[self.owner[posted]], self.posted[posted]
        self.n = len(self.first) - 1

    def query(self, unit: int) -> np.ndarray:
        """The best terms of a unit."""
        own = slice(self.first[unit], self.first[unit + 1])
        terms, weight = self.term[own], self.weight[own]
        return terms if len(terms) <= QUERY_TERMS else terms[np.argpartition(weight, -QUERY_TERMS)[-QUERY_TERMS:]]

    def scores(self, terms: np.ndarray) -> np.ndarray:
        spans = [slice(self.lists[t], self.lists[t + 1]) for t in np.sort(terms)]
        return np.bincount(np.concatenate([self.owner[s] for s in spans]), np.concatenate([self.posted[s] for s in spans]), self.n) if spans else np.zeros(self.n)


class Packer:
    """Fills windows with the tails of one shard, block by block."""

    def __init__(self, window: int, idf: np.ndarray, mean: float, serial: int) -> None:
        self.window, self.idf, self.mean, self.serial = window, idf, mean, serial
        self.open: list[tuple] = []  # doc_id, start, doc_tokens, ids
        self.room, self.terms = window, np.zeros(0, np.int64)
        self.out: list[tuple] = []

    def _put(self, unit: list, most: int) -> None:
        name, start, total, ids = unit
        self.open.append((name, start, total, ids[:most]))
        unit[1], unit[3] = start + most, ids[most:]
        self.room -= most
        if not self.room:
            self._close(self.open)
            self.open, self.room = [], self.window

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for name, start, total, ids in pieces:
            self.out.append((name, start, len(ids), _crc(ids), total, self.serial, offset))
            offset += len(ids)
        self.serial += 2

    def block(self, units: list[list]) -> None:
        """Place every token of the units (lists of doc_id, start, doc_tokens, ids)."""
        index = Index([u[3] for u in units], self.idf, self.mean)
        free, next_free = np.ones(len(units), bool), 0
        while True:
            if 2 * np.count_nonzero(free) < len(units):  # scores are made for what is still there
                index.drop(free)
                units = [u for u, own in zip(units, free.tolist(), strict=True) if own]
                free, next_free = np.ones(len(units), bool), 0
            while next_free < len(units) and not free[next_free]:
                next_free += 1
            if next_free == len(units):
                return
            if not self.open:
                self.terms = index.query(next_free)
                seed = units[next_free]
                self._put(seed, min(len(seed[3]), self.room))
                free[next_free] = len(seed[3]) > 0
                if not self.open:
                    continue
            score = np.where(free, index.scores(self.terms), -1.0)
            best = np.argpartition(score, -TOP)[-TOP:] if len(score) > TOP else np.arange(len(score))
            best = best[np.lexsort((best, -score[best]))]
            best = best[score[best] >= 0]
            for k in best:
                if len(units[k][3]) <= self.room:
                    free[k] = False
                    self._put(units[k], len(units[k][3]))
                    if not self.open:
                        break
            left = best[free[best]]
            if self.open and len(left):
                self._put(units[left[0]], self.room)

    def finish(self) -> None:
        """Cut the open window into sequences of powers of two."""
        pieces, size = self.open, 1 << self.window.bit_length()
        self.open = []
        left = self.window - self.room
        while left:
            while size > left:
                size >>= 1
            room, taken = size, []
            while room:
                name, start, total, ids = pieces.pop(0)
                taken.append((name, start, total, ids[:room]))
                if len(ids) > room:
                    pieces.insert(0, (name, start + room, total, ids[room:]))
                room -= len(taken[-1][3])
            self._close(taken)
            left -= size
        self.room = self.window


def pack(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Token arrays of the tails (2 bytes a token) are checkpointed, so that texts are read and encoded once.
    """
    bpe = load(vocabulary)
    kind = "<u2" if bpe.size <= 1 << 16 else "<u4"
    rows = checkpointed(tokenized(docs, vocabulary, doc_id, text, window))
    tails = rows.where(F.col("ids").isNotNull())
    n, tokens = tails.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    df = document_frequencies(tails, kind, bpe.size) if n else np.zeros(bpe.size)
    idf = docs.sparkSession.sparkContext.broadcast(np.log1p((n - df + 0.5) / (df + 0.5)))
    order = docs.sparkSession.sparkContext.broadcast(rare_first(df, idf.value))
    mean = max(1.0, tokens / max(n, 1))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = [two_least(np.frombuffer(x, kind), order.value) for x in batch.column("ids").to_pylist()]
            columns = [pa.array([x[k] for x in least], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "near", "next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, idf.value, mean, (TaskContext.get().partitionId() << 33) + 1)
        units: list[list] = []

        def given() -> pa.RecordBatch:
            columns = [pa.array(list(c), pa.int64()) for c in zip(*packer.out, strict=True)] or [pa.array([], pa.int64())] * len(_NAMES)
            packer.out = []
            return pa.RecordBatch.from_arrays(columns, _NAMES)

        for batch in batches:
            for name, start, total, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                units.append([name, start, total, np.frombuffer(ids, kind).astype(np.int64)])
                if len(units) == BLOCK:
                    packer.block(units)
                    units = []
                    yield given()
        if units:
            packer.block(units)
        packer.finish()
        yield given()
        release()

    shards = max(1, round(n / SHARD))
    keys = ["place", "near", "next", "doc_id", "start"]
    known = tails.select("doc_id", "start", "doc_tokens", "ids", "place")
    dealt = known.mapInArrow(placed, "doc_id bigint, start bigint, doc_tokens bigint, ids binary, place bigint, near bigint, next bigint").repartitionByRange(shards, *keys).sortWithinPartitions(*keys)
    return rows.where(F.col("ids").isNull()).select(*_NAMES).unionByName(dealt.select("doc_id", "start", "doc_tokens", "ids").mapInArrow(run, _PIECES))
