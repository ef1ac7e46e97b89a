"""Divergence of the sources of each language, by term frequencies counted in mergeable radix tries.

A task counts the terms of its documents in a byte trie for each language, whose leaves have a counter for each source and the number of documents that hold the term. A trie is kept flat, in its pre-order: leaves in order of bytes, each with the length of the path it
shares with the leaf before and the bytes of its own edge. When HELD counters are held, the trie is cut at the bounds of prefix ranges and given out, one compressed row for each range, so memory is bounded and what is shuffled are tries, not terms. The tries of a range meet in one
task, which merges one after the other - memory follows the distinct terms of a range - drops terms of fewer than LEAST documents and gives out the merged trie and the sums of its counters. Bounds of ranges are quantiles of the distinct terms of a sample of documents; they decide what
meets where, and no result.

A second walk over the merged tries in UTF-8 order, with the sums of all groups of the language joined to each trie, streams values: sums of f(p, q) = floor((p - q)^2 / q) for pairs of sources, and the CANDIDATES best terms of each group, of equal ones that which came first. A pair's sum is
split: terms that one source lacks count by their distinct rates, and only terms that both have are paired, PAIRS at a time. Sums of pairs are partial sums; candidates of all tasks are ranked in two steps. All numbers are whole: 64 bits where they hold the product, else Python's.
The number of pairs is the square of a language's sources, by contract; a task holds a language's list of sources.

Defined results: null text, language and source are empty strings; empty texts count as documents of their group. A language without kept terms has pairs of value 0 and no terms. Repeated rows count as often as they stand; ids play no part. Equal values go by the item's bytes.
Very long texts are counted whole, one at a time. An empty table, or a language of one source without kept terms above its own rate, gives no rows. Other columns are left out, so their names don't matter.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm._common import checkpointed, parts, release, total_bytes, utf8_column

LEAST, CANDIDATES, UNIT = 3, 200, 1_000_000_000
HELD, PAIRS, SALTS = 500_000, 1 << 20, 32
#: Bytes of text for each range, the most ranges, and bytes and terms of the sample that their bounds come from.
RANGE, RANGES, SAMPLE, SAMPLED = 4 << 20, 16_384, 16 << 20, 25_000
#: Bytes of terms, with A-Z lower-cased, and blanks for all others: ASCII but letters.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
TRIES = "part int, lang string, sources array<string>, totals array<bigint>, terms bigint, trie binary"
_TRIES = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("sources", pa.list_(pa.string())), ("totals", pa.list_(pa.int64())), ("terms", pa.int64()), ("trie", pa.binary())])


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: runs of letters and of all that isn't ASCII, with A-Z lower-cased."""
    return text.translate(FOLD).split()


class Trie:
    """Leaves in order of bytes: terms, the number of documents of each, and counters (leaf, source, count) in order of leaf and source."""

    def __init__(self, terms: list[bytes], docs: np.ndarray, leaf: np.ndarray, source: np.ndarray, count: np.ndarray) -> None:
        self.terms, self.docs, self.leaf, self.source, self.count = terms, docs, leaf, source, count

    def cut(self, first: int, last: int) -> Trie:
        """The leaves from ``first`` to before ``last``."""
        a, b = np.searchsorted(self.leaf, [first, last])
        return Trie(self.terms[first:last], self.docs[first:last], self.leaf[a:b] - first, self.source[a:b], self.count[a:b])

    def chosen(self, keep: np.ndarray) -> Trie:
        """The leaves for which ``keep`` is true."""
        place, own = np.cumsum(keep) - 1, keep[self.leaf]
        return Trie([t for t, k in zip(self.terms, keep.tolist(), strict=True) if k], self.docs[keep], place[self.leaf[own]], self.source[own], self.count[own])

    def packed(self) -> bytes:
        """Pre-order with shared paths left out, compressed."""
        size = np.fromiter(map(len, self.terms), np.int64, len(self.terms))
        data = np.frombuffer(b"".join(self.terms), np.uint8)
        shared = shared_paths(data, size)
        own = size - shared
        kept = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size) >= np.repeat(shared, size)
        counters = np.bincount(self.leaf, minlength=len(self.terms))
        return zlib.compress(b"".join(map(_array, (shared, own, self.docs, counters, self.source, self.count, data[kept]))), 1)

    @classmethod
    def unpacked(cls, stored: bytes) -> Trie:
        data, at, arrays = zlib.decompress(stored), 0, []
        for _ in range(7):
            kind, n = chr(data[at]), int.from_bytes(data[at + 1 : at + 9], "little")
            arrays.append(np.frombuffer(data, np.dtype(kind), n, at + 9))
            at += 9 + n * np.dtype(kind).itemsize
        shared, own, docs, counters, source, count, edges = arrays
        edges, terms, term, low = edges.tobytes(), [], b"", 0
        for s, n in zip(shared.tolist(), own.tolist(), strict=True):
            term = term[:s] + edges[low : low + n]
            low += n
            terms.append(term)
        return cls(terms, docs.astype(np.int64), np.repeat(np.arange(len(terms)), counters), source.astype(np.int64), count.astype(np.int64))


def _array(values: np.ndarray) -> bytes:
    """Whole numbers in the least width that holds them, with their kind and number before."""
    kind = next(k for k in "BHIQ" if values.max(initial=0) <= np.iinfo(k).max)
    return kind.encode() + len(values).to_bytes(8, "little") + values.astype(kind).tobytes()


def shared_paths(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many bytes each of some sorted terms, which stand one after the other in ``data``, has in common with the one before."""
    shared = np.zeros(len(size), np.int64)
    start = np.cumsum(size) - size
    left, most, depth = np.arange(1, len(size)), np.minimum(size[1:], size[:-1]), 0
    while len(left):
        left = left[most[left - 1] > depth]
        left = left[data[start[left] + depth] == data[start[left - 1] + depth]]
        depth += 1
        shared[left] = depth
    return shared


class Counts:
    """Counters of some documents of one language."""

    def __init__(self) -> None:
        self.docs: Counter = Counter()
        self.by_source: dict[str, Counter] = defaultdict(Counter)

    def add(self, source: str, terms: list[bytes]) -> None:
        self.by_source[source].update(terms)
        self.docs.update(set(terms))

    def held(self) -> int:
        return sum(map(len, self.by_source.values()))

    def trie(self) -> tuple[list[str], Trie]:
        """The sources and the trie of what was counted."""
        terms = sorted(self.docs)
        at = dict(zip(terms, range(len(terms)), strict=True))
        sources = sorted(self.by_source)
        leaf = np.concatenate([np.fromiter(map(at.__getitem__, self.by_source[s]), np.int64, len(self.by_source[s])) for s in sources])
        source = np.repeat(np.arange(len(sources)), [len(self.by_source[s]) for s in sources])
        count = np.concatenate([np.fromiter(self.by_source[s].values(), np.int64, len(self.by_source[s])) for s in sources])
        order = np.lexsort((source, leaf))
        return sources, Trie(terms, np.fromiter(map(self.docs.__getitem__, terms), np.int64, len(terms)), leaf[order], source[order], count[order])


def _row(part: int, lang: str, sources: list[str], trie: Trie) -> pa.RecordBatch:
    """A trie with the sums of its counters by source."""
    totals = np.zeros(len(sources), np.int64)
    np.add.at(totals, trie.source, trie.count)
    return pa.RecordBatch.from_pylist([{"part": part, "lang": lang, "sources": sources, "totals": totals.tolist(), "terms": len(trie.terms), "trie": trie.packed()}], _TRIES)


def _counted(batches: Iterator[pa.RecordBatch], bounds: list[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
    """Tries of documents (text, lang, source), cut at the bounds."""
    counts: dict[str, Counts] = defaultdict(Counts)

    def given() -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            sources, trie = own.trie()
            part, first = bisect_left(bounds, (lang, b"")), 0
            while first < len(trie.terms):
                inside = part < len(bounds) and bounds[part][0] == lang
                last = bisect_left(trie.terms, bounds[part][1], first) if inside else len(trie.terms)
                if last > first:
                    yield _row(part, lang, sources, trie.cut(first, last))
                part, first = part + inside, last
        counts.clear()

    for batch in parts(batches, 200):
        data, offsets = utf8_column(batch, "text")
        for k, (lang, source) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            counts[lang].add(source, terms_of(data[offsets[k] : offsets[k + 1]].tobytes()))
        if sum(c.held() for c in counts.values()) > HELD:
            yield from given()
    yield from given()
    release()


class Merged:
    """The tries of one range and language, merged one by one."""

    def __init__(self, part: int, lang: str) -> None:
        self.part, self.lang = part, lang
        self.at: dict[bytes, int] = {}
        self.sources: dict[str, int] = {}
        self.docs = np.zeros(1024, np.int64)
        self.code, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)  # leaf << 32 | source, in order
        self.open: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, sources: list[str], trie: Trie) -> None:
        leaf = np.fromiter((self.at.setdefault(t, len(self.at)) for t in trie.terms), np.int64, len(trie.terms))
        place = np.array([self.sources.setdefault(s, len(self.sources)) for s in sources], np.int64)
        while len(self.docs) < len(self.at):
            self.docs = np.concatenate([self.docs, np.zeros_like(self.docs)])
        self.docs[leaf] += trie.docs  # a trie has each leaf once
        self.open.append((leaf[trie.leaf] << 32 | place[trie.source], trie.count))
        self.waiting += len(trie.leaf)
        if self.waiting > max(HELD, len(self.code)):
            self.settle()

    def settle(self) -> None:
        self.code, self.count = added(np.concatenate([self.code, *[c for c, _ in self.open]]), np.concatenate([self.count, *[n for _, n in self.open]]))
        self.open, self.waiting = [], 0

    def given(self) -> Iterator[pa.RecordBatch]:
        """The merged trie, with the terms that LEAST documents have."""
        self.settle()
        names, terms = sorted(self.sources), sorted(self.at)
        new = np.zeros(len(terms), np.int64)
        new[[self.at[t] for t in terms]] = np.arange(len(terms))
        place = np.array([names.index(s) for s in self.sources], np.int64)
        leaf, source = new[self.code >> 32], place[self.code & 0xFFFFFFFF]
        order = np.lexsort((source, leaf))
        docs = np.zeros(len(terms), np.int64)
        docs[new] = self.docs[: len(terms)]
        whole = Trie(terms, docs, leaf[order], source[order], self.count[order])
        kept = whole.chosen(docs >= LEAST)
        if kept.terms:
            yield _row(self.part, self.lang, names, kept)


def added(code: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums by code, in its order."""
    if not len(code):
        return code, value
    order = np.argsort(code, kind="stable")
    code, value = code[order], value[order]
    starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[starts], np.add.reduceat(value, starts)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The merged tries of ranges, out of rows in order of (part, lang)."""
    merged = None
    for batch in parts(batches, 1):
        row = batch.to_pylist()[0]
        if merged is None or (merged.part, merged.lang) != (row["part"], row["lang"]):
            if merged is not None:
                yield from merged.given()
            merged = Merged(row["part"], row["lang"])
        merged.add(row["sources"], Trie.unpacked(row["trie"]))
    if merged is not None:
        yield from merged.given()
    release()


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the distinct (lang, term) of some documents the SAMPLED with the least checksum."""
    found: dict[tuple[str, bytes], int] = {}
    for batch in parts(batches, 200):
        data, offsets = utf8_column(batch, "text")
        for k, lang in enumerate(batch.column(1).to_pylist()):
            found |= {(lang, t): zlib.crc32(t) for t in set(terms_of(data[offsets[k] : offsets[k + 1]].tobytes()))}
        if len(found) > 10 * SAMPLED:
            found = dict(sorted(found.items(), key=lambda x: x[1])[:SAMPLED])
    chosen = sorted(found.items(), key=lambda x: x[1])[:SAMPLED]
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in chosen], pa.string()), pa.array([k[1] for k, _ in chosen], pa.binary())], ["lang", "term"])


def bounds_of(read: DataFrame) -> list[tuple[str, bytes]]:
    """Where ranges of (lang, term) begin but the first: as many as the texts ask for."""
    size = total_bytes(read)
    ranges = min(RANGES, size // RANGE)
    if ranges < 2:
        return []
    few = read.select("text", "lang").sample(min(1.0, SAMPLE / size), seed=13)
    found = sorted((r.lang, bytes(r.term)) for r in few.coalesce(8).mapInArrow(_sampled, "lang string, term binary").collect())
    return sorted({found[len(found) * k // ranges] for k in range(1, ranges)}) if found else []


def merged_tries(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """The merged tries of all ranges (TRIES), checkpointed, and the occurring (lang, source)."""
    read = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((text, "text"), (lang, "lang"), (source, "source"))])
    bounds = bounds_of(read)
    tries = read.mapInArrow(lambda batches: _counted(batches, bounds), TRIES)
    merged = checkpointed(tries.repartition("part", "lang").sortWithinPartitions("part", "lang").mapInArrow(_merge, TRIES))
    return merged, read.select("lang", "source").distinct()


def rates(count: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    """1 + floor(UNIT (count + 1) / (total + terms)), exactly."""
    if count.max(initial=0) < 9_000_000_000:
        return 1 + UNIT * (count + 1) // (total + terms)
    return np.array(1 + UNIT * (count.astype(object) + 1) // (np.asarray(total).astype(object) + terms), np.int64)


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q)."""
    return (p - q) ** 2 // q


def pairs_of_shared(place: np.ndarray, p: np.ndarray, zero: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of both sources, and corrections, of the terms that pairs have in common; ``size`` counts the sources of each term, PAIRS at a time, more or less."""
    start = np.cumsum(size) - size
    for s in np.unique(size[size > 1]).tolist():
        own = start[size == s]
        step, wide = max(1, PAIRS // (s * s)), max(1, min(s, PAIRS // s))
        for first in range(0, len(own), step):
            at = own[first : first + step, None] + np.arange(s)
            for low in range(0, s, wide):
                a, b = at[:, low : low + wide, None], at[:, None, :]
                zero_a, zero_b = zero[place[a]], zero[place[b]]
                fixed = gap(p[a], p[b]) - gap(p[a], zero_b) - gap(zero_a, p[b]) + gap(zero_a, zero_b)
                shape = fixed.shape
                yield np.broadcast_to(place[a], shape).ravel(), np.broadcast_to(place[b], shape).ravel(), fixed.ravel()


FOUND = "lang string, place bigint, other bigint, term string, value bigint"
_FOUND = pa.schema([("lang", pa.string()), ("place", pa.int64()), ("other", pa.int64()), ("term", pa.string()), ("value", pa.int64())])


class Walk:
    """What the second walk holds of one language: sums of pairs by the first source, and the best terms of each source."""

    def __init__(self, lang: str, totals: np.ndarray, terms: int) -> None:
        self.lang, self.totals, self.terms, self.n = lang, totals, terms, len(totals)
        self.zero = rates(np.zeros(self.n, np.int64), totals, terms)
        self.sums: dict[int, np.ndarray] = {}
        self.place, self.value, self.best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object)

    def _sum(self, place: int) -> np.ndarray:
        if place not in self.sums:
            self.sums[place] = np.zeros(self.n, np.int64)
        return self.sums[place]

    def take(self, trie: Trie) -> Iterator[pa.RecordBatch]:
        """A trie whose sources are places in the language's list."""
        p = rates(trie.count, self.totals[trie.source], self.terms)
        size = np.bincount(trie.leaf, minlength=len(trie.terms))
        yield from self._single(trie, p)
        for a, b, fixed in pairs_of_shared(trie.source, p, self.zero, size):
            code, value = added(a * self.n + b, fixed)
            first = np.flatnonzero(np.diff(code // self.n, prepend=-1))
            for low, high in zip(first, [*first[1:], len(code)], strict=True):
                self._sum(int(code[low] // self.n))[code[low:high] % self.n] += value[low:high]
            yield from self._full()
        self._candidates(trie, p)

    def _single(self, trie: Trie, p: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of each pair, what all terms of a trie add if no source had the other's."""
        own = np.bincount(trie.source, minlength=self.n)
        by = np.argsort(trie.source, kind="stable")
        cut = np.concatenate([[0], np.cumsum(own)])
        ours: dict[int, tuple[np.ndarray, np.ndarray]] = {a: np.unique(p[by[cut[a] : cut[a + 1]]], return_counts=True) for a in np.flatnonzero(own).tolist()}
        for a in range(self.n):
            row = self._sum(a)
            row += (len(trie.terms) - own[a] - own) * gap(self.zero[a], self.zero)
            if a in ours:
                rate, times = ours[a]
                row += (gap(rate[:, None], self.zero[None, :]) * times[:, None]).sum(0)
            row[list(ours)] += [int((gap(self.zero[a], rate) * times).sum()) for rate, times in ours.values()]
            yield from self._full()

    def _full(self) -> Iterator[pa.RecordBatch]:
        if len(self.sums) * self.n > 4 * PAIRS:
            yield from self.pairs()

    def _candidates(self, trie: Trie, p: np.ndarray) -> None:
        q = rates(np.bincount(trie.leaf, trie.count, len(trie.terms)).astype(np.int64) if trie.count.sum() < 2**53 else np.array([int(trie.count[trie.leaf == k].sum()) for k in range(len(trie.terms))], np.int64), int(self.totals.sum()), self.terms)[trie.leaf]
        some = p > q
        own, value, at = trie.source[some], gap(p[some], q[some]), trie.leaf[some]
        own, value = np.concatenate([self.place, own]), np.concatenate([self.value, value])
        at = np.concatenate([-1 - np.arange(len(self.place)), at])
        order = np.lexsort((np.arange(len(own)), -value, own))  # what was held comes first, and has the lesser terms
        own, value, at = own[order], value[order], at[order]
        start = np.flatnonzero(np.diff(own, prepend=-1))
        kept = np.arange(len(own)) - np.repeat(start, np.diff(np.concatenate([start, [len(own)]]))) < CANDIDATES
        self.place, self.value = own[kept], value[kept]
        best = np.empty(len(self.place), object)
        best[:] = [trie.terms[k] if k >= 0 else self.best[-1 - k] for k in at[kept].tolist()]
        self.best = best

    def pairs(self) -> Iterator[pa.RecordBatch]:
        for place, row in self.sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([self.lang] * self.n, pa.string()), pa.array([place] * self.n, pa.int64()), pa.array(np.arange(self.n)), pa.nulls(self.n, pa.string()), pa.array(row)], schema=_FOUND)
        self.sums = {}

    def given(self) -> Iterator[pa.RecordBatch]:
        yield from self.pairs()
        if n := len(self.place):
            yield pa.RecordBatch.from_arrays([pa.array([self.lang] * n, pa.string()), pa.array(self.place), pa.nulls(n, pa.int64()), pa.array(self.best.tolist(), pa.binary()).cast(pa.string()), pa.array(self.value)], schema=_FOUND)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of pairs and candidates, out of merged tries (lang, sources, trie, every, sums, lang_terms) in order of (lang, part)."""
    walk, places = None, {}
    for batch in parts(batches, 1):
        row = batch.to_pylist()[0]
        if walk is None or walk.lang != row["lang"]:
            if walk is not None:
                yield from walk.given()
            walk = Walk(row["lang"], np.array(row["sums"], np.int64), row["lang_terms"])
            places = {s: k for k, s in enumerate(row["every"])}
        trie = Trie.unpacked(row["trie"])
        trie.source = np.array([places[s] for s in row["sources"]], np.int64)[trie.source]
        yield from walk.take(trie)
    if walk is not None:
        yield from walk.given()
    release()


def diverge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value and rank."""
    tries, occurring = merged_tries(docs, text, lang, source)
    sums = tries.select("lang", F.inline(F.arrays_zip(F.col("sources").alias("source"), F.col("totals").alias("total")))).groupBy("lang", "source").agg(F.sum("total").alias("total"))
    groups = occurring.join(sums, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.expr("0L")))
    groups = checkpointed(groups.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("bigint") - 1))
    langs = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("g")).select("lang", F.col("g.source").alias("every"), F.col("g.total").alias("sums"))
    langs = langs.join(tries.groupBy("lang").agg(F.sum("terms").alias("lang_terms")), "lang")
    placed = tries.select("part", "lang", "sources", "trie").join(langs, "lang").repartition("part").sortWithinPartitions("lang", "part")
    found = checkpointed(placed.select("lang", "sources", "trie", "every", "sums", "lang_terms").mapInArrow(_walk, FOUND))

    other = groups.select("lang", F.col("place").alias("other"), F.col("source").alias("item"))
    values = found.where("other IS NOT NULL").groupBy("lang", "place", "other").agg(F.sum("value").alias("value"))
    pairs = groups.join(other, "lang").where("place <> other").join(values, ["lang", "place", "other"], "left").select("lang", "place", F.lit("pair").alias("part"), "item", F.coalesce("value", F.expr("0L")).alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "place").orderBy(F.desc("value"), "item")))

    best = found.where("other IS NULL").select("lang", "place", F.lit("term").alias("part"), F.col("term").alias("item"), "value", F.pmod(F.hash("term"), F.lit(SALTS)).alias("salt"))
    first = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "place", "salt").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= CANDIDATES).drop("salt", "rank")
    top = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "place").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= CANDIDATES)
    return pairs.unionByName(top).join(groups.select("lang", "place", "source"), ["lang", "place"]).select("lang", "source", "part", "item", "value", "rank")
