"""BPE encoding and decoding with a public vocabulary file, word by word.

A text is normalised and split as the vocabulary file says. Each distinct word is merged once in a contiguous rank
array: the word's symbols stay one string, over which part boundaries are held beside the rank of each part joined to the next. The minimum is found by a scan, its boundary
deleted and the two neighbouring ranks refreshed. Words are short, so the scans beat a heap; a word of more
than LONG symbols is merged with a heap over the same boundaries instead, with the same result. Workers keep finished words in a
dictionary of CACHE_BYTES and one document's words at most; words beyond CACHED characters aren't kept. No shuffle: a map over Arrow batches, texts are never cut.

Texts of characters below U+0250 are normalised and split here; for others the tables of Python and of the tokenizers library may be of different Unicode versions, so the library's own normaliser and
pre-tokenizer make the words, which are merged here all the same.

Supported file layout: BPE with an end-of-word suffix, NFC, white space to one space, lower case, a removing split pattern and
byte-level symbols. Special tokens in a text become their ids, as in the library. Defined results: null and empty texts encode to no ids and
decode to the empty text; very long texts and words are encoded whole; repeated rows give repeated results; null ids stay null; other columns are kept as they are, but for those named ids and decoded; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import ChainMap
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from codeloom.llm._common import parts, texts, with_columns_of

LONG, CACHED, CACHE_BYTES = 256, 64, 128 << 20
_NEVER = 1 << 60
_BEYOND_LATIN = re.compile("[^\x00-\u024f]").search


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def merge(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The parts of a word after all merges, lowest rank first, leftmost first among equals."""
    word, bounds = "".join(symbols), list(accumulate(map(len, symbols), initial=0))
    if len(symbols) > LONG:
        return _merge_long(word, bounds, ranks)
    get = ranks.get
    low = [get(pair, _NEVER) for pair in zip(symbols, symbols[1:], strict=False)]
    while low:
        best = min(low)
        if best == _NEVER:
            break
        i = low.index(best)
        del bounds[i + 1], low[i]
        if i:
            low[i - 1] = get((word[bounds[i - 1] : bounds[i]], word[bounds[i] : bounds[i + 1]]), _NEVER)
        if i < len(low):
            low[i] = get((word[bounds[i] : bounds[i + 1]], word[bounds[i + 1] : bounds[i + 2]]), _NEVER)
    return [word[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def _merge_long(word: str, bounds: list[int], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The same with a heap; a boundary that is gone has no next one, and an entry of the heap holds only while its three boundaries follow each other."""
    n = len(bounds) - 1
    after, before = [*range(1, n + 1), -1], list(range(-1, n))
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and 0 <= (j := after[i]) < n and (r := ranks.get((word[bounds[i] : bounds[j]], word[bounds[j] : bounds[k := after[j]]]))) is not None:
            heapq.heappush(heap, (r, i, j, k))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, j, k = heapq.heappop(heap)
        if after[i] == j and after[j] == k:
            after[i], after[j], before[k] = k, -1, i
            offer(before[i])
            offer(i)
    left = [0]
    while left[-1] < n:
        left.append(after[left[-1]])
    return [word[bounds[a] : bounds[b]] for a, b in zip(left, left[1:], strict=False)]


class WordBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        splits = spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in splits] != ["Split", "ByteLevel"] or spec["decoder"] or model["fuse_unk"] or model["byte_fallback"]:
            raise ValueError(f"{path}: this layout isn't supported")
        self.vocabulary: dict[str, int] = model["vocab"]
        self.ranks = {tuple(x if isinstance(x, list) else x.split(" ")): k for k, x in enumerate(model["merges"])}
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocabulary.items()} | {i: t for t, i in self.special.items()}
        self.find = regex.compile(splits[0]["pattern"]["Regex"]).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        self.symbols = byte_symbols()
        self.known: tuple[dict[str, list[int]], dict[str, list[int]]] = {}, {}  # of words, and of words as symbols
        self.held = 0

    @cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def _merged(self, symbols: list[str]) -> list[int]:
        symbols[-1] += self.suffix
        vocabulary = self.vocabulary
        return [vocabulary[x] for x in merge(symbols, self.ranks) if x in vocabulary]

    def _ids(self, words: list[str], known: dict[str, list[int]], symbols: Callable[[str], list[str]]) -> list[int]:
        if self.held > CACHE_BYTES:
            for kept in self.known:
                kept.clear()
            self.held = 0
        long: dict[str, list[int]] = {}
        for word in set(words).difference(known):
            ids = self._merged(symbols(word))
            if len(word) <= CACHED:
                known[word] = ids
                self.held += 300 + 4 * len(word) + 8 * len(ids)
            else:
                long[word] = ids
        found = ChainMap(long, known) if long else known
        return list(chain.from_iterable(map(found.__getitem__, words)))

    def _plain(self, text: str) -> list[int]:
        if _BEYOND_LATIN(text):
            library = self.library
            words = [w for w, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text)) if w]
            return self._ids(words, self.known[1], list)
        return self._ids(self.find(text.lower()), self.known[0], lambda word: [self.symbols[b] for b in word.encode()])

    def encode(self, text: str) -> list[int]:
        if "<|" not in text:
            return self._plain(text)
        return [i for k, part in enumerate(self.cut(text)) for i in ([self.special[part]] if k % 2 else self._plain(part))]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces, which is what the library does for a file that names no decoder; special tokens are kept."""
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=4)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """``docs`` with ids array<int> and decoded string; columns of these names are replaced."""
    kept = docs.drop("ids", "decoded")
    text = f"c{kept.columns.index(text)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in parts(batches):
            ids = [bpe.encode(x) for x in texts(batch, text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(map(bpe.decode, ids), pa.string())], [*batch.schema.names, "ids", "decoded"])

    return with_columns_of(kept, run, "ids array<int>, decoded string")


def digest_documents(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256, made where the ids are, so that no ids cross to the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in parts(batches):
            sizes, of_ids, of_text = [], [], []
            for x in texts(batch, text):
                ids = bpe.encode(x)
                sizes.append(len(ids))
                of_ids.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(doc_id, text).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
