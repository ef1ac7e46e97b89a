"""Token counts under a unigram vocabulary, by dynamic programming shared along a trie.

The distinct pre-tokens of a batch go into a trie, walked in sorted order: the walk keeps one column of forward scores for each character of the current
path, so a prefix that several pre-tokens share is scored once, and each terminal stores the number of tokens on its best path. A document's count
is the sum over its pre-tokens. Counts of finished pre-tokens stay in a dictionary of the worker of at most CACHE_BYTES; those beyond CACHED characters aren't kept. No shuffle.

The text is normalised as the file says: no change of characters, a space before a text that isn't empty, spaces written as U+2581. A pre-token is a run of spaces with the run of other characters behind it, or a
single character of GAPS. No piece holds a space behind another character, or one of GAPS, which is checked; so the best path of a text is that of its pre-tokens. Pieces of a unigram file have the file's
scores. The files at hand are BPE models, whose scores are merge ranks and no probabilities; there a piece's score is its log probability by Zipf's law over the order of the vocabulary,
-log(rank * H) with H the sum of 1 / rank. The best path has the greatest sum, and
among equal sums the fewest tokens. A character that no piece covers is its UTF-8 bytes, each a token with the score of the last rank.
Beside it, n_pieces is what the sentencepiece library counts for the whole text with the same file, asked once for each distinct pre-token.

Defined results: null and empty texts have 0 words, tokens and pieces, texts of white space only have no words but tokens; very long texts and words are counted whole, in memory that grows with the longest text; repeated rows give repeated results; null ids
stay null; columns but the id and the text are left out, so their names don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import SentencePieceProcessor

from codeloom.llm._common import parts, texts

MARK, GAPS, CACHED, CACHE_BYTES = "▁", "\t\n", 64, 128 << 20
_PRE_TOKENS = re.compile(f" *[^ {GAPS}]+| +|[{GAPS}]").findall
_HALF = 40  # a pair of counts is one number, so that sums of pairs are sums of numbers


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a whole text in order, with plain spaces."""
    return _PRE_TOKENS(" " + (text.replace(MARK, " ") if MARK in text else text)) if text else []


class UnigramCounter:
    """Counts tokens of pre-tokens for pieces with additive scores."""

    def __init__(self, pieces: dict[str, float], byte: float, library: Callable[[str], int] | None = None) -> None:
        if odd := [p for p in pieces if MARK in p.lstrip(MARK) or any(c in p for c in GAPS)]:
            raise ValueError(f"pieces that join pre-tokens aren't supported: {odd[:3]}")
        self.pieces, self.byte, self.library = pieces, byte, library
        self.tails = {p[i:] for p in pieces for i in range(len(p))}
        self.known: dict[str, int] = {}
        self.held = 0

    def count_all(self, words: list[str]) -> dict[str, int]:
        """Tokens of each of the sorted distinct pre-tokens."""
        pieces, tails, byte = self.pieces, self.tails, self.byte
        out, path, score, tokens = {}, "", [0.0], [0]
        for word in words:
            shared = sum(1 for _ in takewhile(lambda x: x[0] == x[1], zip(path, word, strict=False)))
            del score[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                width = len(word[end - 1].encode())
                best, least = score[end - 1] + byte * width, tokens[end - 1] + width
                start = end - 1
                while start >= 0 and (tail := word[start:end]) in tails:
                    if (piece := pieces.get(tail)) is not None:
                        s, n = score[start] + piece, tokens[start] + 1
                        if s > best or s == best and n < least:
                            best, least = s, n
                    start -= 1
                score.append(best)
                tokens.append(least)
            path = word
            out[word] = tokens[-1]
        return out

    def documents(self, rows: list[str]) -> Iterator[tuple[int, int, int]]:
        """Words, tokens and the library's pieces of each text."""
        if self.held > CACHE_BYTES:
            self.known.clear()
            self.held = 0
        split = [pre_tokens(x) for x in rows]
        new = {w.replace(" ", MARK): w for w in set().union(*split).difference(self.known)}
        long = []
        for word, n in self.count_all(sorted(new)).items():
            raw = new[word]
            self.known[raw] = n << _HALF | (self.library(raw) if self.library else n)
            self.held += 200 + 4 * len(raw)
            if len(raw) > CACHED:
                long.append(raw)
        for text, words in zip(rows, split, strict=True):
            both = sum(map(self.known.__getitem__, words))
            yield len(text.split()), both >> _HALF, both & (1 << _HALF) - 1
        for raw in long:
            self.held -= 200 + 4 * len(raw)
            del self.known[raw]


def zipf(ranks: int) -> np.ndarray:
    """Log probabilities of as many ranks by Zipf's law."""
    each = 1 / np.arange(1, ranks + 1)
    return np.log(each / each.sum())


@lru_cache(maxsize=2)
def load(path: str) -> UnigramCounter:
    """The normal pieces of a sentencepiece file with unigram scores."""
    model = SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    pieces = [model.id_to_piece(i) for i in ids]
    given = np.array([model.get_score(i) for i in ids])
    if (given == np.round(given)).all():  # merge ranks; those of pieces for runs of spaces are outside of the order and stand first
        scores = zipf(len(ids) + 1)
        byte = float(scores[-1])
    else:
        scores, byte = given, float(given.min())
    start = len(model.encode("\n"))  # what the library counts for the space before a text and a character of GAPS

    def library(word: str) -> int:
        if word[0] == " ":
            return len(model.encode(word[1:])) if len(word) > 1 else 1
        return 1 if word in GAPS else len(model.encode("\n" + word)) - start

    return UnigramCounter(dict(zip(pieces, scores.tolist(), strict=False)), byte, library)


def count_tokens(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens and n_pieces of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(vocabulary)
        for batch in parts(batches, 500):
            counts = list(counter.documents(texts(batch, text)))
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], ["doc_id", "n_words", "n_tokens", "n_pieces"])

    return docs.select(doc_id, text).mapInArrow(run, "doc_id bigint, n_words bigint, n_tokens bigint, n_pieces bigint")
