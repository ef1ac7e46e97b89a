"""Language identification in two levels: family first, then one-versus-one linear support vector machines within it.

Features are relative frequencies of hashed byte 2- and 3-grams of the lower-cased text (all but letters counts as one space). As the models are linear, a text's
score is the mean weight of its n-grams: whole texts are scored by one gather and one segmented sum, without a histogram.
Families are separated by one-versus-rest machines, languages of the predicted family by one machine per pair, by votes, then by summed margins.
The models are fitted on a bounded sample: the MOST_LANGUAGES labels with the most rows, and of each SAMPLE distinct rows at most, ALL_ROWS in all, by a hash of id and text; rows that repeat both count once. Feature extraction runs on the
executors, so no text reaches the driver, but the sample's histograms: 16 KB a row, a few KB as sent, compressed. A label is read up to LABEL characters. What is sent to the workers is the weights,
16 KB a machine: 33 MB at most, if all languages are of one family.

Defined results: a null text or one without letters is ``und`` with score 0. Null and empty labels and null ids aren't learnt from. With no labelled row
all texts are ``und``; with one language all texts with letters get it. Ties go to the first in alphabetical order. Very long texts count whole; repeated rows give repeated results; other columns are kept as they are, but for those named lang_pred and
score; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm._common import parts, slices, utf8_column, with_columns_of

SAMPLE, ALL_ROWS, MOST_LANGUAGES, LABEL, BINS, STEEPNESS, SLICE = 300, 6000, 64, 100, 4096, 2.5, 1 << 20
# Families of common languages by ISO 639-1 code. A code that isn't here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk pl cs sk bg sr hr sl mk be bs",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "indic": "hi bn mr ne gu pa ur",
    "sinitic": "zh yue",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0], f"only-{lang}")


def grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the 2- and 3-grams that start at each byte."""
    x = _FOLD[data].astype(np.uint32)
    y, z = np.append(x[1:], 32).astype(np.uint32), np.append(x[2:], [32, 32]).astype(np.uint32)[: len(x)]
    two = (x << 8 | y) * np.uint32(2654435761)
    three = ((x << 16 | y << 8 | z) + np.uint32(1)) * np.uint32(2246822519)
    return (two >> np.uint32(21)).astype(np.int32), ((three >> np.uint32(21)) + np.uint32(2048)).astype(np.int32)


class Model:
    """Weights by bin for each machine, and what the machines separate."""

    def __init__(self, langs: list[str], families: list[str], pairs: list[tuple[str, str]], weights: np.ndarray, bias: np.ndarray) -> None:
        self.langs, self.families, self.pairs, self.weights, self.bias = langs, families, pairs, weights, bias

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Margin of each machine for each row; the n-grams at a row's last bytes see spaces beyond its end."""
        n = len(offsets) - 1
        out = np.zeros((n, len(self.bias)))
        for first, last in slices(offsets, SLICE):
            a, z = int(offsets[first]), int(offsets[last])
            if a == z:
                continue
            total = np.zeros((last - first, len(self.bias)))
            for low in range(a, z, SLICE * 4):  # a row may be longer than a slice
                high = min(low + SLICE * 4, z)
                two, three = _cut_grams(data, offsets, low, high)
                inner = np.clip(offsets[first:last], low, high) - low
                full = inner < np.append(inner[1:], high - low)
                summed = self.weights[two] + self.weights[three]
                total[full] += np.add.reduceat(summed, inner[full], axis=0, dtype=np.float64) if full.any() else 0
            length = np.diff(offsets[first : last + 1])
            out[first:last] = total / np.maximum(length, 1)[:, None] / 2
        return out + self.bias

    def decide(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        n, k = len(margins), len(self.families) if len(self.families) > 1 else 0
        chosen = margins[:, :k].argmax(1) if k else np.zeros(n, int)
        if k:
            rest = np.sort(margins[:, :k], 1)
            sure = _sigmoid(rest[:, -1] - rest[:, -2])
        else:
            sure = np.ones(n)
        votes, sums, worst = (np.full((n, len(self.langs)), v) for v in (0.0, 0.0, np.inf))
        for j, (a, b) in enumerate(self.pairs):
            m, i, o = margins[:, k + j], self.langs.index(a), self.langs.index(b)
            votes[:, i] += m >= 0
            votes[:, o] += m < 0
            sums[:, i] += m
            sums[:, o] -= m
            worst[:, i] = np.minimum(worst[:, i], m)
            worst[:, o] = np.minimum(worst[:, o], -m)
        inside = np.array([[family(x) == f for x in self.langs] for f in self.families])[chosen]
        rank = np.where(inside, votes * 1e6 + np.clip(sums, -1e5, 1e5), -np.inf)
        best = rank.argmax(1)
        score = sure * _sigmoid(2 * worst[np.arange(n), best])
        return [self.langs[i] for i in best], score


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-STEEPNESS * np.clip(x, -50, 50)))


def _cut_grams(data: np.ndarray, offsets: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins for bytes low to high, where a row's n-grams don't reach into the next row."""
    part = data[low : min(high + 2, int(offsets[-1]))]
    two, three = (x[: high - low] for x in grams(part))
    ends = offsets[1:][(offsets[1:] > low) & (offsets[1:] <= high + 1)] - 1 - low
    for back in (0, 1):  # the last byte and the one before it
        at = np.unique(ends - back)
        at = at[(at >= 0) & (at < high - low)]
        starts = np.concatenate([data[low + at][:, None], np.full((len(at), 2), 32, np.uint8)], 1)
        if back:
            starts[:, 1] = data[low + at + 1]
            owner = np.searchsorted(offsets, low + at, "right")
            starts[:, 1] = np.where(offsets[owner] > low + at + 1, starts[:, 1], 32)
        b2, b3 = grams(starts.ravel())
        two[at], three[at] = b2[::3], b3[::3]
    return two, three


def histograms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Relative n-gram frequencies of each row."""
    out = np.zeros((len(offsets) - 1, BINS), np.float32)
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        if b > a:
            own = np.array([a, b])
            for low in range(a, b, SLICE):
                two, three = _cut_grams(data, own, low, min(low + SLICE, b))
                out[i] += np.bincount(two, minlength=BINS) + np.bincount(three, minlength=BINS)
            out[i] /= 2 * (b - a)
    return out


def fit_machine(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 100) -> tuple[np.ndarray, float]:
    """A linear support vector machine (squared hinge loss, classes weighted evenly) by accelerated gradient descent."""
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    v, w, t = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), 1.0
    step = 1 / (2 * ((x**2).sum(1).max() + 1) + penalty)
    for _ in range(steps):
        slack = np.maximum(1 - y * (x @ v[:-1].astype(x.dtype) + v[-1]), 0)
        pull = -2 * share * y * slack
        gradient = np.append(pull.astype(x.dtype) @ x + penalty * v[:-1], pull.sum())
        new, after = v - step * gradient, (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + (t - 1) / after * (new - w), new, after
    return w[:-1], float(w[-1])


def fit(x: np.ndarray, langs: np.ndarray) -> Model:
    """Family machines and pair machines from labelled histograms."""
    names = sorted(set(langs.tolist()))
    groups = sorted({family(n) for n in names})
    scale = 1 / np.sqrt(x.mean(0) + 1e-6) if len(x) else np.ones(BINS)
    scaled = x * scale
    scaled_norm = np.sqrt((scaled**2).sum(1).mean()) or 1.0 if len(x) else 1.0
    scale, scaled = scale * (4 / scaled_norm), (scaled * (4 / scaled_norm)).astype(np.float32)
    of_family = np.array([family(n) for n in langs])
    pairs = [p for g in groups for p in combinations([n for n in names if family(n) == g], 2)]
    machines = [fit_machine(scaled, np.where(of_family == g, 1.0, -1.0)) for g in groups] if len(groups) > 1 else []
    for a, b in pairs:
        own = (langs == a) | (langs == b)
        machines.append(fit_machine(scaled[own], np.where(langs[own] == a, 1.0, -1.0)))
    weights = np.stack([w * scale for w, _ in machines], 1).astype(np.float32) if machines else np.zeros((BINS, 0), np.float32)
    return Model(names, groups, pairs, weights, np.array([b for _, b in machines]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def sampled(docs: DataFrame, doc_id: str, text: str, lang: str, sample: int) -> tuple[DataFrame, int]:
    """Label l, place h and text t of rows to learn from, each text and id once, and how many of a language are to be used: about one and a half times as many are here.

    A language's rows are those below a bound on a hash of id and text; the bound follows the approximate number of distinct rows, so rows that repeat one id or text take no one's place. Labels are counted without their texts,
    and the counts of the languages that are learnt are joined by broadcast.
    """
    label = F.substring(F.col(f"`{lang}`"), 1, LABEL)
    key = F.xxhash64(F.lit("langid"), F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    usable = (F.length(label) > 0) & F.col(f"`{doc_id}`").isNotNull() & ~held_out(F.col(f"`{doc_id}`")) & (F.length(F.coalesce(F.col(f"`{text}`"), F.lit(""))) > 0)
    labelled = docs.where(usable).select(label.alias("l"), key.alias("k"), F.col(f"`{text}`").alias("t"))
    counts = labelled.groupBy("l").agg(F.approx_count_distinct("k").alias("n"), F.count("*").alias("rows")).orderBy(F.desc("rows"), "l").limit(MOST_LANGUAGES).collect()
    each = min(sample, max(1, ALL_ROWS // max(1, len(counts))))
    share = docs.sparkSession.createDataFrame([(r.l, min(1.0, (1.5 * each + 20) / max(1, r.n))) for r in counts], "l string, share double")
    place = (F.pmod("k", F.lit(1 << 40)) / float(1 << 40)).alias("h")
    chosen = labelled.join(F.broadcast(share), "l").where(F.pmod("k", F.lit(1 << 40)) / float(1 << 40) <= F.col("share"))
    return chosen.groupBy("l", "k").agg(F.first("t").alias("t")).select("l", place, "t"), each


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Fit on ``sample`` labelled rows of each language at most, none of them held out."""
    chosen, each = sampled(docs, doc_id, text, lang, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                part = batch.slice(first, 200)
                x = histograms(*utf8_column(part, "t"))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([zstandard.compress(r.astype("<f4").tobytes(), 1) for r in x], pa.binary())], ["l", "h", "x"])

    found: dict[str, list[bytes]] = {}
    for r in sorted(chosen.mapInArrow(run, "l string, h double, x binary").collect(), key=lambda r: (r.l, r.h, bytes(r.x))):
        own = found.setdefault(r.l, [])
        if len(own) < each:
            own.append(bytes(r.x))
    rows = [(name, np.frombuffer(zstandard.decompress(x), "<f4")) for name, own in found.items() for x in own]
    return fit(np.stack([x for _, x in rows]) if rows else np.zeros((0, BINS)), np.array([name for name, _ in rows], object))


def predict(docs: DataFrame, model: Model, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score in the columns ``pred`` and ``score``; columns of these names are replaced."""
    kept = docs.drop(pred, score)
    text = f"c{kept.columns.index(text)}"
    box = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = box.value
        for batch in parts(batches):
            data, offsets = utf8_column(batch, text)
            named = [x is not None and _LETTER.search(x) is not None for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            langs, sure = own.decide(own.margins(data, offsets)) if own.langs else (["und"] * batch.num_rows, np.zeros(batch.num_rows))
            found = [x if ok else "und" for x, ok in zip(langs, named, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(np.where(named, sure, 0.0), pa.float64())], [*batch.schema.names, pred, score])

    return with_columns_of(kept, run, f"{pred} string, {score} double")
