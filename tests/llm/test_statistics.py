"""Whitening, order fingerprints and the divergence of sources against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import divergence, fingerprints, queries, whitening

SF = "/root/testdata/sf0.001"
HERE = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
NAN, INF = float("nan"), float("inf")


# whitening


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n long, deviation string, component int, y int, key int, `a b` int")


def brute_white(rows, most=16):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    size = Counter(len(v) for _, v in kept).most_common(1)[0][0]
    kept = [(i, v) for i, v in kept if len(v) == size]
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in kept], object)
    fit = np.array(sorted({tuple(r) for r in x.tolist()}), object)
    n, sums = len(fit), fit.sum(0)
    centred = np.array((fit * n - sums), float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    real = values > 1e-9 * max(values.max(), 1e-30)
    white = np.array(x * n - sums, float) / n @ axes / np.where(real, np.sqrt(np.abs(values)), 1) * real
    return kept, n, [int(d) for d in ((x * n - sums) ** 2).sum(1)], white, values * real / max(np.trace(centred.T @ centred / n), 1e-30)


@pytest.mark.parametrize(("fan", "block", "size", "n"), [(8, 4096, 20, 300), (2, 7, 5, 120), (2, 3, 3, 2), (8, 4096, 4, 1), (2, 16, 24, 11)])
def test_whitening(spark, fan, block, size, n, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", fan)
    monkeypatch.setattr(whitening, "BLOCK", block)
    rnd = np.random.default_rng(size)
    scale = np.linspace(3, 0.5, size)
    rows = [(i, (rnd.normal(size=size) * scale).tolist()) for i in range(n)]
    rows += [(1000 + i % 3, rows[0][1]) for i in range(40)] + [(None, rows[-1][1]), (2, None), (3, [None] * size), (4, [NAN] + [0.0] * (size - 1)), (5, [INF] * size), (6, [3e38] * size), (7, []), (8, [1.0])]
    df = vectors_of(spark, [(i, v, 1, "d", 2, 3, 4, 5) for i, v in rows]).repartition(7)
    found = whitening.whiten(df).collect()
    kept, count, deviation, white, explained = brute_white([r for r in rows if r[1] != [3e38] * size])
    k = min(16, size)
    assert Counter(r.vec_id for r in found) == Counter({i: k * m for i, m in Counter(i for i, _ in kept).items()}) and {r.component for r in found} == set(range(1, k + 1))
    by = defaultdict(dict)
    for r in found:
        by[r.vec_id, r.deviation][r.component] = r
    for (i, _), d, w in zip(kept, deviation, white, strict=True):
        own = by[i, d]
        assert {r.n for r in own.values()} == {count} and np.allclose([own[c + 1].explained for c in range(k)], explained, atol=1e-9)
        if i is not None and i < 1000:
            gaps = explained[:-1] - explained[1:] > 1e-6
            clear = np.concatenate([[True], gaps]) & np.concatenate([gaps, [True]]) if k > 1 else np.array([True])
            assert np.allclose(np.abs([own[c + 1].whitened for c in range(k)])[clear[:k]], np.abs(w)[clear[:k]], atol=1e-6)
    assert {r.identity_error for r in found} == {found[0].identity_error} and found[0].identity_error < 1e-9


def test_merging_loses_nothing():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(200, 6)) * [1e3, 1, 1e-3, 5, 2, 0]
    whole, state = whitening.decomposed(x), None
    for part in np.array_split(x, 9):
        own = whitening.decomposed(part)
        state = own if state is None else whitening.merged(state, own)
    assert np.allclose(state.scale[:5], whole.scale[:5], rtol=1e-12) and np.allclose(state.mean, whole.mean, atol=1e-12) and np.allclose(np.abs((state.basis[:5] * whole.basis[:5]).sum(1)), 1)
    big = whitening.decomposed(np.full((3, 2), 2**62, np.int64))
    assert big.totals == [3 * 2**62] * 2 and whitening.State.of(big.row(4)).totals == big.totals
    assert whitening.deviations(np.array([[2**61, 0]], np.int64), 3, [0, 0]) == [None] and whitening.deviations(np.array([[5, 0]], np.int64), 3, [3, 0]) == [144]


def test_whitening_shapes(spark):
    df = vectors_of(spark, [(1, [0.5, 0.25], 1, "d", 2, 3, 4, 5), (2, [1.5, 0.25], 1, "d", 2, 3, 4, 5)])
    assert whitening.whiten(df).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    flat = sorted((r.vec_id, r.component, round(abs(r.whitened), 9), r.explained) for r in whitening.whiten(df).collect())
    assert flat == [(1, 1, 1.0, 1.0), (1, 2, 0.0, 0.0), (2, 1, 1.0, 1.0), (2, 2, 0.0, 0.0)]  # one dimension has no variance
    assert whitening.whiten(df.limit(0)).collect() == [] and whitening.whiten(df.where("vec_id = 9")).dtypes == whitening.whiten(df).dtypes
    assert whitening.whiten(vectors_of(spark, [(1, [], 1, "d", 2, 3, 4, 5)])).collect() == []


# order fingerprints


def brute_fingerprint(text):
    """Sketches out of dictionaries: the k-mers in each order, in plain integers."""
    m64, m32 = (1 << 64) - 1, (1 << 32) - 1

    def mixed(x):
        x = ((x ^ x >> 32) * 0xD6E8FEB86659FD93) & m64
        return x ^ x >> 29

    odd, codes, seen, own = 0x9E3779B97F4A7C15, [ord(c) + 1 for c in text], Counter(), []
    if not codes:
        return [0] * fingerprints.SKETCHES
    codes += [0] * (fingerprints.K - len(codes))
    for i in range(len(codes) - fingerprints.K + 1):
        kmer = tuple(codes[i : i + fingerprints.K])
        h = 0
        for c in kmer:
            h = (h * odd + c) & m64
        h = (mixed(h * odd & m64) + seen[kmer] * odd) & m64
        seen[kmer] += 1
        own.append((h * 0xD6E8FEB86659FD93 & m64) >> 32)
    out = []
    for times, starts in zip(fingerprints._TIMES.tolist(), fingerprints._STARTS.tolist(), strict=True):
        placed = sorted((h * times & m32, i) for i, h in enumerate(own))
        for start in starts:
            turned = sorted(placed, key=lambda p: ((p[0] << 32 | p[1]) < start, p))
            least = sorted((i, v) for v, i in turned[: fingerprints.TUPLE])
            h = int(fingerprints._SKETCH[len(out)])
            for k in range(fingerprints.TUPLE):
                h = mixed((h + (least[k][1] if k < len(least) else 1 << 32)) * odd & m64)
            out.append(h >> 48)
    return out


TEXTS = ["", "a", "abc", "abcdefgh", "abcdefghi", "a" * 40, "é 😀 z" * 9, "the cat sat on the mat and the cat sat on the rug", "İstanbul\n\tx\x00y" * 5]


def test_fingerprints():
    rnd = random.Random(3)
    for text in [*TEXTS, "".join(rnd.choice("abcd ") for _ in range(700))]:
        assert fingerprints.fingerprint(text).tolist() == brute_fingerprint(text)


def test_likeness_follows_order_and_edits():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9))) for _ in range(900)]
    text = " ".join(words)
    near = lambda a, b: fingerprints.likeness(fingerprints.fingerprint(a), fingerprints.fingerprint(b), not a, not b)
    edits = [near(text, " ".join(w if rnd.random() > share else "other" for w in words)) for share in (0.01, 0.1, 0.4)]
    assert edits[0] > 0.7 > edits[1] > edits[2] > 0
    moved = words[:]
    rnd.shuffle(blocks := [moved[k : k + 9] for k in range(0, 900, 9)])
    shuffled = " ".join(w for b in blocks for w in b)
    assert 0.2 < near(text, shuffled) < 0.75  # the same k-mers, but for the joins, in another order: a set of k-mers has 0.8 and more
    assert near(text, text) == near("", "") == 1 and near("", "a") == near("x" * 50, "y" * 50) == 0
    assert near("ab" * 40, "ab" * 80) < 1  # another number of the same k-mers


def brute_neighbours(rows):
    """Rows in descending order of the id, which must differ."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for k, (i, t) in enumerate(rows):
        t, other = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        new = t[: len(t) - half] + other[:half]
        a, b, c = (fingerprints.fingerprint(x) for x in (t, new, other))
        text = lambda f: "".join(f"{x:04x}" for x in f.tolist())
        out[i] = (i, len(t), hashlib.sha256(new.encode()).hexdigest(), text(a), text(b), fingerprints.likeness(a, b, not t, not new), fingerprints.likeness(a, c, not t, not other))
    return out


@pytest.mark.parametrize("ranges", [1, 3, 60])
def test_neighbours(spark, ranges):
    rnd = random.Random(ranges)
    rows = [(i * 7 % 101 - 30, rnd.choice([None, "", "é", "word " * rnd.randrange(300), "".join(rnd.choice("abc 😀") for _ in range(rnd.randrange(90)))])) for i in range(50)] + [(None, "last of all")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS at", "'x' AS mark", "2 AS part", "3 AS end", "4 AS n_chars", "5 AS `a b`").repartition(4)
    found = fingerprints.compare_neighbours(df, ranges=ranges)
    assert {r.doc_id: tuple(r) for r in found.collect()} == brute_neighbours(rows) and found.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def test_neighbours_of_few_and_equal_rows(spark):
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert fingerprints.compare_neighbours(df([])).collect() == []
    (one,) = fingerprints.compare_neighbours(df([(5, "a text of its own")])).collect()
    assert tuple(one) == brute_neighbours([(5, "a text of its own")])[5] and one.near_next == 1
    same = fingerprints.compare_neighbours(df([(5, "one text"), (5, "another")] * 30 + [(5, "one text")] * 100), ranges=5).collect()
    assert len(same) == 160 and len({r.fingerprint for r in same}) == 2
    assert sum(r.near_next < 1 for r in same) == 2  # equal rows stand together


@HERE
def test_neighbours_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = queries.QUERIES["op12_fingerprints"](spark, SF).collect()
    assert {r.doc_id: tuple(r) for r in found} == brute_neighbours([(r.doc_id, r.text) for r in docs.collect()])


# divergence of sources


def brute_divergence(rows):
    import re

    docs = [(lang or "", source or "", ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [(s, t) for g, s, t in docs if g == lang]
        held = Counter(x for _, t in own for x in set(t))
        kept = sorted((x for x, n in held.items() if n >= 3), key=str.encode)
        sources = sorted({s for s, _ in own}, key=str.encode)
        counts = {s: Counter(x for g, t in own if g == s for x in t if held[x] >= 3) for s in sources}
        every = sum(counts.values(), Counter())
        rate = lambda c: {x: 1 + 10**9 * (c[x] + 1) // (sum(c.values()) + len(kept)) for x in kept}
        p, q = {s: rate(counts[s]) for s in sources}, rate(every)
        for s in sources:
            pairs = sorted(((sum((p[s][x] - p[o][x]) ** 2 // p[o][x] for x in kept), o) for o in sources if o != s), key=lambda v: (-v[0], v[1].encode()))
            terms = sorted((((p[s][x] - q[x]) ** 2 // q[x], x) for x in kept if counts[s][x] and p[s][x] > q[x]), key=lambda v: (-v[0], v[1].encode()))[: divergence.CANDIDATES]
            out += [(lang, s, "pair", o, v, k) for k, (v, o) in enumerate(pairs, 1)] + [(lang, s, "term", x, v, k) for k, (v, x) in enumerate(terms, 1)]
    return sorted(out)


@pytest.mark.parametrize(("held", "range_", "pairs", "most"), [(500_000, 4 << 20, 1 << 20, 200), (60, 200, 3, 2)])
def test_divergence(spark, held, range_, pairs, most, monkeypatch):
    for name, value in (("HELD", held), ("RANGE", range_), ("PAIRS", pairs), ("CANDIDATES", most), ("SALTS", 2)):
        monkeypatch.setattr(divergence, name, value)
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(divergence)  # so that workers get the values above
    try:
        rnd = random.Random(held)
        words = ["a", "A", "ab", "abc", "abd", "É", "é", "éa", "日本", "x" * 70, "x" * 300, "don't", "b2b", "Zz", "z"]
        rows = [(" ".join(rnd.choice(words[: rnd.randrange(2, 15)]) for _ in range(rnd.randrange(30))), rnd.choice(["en", "de", None, "é"]), rnd.choice(["s1", "s10", "s2", None, "S"])) for _ in range(150)]
        rows += [(None, "en", "none"), ("", "fr", "s1"), ("1 2 3", "fr", "s2"), ("alone", "xx", "s1"), ("a a a", None, None)] + [("hot a b", "en", "s1")] * 80
        df = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 AS part", "2 AS value", "3 AS total", "4 AS place", "5 AS `a b`").repartition(5)
        found = divergence.diverge(df)
        assert sorted(tuple(r) for r in found.collect()) == brute_divergence(rows) and found.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert divergence.diverge(df.limit(0)).collect() == []
    finally:
        cloudpickle.unregister_pickle_by_value(divergence)


def test_tries_come_back_as_they_were():
    rnd = random.Random(2)
    counts = divergence.Counts()
    for _ in range(300):
        counts.add(rnd.choice(["a", "b", "c"]), [bytes(rnd.choice(b"ab\xc3\xa9") for _ in range(rnd.randrange(1, 9))) for _ in range(9)] + [b"long" * 300])
    sources, trie = counts.trie()
    back = divergence.Trie.unpacked(trie.packed())
    assert sources == ["a", "b", "c"] and back.terms == trie.terms == sorted(counts.docs) and back.docs.tolist() == [counts.docs[t] for t in trie.terms]
    assert {(back.terms[k], sources[s]): n for k, s, n in zip(back.leaf.tolist(), back.source.tolist(), back.count.tolist(), strict=True)} == {(t, s): n for s, c in counts.by_source.items() for t, n in c.items()}
    shared = divergence.shared_paths(np.frombuffer(b"".join(trie.terms), np.uint8), np.array([len(t) for t in trie.terms]))
    assert shared.tolist() == [0] + [len(os.path.commonprefix([a, b])) for a, b in zip(trie.terms, trie.terms[1:], strict=False)]
    assert len(trie.packed()) < sum(map(len, trie.terms))
    big = divergence.rates(np.array([10**13]), np.array([3 * 10**13]), 5)
    assert big.tolist() == [1 + 10**9 * (10**13 + 1) // (3 * 10**13 + 5)]


@HERE
def test_divergence_of_the_table(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL["op13_source_divergence"]).fetchall()
    assert sorted(tuple(r) for r in queries.QUERIES["op13_source_divergence"](spark, SF).collect()) == sorted(want)


@HERE
def test_whitening_of_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    kept, count, deviation, white, explained = brute_white(rows)
    found = {(r.vec_id, r.component): r for r in queries.QUERIES["op11_embedding_whitening"](spark, SF).collect()}
    assert len(found) == 16 * len(rows) and {r.n for r in found.values()} == {count} and all(r.identity_error <= 1e-4 for r in found.values())
    for (i, _), d, w in zip(kept, deviation, white, strict=True):
        assert all(found[i, c + 1].deviation == d and abs(abs(found[i, c + 1].whitened) - abs(w[c])) < 1e-6 and abs(found[i, c + 1].explained / explained[c] - 1) < 1e-6 for c in range(16))
