"""The training-data operators against brute force, round trips and held-out accuracy, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import io
import os
import random
import re
import wave
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
import xxhash
from pyspark.sql import functions as F

from codeloom.llm import _common, bpe, exact_dedup, html_extract, langid, media, near_copies, packing, queries, sharding, simhash, suffix_dedup, token_counts

SF = "/root/testdata/sf0.001"
HERE = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
LONG = "word " * 30_000
CASES = [(1, "Aa bb Cc"), (2, "aA BB cC"), (2, "aA BB cC"), (None, "aa bb cc"), (5, None), (6, ""), (7, "x"), (None, None), (9, "É 😀 z"), (10, "é 😀 z"), (11, LONG), (12, "a\r\n\tb \x0b c"), (13, " "), (14, "123 !!")]


def docs_of(spark, rows=CASES):
    return spark.createDataFrame(rows, "doc_id long, text string")


def clashing(spark):
    """Extra columns whose names the operators use themselves."""
    return docs_of(spark, [(i, t) for i, t in CASES if t != LONG]).selectExpr("*", "1 AS size", "2 AS slot", "3 AS shard", "4 AS key", "'x' AS hash", "5 AS count", "6 AS ids", "7 AS kept", "8 AS score", "9 AS n_bytes", "'y' AS lang", "0 AS __dup", "1.5D AS `odd name`", "7 AS `a.b`")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def total(rows):
    return sorted(map(tuple, rows), key=repr)


# exact dedup


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lowered(t), []).append(i)
    keep = {k: max((i for i in v if i is not None), default=None) for k, v in groups.items()}
    return [(i, keep[lowered(t)], len(groups[lowered(t)]), i == keep[lowered(t)]) for i, t in rows]


@pytest.mark.parametrize("prefix", [1, 64])
def test_exact_dedup(spark, prefix):
    rnd = random.Random(1)
    rows = CASES + [(100 + i, rnd.choice("abAB") * rnd.randrange(1, 4) + rnd.choice(["", "x" * 70, "x" * 69 + "y"])) for i in range(80)]
    found = exact_dedup.exact_dedup(docs_of(spark, rows), prefix_chars=prefix)
    assert total(found.collect()) == total(brute_exact(rows))
    kept = exact_dedup.drop_exact_copies(docs_of(spark, rows), prefix_chars=prefix).collect()
    assert Counter(lowered(r.text) for r in kept) == Counter({lowered(t): 1 for _, t in rows})
    assert all(r.doc_id == max((i for i, t in rows if lowered(t) == lowered(r.text) and i is not None), default=None) for r in kept)


def test_exact_dedup_with_a_full_bitmap(spark, monkeypatch):
    monkeypatch.setattr(_common, "WORDS", 1)
    rnd = random.Random(2)
    rows = CASES + [(100 + i % 150, f"{'xX'[i % 2]} {rnd.randrange(90)}") for i in range(200)]
    assert total(exact_dedup.exact_dedup(docs_of(spark, rows)).collect()) == total(brute_exact(rows))
    kept = exact_dedup.drop_exact_copies(docs_of(spark, rows)).collect()
    assert Counter(lowered(r.text) for r in kept) == Counter({lowered(t): 1 for _, t in rows})


def exchanged(df):
    """The columns that go through each exchange of a plan."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return re.findall(r"\) (?:Broadcast)?Exchange\nInput \[\d+\]: \[(.*)\]", plan)


@HERE
def test_exact_dedup_shuffles_no_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df, most in ((exact_dedup.exact_dedup(docs, digest="text_sha256"), 0), (exact_dedup.drop_exact_copies(docs), 2)):
        found = exchanged(df)
        assert found and sum("text" in x for x in found) <= most  # the second: only rows that the bitmap names as dropped


def test_exact_dedup_shapes(spark):
    df = clashing(spark)
    assert exact_dedup.drop_exact_copies(df).columns == df.columns
    assert exact_dedup.exact_dedup(df).count() == df.count()
    assert exact_dedup.exact_dedup(df.limit(0)).collect() == [] and exact_dedup.drop_exact_copies(df.limit(0)).collect() == []


# sharding


@pytest.mark.parametrize("n", [0, 1, 2, 5, 97, 1000])
def test_sharding(spark, n, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 100)
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text é "), F.col("id")).alias("text"))
    rows = sharding.shard(df, 7).collect()
    counts = Counter(r.shard for r in rows)
    assert len(rows) == n and max(counts.values(), default=0) - min((counts[k] for k in range(7)), default=0) <= 1
    assert {(r.shard, r.slot) for r in rows} == {(k, s) for k in range(7) for s in range(counts[k])}
    assert all(r.text_crc32 == zlib.crc32(r.text.encode()) and r["size"] == len(r.text.encode()) + 8 for r in rows)
    assert total(sharding.shard(df.repartition(5), 7).collect()) == total(rows)
    if n > 90:
        assert [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))] != list(range(n))
        assert total(sharding.shard(df, 7, seed=1).collect()) != total(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 101, 4096])
def test_permutation(spark, n):
    first, place = sharding.permuted(F.col("id"), n, 3)
    found = [r.p for r in spark.range(n).withColumn("__sh_first", first).withColumn("p", place).collect()]
    assert sorted(found) == list(range(n))


def test_sharding_cases(spark):
    rows = sharding.shard(docs_of(spark), 3).collect()
    assert len(rows) == len(CASES) and {(r.shard, r.slot) for r in rows} == {(k, s) for k in range(3) for s in range(5)} - {(2, 4)}
    assert sharding.shard(clashing(spark), 3).count() == len(CASES) - 1
    with pytest.raises(ValueError, match="positive"):
        sharding.shard(docs_of(spark), 0)


# BPE


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.WORD_BPE)


TRICKY = ["", "  ", "İI ΣΑΣ Å á ẞ don't I'LL 12³½ x　y z", "<|endoftext|> <|startoftext|>a<|endoftext|>b", "日本語", "a" * 1000, "ab" * 700 + " x", "<|x|> <| endoftext|>", "\x00\x01\x85 a", "'S 'T x's'd 'LL", LONG]


def differ(texts):
    own, theirs = bpe.load(queries.WORD_BPE), library()
    return [t for t, e in zip(texts, theirs.encode_batch(texts, add_special_tokens=False), strict=True) if own.encode(t) != e.ids or own.decode(e.ids) != theirs.decode(e.ids, skip_special_tokens=False)]


def test_bpe_matches_the_library():
    rnd = random.Random(11)
    latin = ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(160, 0x250), rnd.randrange(9, 14)])) for _ in range(rnd.randrange(1, 60))) for _ in range(2000)]
    mixed = ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0xA0, 0xD800), rnd.randrange(0xE000, 0x20000), 10])) for _ in range(rnd.randrange(1, 60))) for _ in range(10_000)]
    assert differ(TRICKY + latin + mixed) == []


@pytest.mark.parametrize("form", ["%s", "a%sb", "e%sś"])
def test_bpe_matches_the_library_for_each_character(form):
    assert differ([form % chr(c) for c in [*range(0xD800), *range(0xE000, 0x20000)]]) == []


def test_bpe_long_words_agree(monkeypatch):
    own, rnd = bpe.load(queries.WORD_BPE), random.Random(3)
    for _ in range(80):
        symbols = [own.symbols[b] for b in "".join(rnd.choice("theandin") for _ in range(rnd.randrange(1, 250))).encode()]
        short = bpe.merge(symbols, own.ranks)
        with monkeypatch.context() as m:
            m.setattr(bpe, "LONG", 0)
            assert bpe.merge(symbols, own.ranks) == short and "".join(short) == "".join(symbols)
    for kept in own.known:
        kept.clear()
    monkeypatch.setattr(bpe, "CACHE_BYTES", 900)
    monkeypatch.setattr(bpe, "CACHED", 4)
    assert differ(["one two three four five six one", "one αβ six αβγδε", "one"]) == [] and own.held <= 900 + 4 * 400 and all(len(w) <= 4 for kept in own.known for w in kept)


def test_bpe_columns(spark):
    theirs = library()
    for r in bpe.encode_documents(docs_of(spark), queries.WORD_BPE).collect():
        e = theirs.encode(r.text or "", add_special_tokens=False)
        assert r.ids == e.ids and r.decoded == theirs.decode(e.ids, skip_special_tokens=False)
    assert bpe.encode_documents(clashing(spark), queries.WORD_BPE).columns[-2:] == ["ids", "decoded"]
    empty = docs_of(spark).limit(0)
    assert bpe.encode_documents(empty, queries.WORD_BPE).collect() == [] and bpe.digest_documents(empty, queries.WORD_BPE).collect() == []
    digests = {(r.doc_id, r.n_tokens): r for r in bpe.digest_documents(docs_of(spark), queries.WORD_BPE).collect()}
    e = theirs.encode("x", add_special_tokens=False)
    assert digests[7, 1].ids_sha256 == hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest()


# token counts


def brute_tokens(text, pieces, byte):
    marked = token_counts.MARK + text.replace(" ", token_counts.MARK) if text else ""
    best = [(0.0, 0)]
    for end in range(1, len(marked) + 1):
        width = len(marked[end - 1].encode())
        options = [(best[end - 1][0] + byte * width, best[end - 1][1] + width)] + [(best[s][0] + pieces[marked[s:end]], best[s][1] + 1) for s in range(max(0, end - 20), end) if marked[s:end] in pieces]
        best.append(min(options, key=lambda o: (-round(o[0], 6), o[1])))
    return best[-1][1]


def test_token_counts():
    pieces = {"▁": -3.0, "▁a": -1.0, "a": -2.0, "ab": -1.5, "b": -2.0, "abab": -3.0, "▁ab": -2.0, "▁▁": -3.5}
    rnd = random.Random(4)
    rows = ["".join(rnd.choice("abcé \n\t") for _ in range(rnd.randrange(40))) for _ in range(300)]
    found = list(token_counts.UnigramCounter(pieces, -12.0).documents(rows))
    assert found == [(len(t.split()), n := brute_tokens(t, pieces, -12.0), n) for t in rows]
    with pytest.raises(ValueError, match="join"):
        token_counts.UnigramCounter({"a▁b": -1.0}, -9.0)


def test_token_counts_of_the_file(spark, monkeypatch):
    from sentencepiece import SentencePieceProcessor

    model, real, rnd = SentencePieceProcessor(model_file=queries.PIECES), token_counts.load(queries.PIECES), random.Random(5)
    odd = ["a\nb  c\t\td ", "  x y ", "▁a▁▁b", "\n\n a", "   ", "日本 Ⅳ\x00x", "<s> a</s><0x0A>", "\ra\r\nb"] + ["".join(rnd.choice("ab \n\té日\x85　") for _ in range(rnd.randrange(30))) for _ in range(500)]
    rows = CASES + [(100 + i, t) for i, t in enumerate(odd)]
    want = Counter((i, len((t or "").split()), brute_tokens(t or "", real.pieces, real.byte), len(model.encode(t or ""))) for i, t in rows)
    assert Counter(map(tuple, token_counts.count_tokens(docs_of(spark, rows), queries.PIECES).collect())) == want
    assert token_counts.count_tokens(docs_of(spark).limit(0), queries.PIECES).collect() == []
    assert token_counts.count_tokens(clashing(spark).selectExpr("*", "1 AS n_tokens", "2 AS n_words"), queries.PIECES).columns == ["doc_id", "n_words", "n_tokens", "n_pieces"]
    monkeypatch.setattr(token_counts, "CACHE_BYTES", 0)
    monkeypatch.setattr(token_counts, "CACHED", 2)
    small = token_counts.UnigramCounter(real.pieces, real.byte, real.library)
    assert [n for _, _, n in small.documents(odd)] == [len(model.encode(t)) for t in odd] and all(len(w) <= 2 for w in small.known)


@HERE
def test_token_counts_against_the_library(spark):
    found = token_counts.count_tokens(spark.read.parquet(f"{SF}/documents.parquet"), queries.PIECES).agg(F.sum("n_tokens"), F.sum("n_pieces")).first()
    assert abs(found[0] / found[1] - 1) < 0.03


# SimHash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(items, linked):
    parent = {x: x for x in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(items):
        for b in items[k + 1 :]:
            if linked(a, b):
                a_, b_ = find(a), find(b)
                parent[max(a_, b_)] = min(a_, b_)
    return {x: find(x) for x in items}


def test_fingerprints_and_groups(spark):
    rnd = random.Random(5)
    base = [" ".join(rnd.choice(["alpha", "beta", "Gamma", "delta", "eps", "zeta"]) for _ in range(40)) for _ in range(12)]
    rows = CASES[:10] + [(20 + i, rnd.choice(base)) for i in range(30)] + [(60 + i, t + " end") for i, t in enumerate(base)]
    found = simhash.near_groups(docs_of(spark, rows)).collect()
    prints = [brute_fingerprint(t) for _, t in rows]
    assert Counter((r.doc_id, r.fp % (1 << 64)) for r in found) == Counter((i, f) for (i, _), f in zip(rows, prints, strict=True))
    root = roots(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (i, _), f in zip(rows, prints, strict=True):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    assert all(r.component_id == least[root[r.fp % (1 << 64)]] for r in found)
    kept = simhash.drop_near_copies(docs_of(spark, rows)).collect()
    assert sorted({r.doc_id for r in kept}) == sorted(set(least.values()))


@pytest.mark.parametrize("hot", [0, 1, 3, 100])
def test_links_lose_nothing(spark, hot):
    rnd = random.Random(6)
    prints = {rnd.getrandbits(64) for _ in range(40)}
    for f in list(prints)[:15]:
        for _ in range(8):
            prints.add(f ^ sum(1 << b for b in rnd.sample(range(64), rnd.choice([1, 2, 3]))))
    prints = sorted(int(x) for x in np.array(sorted(prints), np.uint64).view(np.int64))
    found = simhash.components(simhash.links(spark.createDataFrame([(x,) for x in prints], "fp long"), hot)).collect()
    own = {x: x for x in prints} | {r.node: r.root for r in found}
    assert own == roots(prints, lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 2)


def test_crowded_buckets_stay_cheap(spark):
    rnd = random.Random(8)
    low, high = [rnd.sample(range(1 << 32), 40) for _ in range(2)]
    prints = [h << 32 | a for h in high for a in low]
    prints += [prints[0] ^ 5, prints[7] ^ 1 << 40 ^ 1, prints[9] ^ 3 << 50]
    distinct = spark.createDataFrame([(x,) for x in np.array(prints, np.uint64).view(np.int64).tolist()], "fp long")
    by_key = simhash.buckets(simhash.indexed(distinct), ["key"])
    assert by_key.count() >= 64 * 1600 and by_key.where(F.col("n") <= simhash.HOT).count() < 200  # all buckets are crowded
    by_part = simhash.buckets(simhash.refined(by_key), ["key", "part"])
    assert 64 + 192 < 300 and by_part.count() <= 192 * len(prints) and by_part.where(F.col("n") > simhash.HOT).isEmpty()
    found = simhash.links(distinct).collect()
    near = {(a, b) for i, a in enumerate(prints) for b in prints[:i] + prints[i + 1 :] if (a ^ b).bit_count() <= 2}
    assert {(r.a % (1 << 64), r.b % (1 << 64)) for r in found} | {(r.b % (1 << 64), r.a % (1 << 64)) for r in found} == near and near


def test_simhash_shapes(spark):
    assert simhash.near_groups(docs_of(spark).limit(0)).collect() == [] and simhash.drop_near_copies(clashing(spark)).columns == clashing(spark).columns
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r.root for r in simhash.components(chain).collect()} == {0}


# near copies


def brute_bits(text, n):
    words = {w: xxhash.xxh64_intdigest(w, 42) for w in re.findall(r"[^\x20\x09-\x0D]+", lowered(text))}
    wide = [b"".join(int(near_copies._mixed(np.uint64((h + k * 0x9E3779B97F4A7C15) % (1 << 64)))).to_bytes(8, "little") for k in range(1, -(-n // 64) + 1)) for h in words.values()]
    return [2 * sum(x[i // 8] >> 7 - i % 8 & 1 for x in wide) > len(wide) for i in range(n)]


def test_wide_fingerprints():
    for text in ["", None, "a", "A a b", "one two three four Five É", " ".join(f"w{i}" for i in range(9000))]:
        with np.errstate(over="ignore"):
            assert near_copies.bits(text, 100).tolist() == brute_bits(text, 100)
    assert near_copies.shape(0) == near_copies.shape(1 << 20) == (24, 14) and near_copies.shape(10**11) == (41, 85)


def test_signatures_meet_once_for_a_segment(spark):
    """Nodes of which a segment differs in one bit at most, and no others, meet in one key of it, at least one of them as its owner; equal segments met in as many keys as they have bits before."""
    rnd, width = random.Random(5), 24
    bases = [rnd.getrandbits(width) for _ in range(4)]
    cut = {k: [rnd.choice(bases) ^ sum(1 << i for i in rnd.sample(range(width), rnd.choice([0, 0, 1, 1, 2]))) for _ in range(3)] for k in range(80)}
    rows = near_copies.signatures(spark.createDataFrame(list(cut.items()), "node bigint, segments array<bigint>"), width).collect()
    assert len(rows) == sum(1 + width * (v.bit_count() % 2) for x in cut.values() for v in x)
    keys = {}
    for r in rows:
        keys.setdefault(r.key, []).append((r.node, r.own))
    met = sorted((min(p, q), max(p, q), key >> 48) for key, members in keys.items() for p, own in members if own for q, also in members if not also or p < q)
    assert met == sorted((p, q, s) for p in cut for q in cut for s in range(3) if p < q and (cut[p][s] ^ cut[q][s]).bit_count() <= 1)
    roots = spark.createDataFrame([], "node bigint, root bigint")
    _, several = near_copies.proposed(spark.createDataFrame(list(cut.items()), "node bigint, segments array<bigint>"), width)
    n = {key: len(members) for key, members in keys.items()}
    crowded = {(p, q) for p, q, s in met for key in [s << 48 | v for v in (cut[p][s], cut[q][s])] if n[key] > 2 and {p, q} <= {m for m, _ in keys[key]}}
    for hot in (4096, 5):
        assert {tuple(r) for r in near_copies.across(several, roots, hot).collect()} == crowded


def test_a_group_of_near_copies_has_few_pairs(spark):
    """The pairs to verify are a few for each node, though the group shares most of each node's keys, and the groups are whole (before, 62 pairs a node)."""
    rnd, (width, segments), n = random.Random(3), near_copies.shape(0), 600
    flips = lambda k: sum(1 << i for i in range(k) if rnd.random() < 0.06)
    base = [rnd.getrandbits(width) for _ in range(segments)]
    rows = [((0x2A5C1234 ^ flips(30)) << 32 | k, [v ^ flips(width) for v in base]) for k in range(n)]
    distinct = spark.createDataFrame(rows, "node bigint, segments array<bigint>").withColumn("more", near_copies.further(width))
    pairs, several = near_copies.proposed(distinct, width)
    assert pairs.count() <= 12 * n
    roots = near_copies.components(near_copies.verified(pairs, distinct, width, segments))
    left = near_copies.verified(near_copies.across(several, roots, near_copies.HOT), distinct, width, segments)
    found = near_copies.components(left.unionByName(roots.select(F.col("root").alias("a"), F.col("node").alias("b")))).collect()
    graph = {node: node for node, _ in rows}

    def root(x):
        while graph[x] != x:
            x = graph[x]
        return x

    signed = [((node >> 32, *cut), node) for node, cut in rows]
    for k, (x, p) in enumerate(signed):
        for y, q in signed[:k]:
            apart = [(u ^ v).bit_count() for u, v in zip(x, y, strict=True)]
            if apart[0] <= 12 and min(apart[1:]) <= 1 and sum(apart[1:]) <= near_copies.FLIPPED * width * segments:
                graph[root(p)] = root(q)
    groups = {}
    for r in found:
        groups.setdefault(r.root, {r.root}).add(r.node)
    brute = {}
    for node in graph:
        brute.setdefault(root(node), set()).add(node)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in brute.values() if len(g) > 1)


@pytest.mark.parametrize("hot", [2, 32])
def test_near_copies(spark, hot):
    rnd = random.Random(9)
    vocabulary = [f"w{i}" for i in range(2000)]
    base = [[rnd.choice(vocabulary) for _ in range(150)] for _ in range(12)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)] + [(None, base[3][0] + " " + " ".join(base[3])), (40, None), (41, ""), (42, " \t"), (43, "x"), (43, "x"), (44, "y")]
    rows += [(100 + 20 * i + k, " ".join(rnd.choice(vocabulary) if rnd.random() < 0.03 else w for w in b)) for i, b in enumerate(base) for k in range(8)]
    found = near_copies.near_groups(docs_of(spark, rows), hot=hot).collect()
    assert all(r.component_id == (r.doc_id - 100) // 20 for r in found if r.doc_id is not None and r.doc_id >= 100)
    assert {r.doc_id: r.component_id for r in found if r.doc_id is None or r.doc_id < 100} == {i: i for i in range(12)} | {None: 3, 40: 40, 41: 40, 42: 40, 43: 43, 44: 44}
    kept = near_copies.drop_near_copies(docs_of(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == [*range(12), 40, 43, 43, 44]
    assert near_copies.drop_near_copies(clashing(spark)).columns == clashing(spark).columns and near_copies.near_groups(docs_of(spark).limit(0)).collect() == []


# suffix dedup


def brute_suffix(rows):
    first = {}
    for i, t in rows:
        data = (t or "").encode()
        for k in range(len(data) - 49 if i is not None else 0):
            first[data[k : k + 50]] = min(i, first.get(data[k : k + 50], i))
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 49 if i is not None else 0):
            if first[data[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((i, len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("hot", "memory"), [(100_000, 4 << 20), (2, 4 << 20), (100_000, 0)])
def test_suffix_dedup(spark, hot, memory, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "MEMORY", memory)
    rnd = random.Random(7)
    passages = ["".join(rnd.choice("abcdefgh é") for _ in range(rnd.randrange(20, 120))) for _ in range(20)]
    rows = [(i, t) for i, t in CASES if t != LONG] + [(50, "x" * 200), (51, "x" * 130), (52, "ab" * 90), (40, "ab" * 30)]
    for _ in range(60):
        rows.append((rnd.randrange(80) if rnd.random() < 0.95 else None, "".join(rnd.choice(passages) if rnd.random() < 0.6 else "".join(rnd.choice("abcd") for _ in range(60)) for _ in range(rnd.randrange(1, 7)))))
    rows += [(90, rows[-1][1]), (91, rows[-1][1]), (90, rows[-1][1])]
    found = suffix_dedup.remove_repeats(docs_of(spark, rows).repartition(3), digests=True)
    assert total(found.collect()) == total(brute_suffix(rows))


@pytest.mark.parametrize("memory", [0, 300, 1 << 20])
@pytest.mark.parametrize(("step", "least"), [(1, 1), (3, 4), (1 << 16, 1), (1 << 16, 13)])
def test_suffix_order(memory, step, least, monkeypatch, tmp_path):
    monkeypatch.setattr(suffix_dedup, "STEP", step)
    rnd = random.Random(8)
    for _ in range(40):
        strings = [bytes(rnd.choice(b"abc"[: rnd.choice([2, 3])]) for _ in range(rnd.randrange(0, 12))) for _ in range(rnd.randrange(1, 9))]
        data, offsets = np.frombuffer(b"".join(strings), np.uint8), np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)
        store = suffix_dedup.Store(f"file:{tmp_path}", memory)
        before, shared, start = (np.concatenate([np.zeros(0, np.int64), *tape.read()]) for tape in suffix_dedup.suffix_order(data, offsets, store, least))
        store.close()
        tails = {int(offsets[i]) + k: s[k:] for i, s in enumerate(strings) for k in range(len(s))}
        start, shared, before = start[len(strings) :], shared[len(strings) :], before[len(strings) :]
        ordered = sorted(tails.values())
        assert [p if p < len(data) else None for p in start.tolist()] == [p if len(tails[p]) >= least else None for p in sorted(tails, key=lambda p: (tails[p], start.tolist().index(p) if p in start else 0))]
        assert [len(os.path.commonprefix([a, b])) for a, b in zip(ordered, ordered[1:], strict=False)] == shared[1:].tolist()
        if least == 1:
            assert [255 if p in offsets else data[p - 1] for p in start.tolist()] == before.tolist()
        assert (store.written > 0) == (memory == 0) or memory == 300
    assert os.listdir(tmp_path) == []


def test_suffix_order_holds_blocks_only(tmp_path):
    """With external files the order of many strings takes no more memory than blocks and a few numbers for each string."""
    import tracemalloc

    rnd = np.random.default_rng(1)
    strings = rnd.integers(97, 100, (12_000, 81)).astype(np.uint8)
    strings[::3, 20:75] = strings[0, 20:75]
    data, offsets = strings.ravel(), np.arange(12_001) * 81
    least = rnd.permutation(12_000).astype(np.int64)
    peaks = []
    for memory in (1 << 30, 0):
        tracemalloc.start()
        windows, written = suffix_dedup.earlier_windows(data, offsets, least, str(tmp_path), memory)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert (written > 100 * len(data)) == (memory == 0)
        assert (windows[::3][least[::3] > least[::3].min()] & 0b111111 << 20 == 0b111111 << 20).all() and not windows[1::3].any()
    assert peaks[1] < 0.75 * peaks[0] and os.listdir(tmp_path) == []


def test_crowded_bits_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    monkeypatch.setattr(suffix_dedup, "CROWD_BITS", 8)
    rnd = random.Random(3)
    line = "a very common line that stands in all of the texts, again and again"
    rows = [(i, "".join(rnd.choice("abcdefgh") for _ in range(70)) + line + "".join(rnd.choice("abcdefgh") for _ in range(30))) for i in range(40)] + [(40 + i, line * 2) for i in range(4)]
    assert total(suffix_dedup.remove_repeats(docs_of(spark, rows), digests=True).collect()) == total(brute_suffix(rows))


def test_rows_that_repeat_are_cleaned_once(spark, monkeypatch):
    sizes = []
    kept = suffix_dedup._remove_repeats
    monkeypatch.setattr(suffix_dedup, "_remove_repeats", lambda docs, *a: sizes.append(docs.count()) or kept(docs, *a))
    line = "a passage of more than fifty bytes that several of the texts hold, in the middle"
    rows = [(k % 3, f"{'x' * (k % 3)} {line} {'y' * 60}") for k in range(3000)] + [(7, line), (7, line + "z"), (None, line), (None, line), (8, "short"), (8, "short")]
    df = docs_of(spark, rows).withColumn("k", F.monotonically_increasing_id()).withColumn("n_spans", F.lit("mine"))
    assert total(suffix_dedup.remove_repeats(df, digests=True).collect()) == total(brute_suffix(rows)) and sizes == [9]
    cleaned = suffix_dedup.remove_repeats(df, counts=False)
    assert cleaned.columns == df.columns and cleaned.select("k").distinct().count() == len(rows) and {r.n_spans for r in cleaned.select("n_spans").distinct().collect()} == {"mine"}
    counted = suffix_dedup.remove_repeats(df)
    assert total(counted.select("doc_id", "n_bytes", "n_removed", "n_spans").collect()) == total(r[:4] for r in brute_suffix(rows))


def test_tapes_of_lost_tasks_are_swept(spark):
    from codeloom.checkpoints import folder

    root = re.sub("^file:/+", "/", folder(spark))
    for name in ("suffix-order-old", "suffix-order-new", "other"):
        with open(f"{root}/{name}", "w") as file:
            file.write("x")
    os.utime(f"{root}/suffix-order-old", (1, 1))
    os.utime(f"{root}/other", (1, 1))
    assert suffix_dedup.sweep(spark) == 1 and not os.path.exists(f"{root}/suffix-order-old") and os.path.exists(f"{root}/suffix-order-new") and os.path.exists(f"{root}/other")
    with pytest.raises(Exception, match="nowhere"):
        suffix_dedup.Store("nowhere://x")


def test_suffix_shapes(spark):
    df = clashing(spark)
    cleaned = suffix_dedup.remove_repeats(df)
    assert cleaned.columns == [c for c in df.columns if c != "n_bytes"] + ["n_bytes", "n_removed", "n_spans"] and cleaned.count() == df.count()
    assert suffix_dedup.remove_repeats(df.limit(0)).collect() == []
    twice = docs_of(spark, [(1, "é" * 60 + "A"), (2, "b" + "é" * 60)])
    assert {r.doc_id: r.text for r in suffix_dedup.remove_repeats(twice).collect()} == {1: "é" * 60 + "A", 2: "b"}


# packing


def check_packing(spark, df, window=1024):
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(queries.BYTE_BPE)
    rows = packing.pack(df, queries.BYTE_BPE, window=window).collect()
    ids = {r.doc_id: np.array(theirs.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4") for r in df.collect()}
    pieces, sequences = {}, {}
    for r in rows:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes()) and r.length > 0
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for parts, limit in [(p, len(ids[i])) for i, p in pieces.items()] + [(p, None) for p in sequences.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == limit if limit is not None else at <= window and at & (at - 1) == 0
    return rows


def test_packing_cases(spark):
    unique = {i: t for i, t in CASES}
    rows = check_packing(spark, docs_of(spark, list(unique.items())))
    assert sum(r.length for r in rows if r.doc_id in (5, 6)) == 2
    assert packing.pack(docs_of(spark).limit(0), queries.BYTE_BPE).collect() == []
    assert packing.pack(docs_of(spark), queries.BYTE_BPE).where("doc_id = 2").count() >= 2


def test_packing_leaves_other_columns_out(spark):
    rows = packing.pack(clashing(spark).selectExpr("*", "1 AS start", "2 AS length", "3 AS place", "4 AS near", "5 AS next", "6 AS offset"), queries.BYTE_BPE).collect()
    plain = packing.pack(clashing(spark).select("doc_id", "text"), queries.BYTE_BPE).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.start, r.length, r.ids_crc32) for r in rows) == sorted((r.doc_id is None, r.doc_id, r.start, r.length, r.ids_crc32) for r in plain)


@HERE
def test_packing_table(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 50)
    monkeypatch.setattr(packing, "SHARD", 60)
    check_packing(spark, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), 256)


def test_packing_puts_likes_together(spark):
    """Neighbours are those that share words: of two topics in equal parts, windows are far purer than by chance."""
    rnd = random.Random(9)
    topics = [["apple", "pear", "plum", "cherry", "grape"], ["iron", "zinc", "copper", "silver", "gold"]]
    df = docs_of(spark, [(i, " ".join(rnd.choice(topics[i % 2]) for _ in range(60))) for i in range(200)])
    shares = {}
    for r in packing.pack(df, queries.BYTE_BPE).collect():
        shares.setdefault(r.sequence_id, Counter())[r.doc_id % 2] += r.length
    whole = [c for c in shares.values() if sum(c.values()) == 1024]
    assert np.mean([max(c.values()) / 1024 for c in whole]) > 0.85


def test_packing_brings_rare_words_together(spark, monkeypatch):
    """All tails share common words; those of one rare word meet in a block that is far smaller than the table."""
    monkeypatch.setattr(packing, "BLOCK", 40)
    common = "the of and to in was is that for on with as his they be at one have this from or had by hot but some what there we can out other were all your when up use word how said an each she".split()
    rare = "giraffe volcano penguin saxophone marble lantern cathedral octopus hammer tractor violin pepper anchor tunnel castle dragon turtle rocket mirror carpet pillow button bottle candle basket ladder helmet blanket spider tiger rabbit monkey camel whale eagle falcon parrot lizard salmon cherry".split()
    df = docs_of(spark, [(i, "a " + " ".join(common) + f" {rare[i % 40]}" * 5) for i in range(320)])
    shares = {}
    for r in packing.pack(df, queries.BYTE_BPE, window=256).collect():
        shares.setdefault(r.sequence_id, Counter())[r.doc_id % 40] += r.length
    assert np.mean([max(c.values()) / 256 for c in shares.values() if sum(c.values()) == 256]) > 0.7


def test_a_shard_is_one_block():
    assert packing.BLOCK > packing.SHARD


def test_an_index_without_some_units():
    rnd = np.random.default_rng(3)
    units = [rnd.integers(0, 40, rnd.integers(1, 30)) for _ in range(50)]
    idf, free = rnd.random(40) + 0.1, rnd.random(50) < 0.4
    whole, less = packing.Index(units, idf, 12.0), packing.Index(units, idf, 12.0)
    less.drop(free)
    fresh = packing.Index([u for u, own in zip(units, free, strict=True) if own], idf, 12.0)
    terms = np.array([3, 7, 20])
    assert np.allclose(less.scores(terms), whole.scores(terms)[free]) and np.allclose(less.scores(terms), fresh.scores(terms))
    assert less.n == fresh.n and all((less.query(k) == fresh.query(k)).all() for k in range(less.n))


def test_bm25_scores():
    units = [np.array(x) for x in ([1, 1, 2], [2, 3], [4], [1])]
    idf = np.array([0.0, 0.5, 1.0, 2.0, 3.0])
    index = packing.Index(units, idf, 2.0)
    score = index.scores(np.array([1, 2]))
    want = [sum(idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(u) / 2.0)) for t in (1, 2) if (tf := int((u == t).sum()))) for u in units]
    assert np.allclose(score, want) and sorted(index.query(0).tolist()) == [1, 2]


# media


def test_media(spark):
    rows = media.media_columns(docs_of(spark), keep_media=True).collect()
    assert len(rows) == len(CASES)
    texts = {i: (t or "").encode() for i, t in CASES}
    for r in rows:
        if r.doc_id is None:
            continue
        data = texts[r.doc_id]
        want = data + bytes((-len(data) % 64) if data else 64)
        with wave.open(io.BytesIO(bytes(r.media))) as file:
            assert file.readframes(file.getnframes()) == want and file.getsampwidth() == 1
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(want), hashlib.sha256(want).hexdigest())
        assert r.tail_crc32 == zlib.crc32(want[-64:]) and r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()
        assert len(r.pair_times) == len(r.pair_codes) and r.pair_times == sorted(r.pair_times)
    assert len({(r.payload_sha256, r.feature, tuple(r.pair_codes)) for r in rows}) == len({r.payload_sha256 for r in rows})
    assert media.media_columns(clashing(spark)).count() == len(CASES) - 1


def brute_feature(payload):
    """Peaks and pairs frame by frame and bin by bin."""
    if not any(payload):
        return [], []
    samples = np.frombuffer(payload, np.uint8).astype(np.float32) - np.float32(128)
    frames = max(0, -(-(len(samples) - media.FRAME) // media.HOP)) + 1
    samples = np.append(samples, np.zeros(frames * media.HOP + media.FRAME, np.float32))
    power = [np.abs(np.fft.rfft(samples[k * media.HOP : k * media.HOP + media.FRAME] * media._WINDOW))[1:].astype(np.float32).tolist() for k in range(frames)]
    found, width = [], len(power[0]) // media.BANDS
    for t, now in enumerate(power):
        for band in range(media.BANDS):
            best = max(range(band * width, (band + 1) * width), key=lambda b: (now[b], -b))
            if now[best] > 0 and (t == 0 or now[best] >= power[t - 1][best]) and (t + 1 == frames or now[best] >= power[t + 1][best]):
                found.append((t, best))
    out = sorted((t, b << 13 | c << 6 | u - t) for i, (t, b) in enumerate(found) for u, c in found[i + 1 : i + 1 + media.FAN] if u - t <= media.REACH)
    return [t for t, _ in out], [c for _, c in out]


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_features_against_brute_force(block, monkeypatch):
    monkeypatch.setattr(media, "BLOCK", block)
    rnd = random.Random(12)
    samples = [b"", b"a", bytes(64), bytes(1000), b"ab" * 700, "Ein Satz über Töne. ".encode() * 90, b"x" * 255, b"x" * 256, b"x" * 257, b"x" * 384, b"x" * 385]
    samples += [bytes(rnd.randrange(256) for _ in range(rnd.randrange(1, 6000))) for _ in range(25)] + [(" ".join(rnd.choice(["the", "and", "of", "zu"]) for _ in range(rnd.randrange(400)))).encode() for _ in range(25)]
    for data in samples:
        stored, back, at, codes = media.describe(data)
        assert back == media.payload(data) and (at.tolist(), codes.tolist()) == brute_feature(back)


def test_media_shapes(spark):
    found = media.media_columns(clashing(spark).selectExpr("*", "1 AS feature", "2 AS media"))
    assert found.count() == len(CASES) - 1 and found.columns[0] == "doc_id" and found.columns[-2:] == ["pair_times", "pair_codes"]
    assert media.media_columns(docs_of(spark).limit(0)).collect() == []
    kept = {r.doc_id: r for r in media.media_columns(docs_of(spark, [(1, "a" * 500), (1, "a" * 500), (None, None)]), keep_media=True).collect()}
    assert media.from_wav(kept[1].media) == media.payload(b"a" * 500) and kept[None].n_bytes == 0 and kept[None].payload_bytes == 64


def test_peaks_find_a_tone(monkeypatch):
    t = np.arange(128 * 40)
    tone = (128 + 100 * np.sin(2 * np.pi * t * 20 / media.FRAME)).astype(np.uint8)
    times, bins = media.peaks(tone)
    assert Counter(bins.tolist()).most_common(1)[0][0] == 19  # bin 20; the constant part is left out
    monkeypatch.setattr(media, "BLOCK", 7)
    again = media.peaks(tone)
    assert (times == again[0]).all() and (bins == again[1]).all()


# language identification


@HERE
def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.predict(docs, langid.train(docs)).withColumn("out", langid.held_out(F.col("doc_id")))
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found.select("doc_id", "out").collect())
    right = found.where("out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("x"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    assert right.x > 0.97 and 0 <= right.low <= right.high <= 1


@HERE
def test_language_cases(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    found = {r.doc_id: r for r in langid.predict(docs_of(spark), model).collect()}
    assert [found[i].lang_pred for i in (5, 6, 13, 14)] == ["und"] * 4 and found[14].score == 0 and found[11].lang_pred in model.langs
    blind = docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang"))
    assert {r.lang_pred for r in langid.predict(docs_of(spark), langid.train(blind)).collect()} == {"und"}
    one = langid.train(docs.where("lang = 'en'"))
    assert {r.lang_pred for r in langid.predict(docs_of(spark), one).collect()} == {"und", "en"}
    assert langid.predict(clashing(spark), model).count() == len(CASES) - 1 and langid.predict(docs_of(spark).limit(0), model).collect() == []


def test_language_sample_is_bounded(spark):
    words = {"en": "the and of that", "de": "der und das nicht", "fr": "le et la que"}
    one_id = [(i, f"{words[x]} {x}{k}", x) for x, i in (("en", 27), ("de", 0)) for k in range(3000)]
    same = [(5, "le et la que", "fr")] * 3000 + [(1000 + k, f"que la et {k} le", "fr") for k in range(30)]
    docs = spark.createDataFrame(one_id + same, "doc_id long, text string, lang string")
    chosen, each = langid.sampled(docs, "doc_id", "text", "lang", langid.SAMPLE)
    counts = {r.l: r.n for r in chosen.groupBy("l").agg(F.count("*").alias("n")).collect()}
    assert each == langid.SAMPLE and all(each <= counts[x] <= 2 * each for x in ("en", "de")) and 15 <= counts["fr"] <= 31
    model = langid.train(docs)
    assert model.langs == ["de", "en", "fr"] and {r.doc_id: r.lang_pred for r in langid.predict(docs_of(spark, [(1, "the and of"), (2, "das und der"), (3, "la que le")]), model).collect()} == {1: "en", 2: "de", 3: "fr"}


def test_any_number_of_labels(spark, monkeypatch):
    monkeypatch.setattr(langid, "ALL_ROWS", 90)
    rows = [(k, f"w{k % 700} x", f"l{k % 700}") for k in range(1400)] + [(5000 + k, "the and of that", "en") for k in range(60)] + [(6000 + k, "der und das nicht", "de") for k in range(50)] + [(7000, "x", ""), (7001, "y", "z" * 5000)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) <= langid.MOST_LANGUAGES and {"en", "de"} <= set(model.langs) and model.weights.shape[1] <= langid.MOST_LANGUAGES**2


def test_margins_are_those_of_histograms(monkeypatch):
    rnd = random.Random(10)
    texts = ["".join(rnd.choice("abcdeé ,") for _ in range(rnd.randrange(0, 300))).encode() for _ in range(40)] + [b"", "é".encode() * 500]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    model = langid.Model(["a"], ["x"], [], np.random.default_rng(0).normal(size=(langid.BINS, 3)).astype(np.float32), np.zeros(3))
    want = langid.histograms(data, offsets) @ model.weights
    for size in (16, 100, 1 << 20):
        monkeypatch.setattr(langid, "SLICE", size)
        assert np.allclose(model.margins(data, offsets), want, atol=1e-5)


# HTML extraction

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies.</p></div>
<article><h1>A &amp; B</h1><p>First&nbsp;line<br>goes <b>o<i>n</b></i>.<p>Short.<div class="ad">Buy <a href=x>this</a> now</div><aside>Related</aside><form><p>Subscribe</p><input></form>
<ul><li>One</li><li>Two &lt;x&gt; &#x41;&#66;</li></ul><!-- hidden <p>x</p> --><noscript>No</noscript><p style="display: none">Hidden stays? <p>Last  one</article>
<section id="comments"><p>Nice article indeed, thanks a lot for writing it.</p></section><footer>&copy; 2020</footer></body></html>"""


def test_main_text():
    assert html_extract.main_text(PAGE).split("\n") == ["A & B", "First line goes on.", "Short.", "One", "Two <x> AB", "Last one"]


REPORT = "The council met on Monday and agreed on a plan for the old harbour, which is to open again in spring."
TWICE = f"<p>{REPORT}</p><p>{REPORT}</p>"


@pytest.mark.parametrize(
    "extra",
    [
        '<p class="advertisement">Buy now, only today, at the lowest price</p>', "<p hidden>Not to be seen</p>", '<p style="color:red; display : none">Not to be seen</p>', '<h2 aria-hidden="true">Not to be seen</h2>', '<span class="ad">Buy now</span>',
        '<a class="share" href="x">Share this</a>', '<div><span hidden>a <span>b</span> c</span></div>', '<div class="responses"><p>Great story, thanks for it, I have read it twice.</p></div>', '<div class="comment-list"><p>Great story, thanks for it.</p></div>',
        '<ul><li><a href="a">Harbour opens</a></li><li><a href="b">Council meets</a></li><li><a href="c">Spring comes</a></li></ul>', '<figure class="ad-slot-top"><figcaption>Buy</figcaption></figure>', '<table class="adBox"><tr><td>Buy now</td></tr></table>',
        "<aside>Related</aside>", "<form><p>Your mail</p></form>", '<div role="search">Search here</div>', '<li class="share">Share</li>', '<section class="related-stories"><p>Another story that is not this one but long enough to be one.</p></section>',
    ],
)
@pytest.mark.parametrize("whole", ["<article>{}</article>", "<main>{}</main>", "<div class='post'>{}</div>"])
def test_what_is_not_the_article_goes(extra, whole):
    html = f"<html><body>{whole.format(TWICE + extra + f'<p>{REPORT}</p>')}</body></html>"
    assert html_extract.main_text(html) == "\n".join([REPORT] * 3)


@pytest.mark.parametrize(
    "html",
    [
        f'<div class="trending-topic-story">{TWICE}</div>', f'<div class="layout with-sidebar">{TWICE}</div>', f'<div id="page-has-nav"><article>{TWICE}</article></div>', f'<article>{TWICE}</article><article class="comment"><p>{REPORT} So it is, and I like it.</p></article>',
        f'<article>{TWICE}</article><article class="comment-item"><p>Me, too.</p></article>', f'<div class="widget">{"<p>teaser</p>"}<article><p>Other</p></article></div><div>{TWICE}</div>', f"<article>{TWICE}<p>Source: <a href=x>report</a></p></article>".replace("<p>Source: <a href=x>report</a></p>", ""),
        f'<nav><a href="/">Home</a><a href="/b">News</a></nav><div id="content">{TWICE}</div><div class="site-footer">All rights reserved.</div>',
    ],
)
def test_the_article_stays(html):
    assert html_extract.main_text(html) == f"{REPORT}\n{REPORT}"


def test_headings_of_an_article_stay():
    assert html_extract.main_text(f'<div class="site-header">Daily</div><div class="post"><div class="entry-header"><h1>Harbour to open</h1></div>{TWICE}</div>') == f"Harbour to open\n{REPORT}\n{REPORT}"
    assert html_extract.main_text(f'<header>Daily</header><article><header><h1>Harbour</h1></header>{TWICE}<pre>x = 1 <span class="comment"># one</span></pre></article>') == f"Harbour\n{REPORT}\n{REPORT}\nx = 1 # one"


@HERE
def test_the_tree_by_itself_on_pages_it_was_not_made_from():
    """Without what markup declares: precision and recall over blocks, and what blocks are asked for."""
    import duckdb

    right = kept = wanted = asked = every = 0
    for (html,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' WHERE page_id NOT IN (SELECT page_id FROM '/root/testdata/sf0.001/pages.parquet')").fetchall():
        page = html_extract.blocks(html)
        for block, row in zip(page, html_extract.features(page).tolist(), strict=True):
            features, keep = html_extract.path(row, html_extract.tree())
            main = block.article and not block.closed
            right, kept, wanted, every = right + (keep and main), kept + keep, wanted + main, every + 1
            asked += any(f != "place" for f in features)
    assert every > 3000 and right > 0.98 * kept and right > 0.98 * wanted and asked > 0.5 * every
    shapes = [(w, d, wb, db, wa, da, place) for w in (1, 6, 40) for d in (0, 1) for wb in (0, 3, 50) for db in (0, 1) for wa in (0, 3, 50) for da in (0, 1) for place in (-1, 0, 1)]
    verdicts = {s: html_extract.path(list(map(float, s)), html_extract.tree())[1] for s in shapes}
    assert all(any(verdicts[s] != verdicts[(*s[:k], v, *s[k + 1 :])] for s in shapes for v in {x[k] for x in shapes}) for k in (0, 1, 4, 6))  # own and neighbours' counts change decisions


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("<p>", ""), ("plain text only, without any markup at all, stands as it is", "plain text only, without any markup at all, stands as it is"), ("<article><p>a < b &amp;amp; c > d</p>", "a < b &amp; c > d"),
        ("<article>x<script>never closed <p>y</p>", "x"), ("<article>x<!-- never closed <p>y</p>", "x"), ("<article><p>a</nav></div></span>b</article>", "a\nb"), ("<article><p>a</span>b</article>", "ab"), ("<article>" * 50 + "deep", "deep"),
        ("<main><p>One.</p><svg><text>pic</text></svg><select><option>o</option></select></main>", "One."), ('<article><p title="a > b">t</p><p title=\'<p>\'>u</p></article>', "t\nu"), ("<article>&nbsp; <p>\t</p></article>", ""),
        ("<body><div><p>" + "Many words make a paragraph of text here. " * 5 + "</p></div><ul><li><a href=a>link one</a></li><li><a href=b>link two</a></li></ul></body>", ("Many words make a paragraph of text here. " * 5).strip()),
    ],
)
def test_main_text_cases(html, text):
    assert html_extract.main_text(html) == text


def test_tree_fits_its_table():
    assert all(html_extract.path(row[:-1].tolist(), html_extract.tree())[1] == bool(row[-1]) for row in html_extract.LABELLED)


def test_extract_columns(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "keep"), (2, None, None, "x"), (3, "v", "<article>" + "<p>w</p>" * 20_000 + "</article>", "y")], "page_id long, url string, html string, text string")
    rows = {r.page_id: r for r in html_extract.extract(pages).collect()}
    assert rows[2].text == "" and rows[2].n_chars == 0 and rows[3].n_chars == 39_999 and rows[1].n_chars == len(rows[1].text)
    assert html_extract.extract(pages.limit(0)).collect() == []


@HERE
@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLE_SQL and not n.startswith("op11_")])  # op11 has rows for components; test_statistics holds them
def test_queries_give_a_row_for_each_input(spark, name):
    rows = queries.QUERIES[name](spark, SF)
    key = "page_id" if name.startswith("op1_") else "doc_id"
    table = spark.read.parquet(f"{SF}/{'pages' if key == 'page_id' else 'documents'}.parquet")
    assert rows.select(key).distinct().count() == table.count() and (name.startswith("op3_") or rows.count() == table.count())


@HERE
def test_oracle(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        found = queries.QUERIES[name](spark, SF)
        assert total(found.collect()) == total(con.execute(f"SELECT {', '.join(found.columns)} FROM ({sql})").fetchall())


def test_vocabularies_are_where_they_should_be():
    assert all(os.path.exists(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


def test_ids_are_dealt_as_spark_deals_them(spark):
    ids = [0, 1, -1, 5, 1 << 40, -(1 << 62), (1 << 63) - 1]
    pairs = [(i, t) for i in ids for t in ids]
    rows = spark.createDataFrame(pairs, "i long, t long").select("i", "t", F.pmod(F.xxhash64("i", "t"), F.lit(13)).cast("int").alias("b")).collect()
    assert {(r.i, r.t): r.b for r in rows} == dict(zip(pairs, suffix_dedup._block(*np.array(pairs).T, 13).tolist(), strict=True))


def test_heads_of_articles_stay():
    page = '<div class="site-header"><p>Site of many words and no links</p></div><article><div class="entry-header"><h1>Title</h1></div><p>Text.</p><div id="shareBar">Share</div></article>'
    assert html_extract.main_text(page) == "Title\nText."


STORY = "<div id=content>" + "".join(f"<p>Paragraph {k} of the story says at some length what has happened and to whom, in plain words and without links.</p>" for k in range(4)) + "</div>"


@pytest.mark.parametrize("extra", ["<aside><article><p>A teaser of another story.</p></article></aside>", "<article><p>A teaser of another story.</p></article>", "<div class=related><article><p>Teaser.</p></article></div>"])
def test_a_teaser_in_an_article_element_leaves_the_story(extra):
    assert html_extract.main_text(STORY + extra).count("Paragraph") == 4 and html_extract.main_text(extra + STORY).count("Paragraph") == 4


def test_link_lists_in_articles_go():
    links = "<ul>" + "".join(f"<li><a href=x>Other story number {k}</a></li>" for k in range(5)) + "</ul>"
    found = html_extract.main_text("<article>" + STORY + links + "</article>")
    assert found.count("Paragraph") == 4 and "Other story" not in found


@pytest.mark.parametrize("wrapper", ['<div class="layout with-sidebar">', '<div id="page-has-nav">', '<div class="content no-ads">', '<div class="page modal">', '<div role="alert">'])
def test_marked_wrappers_leave_the_article(wrapper):
    assert html_extract.main_text(f"{wrapper}<article>{STORY}</article></div>").count("Paragraph") == 4


@pytest.mark.parametrize("opening", ['<section id="discussion">', '<section class="legal">'])
def test_sections_of_an_article_stay(opening):
    assert html_extract.main_text(f"<article><p>Before.</p>{opening}<p>The section.</p></section></article>") == "Before.\nThe section."


def test_classes_of_paragraphs_items_and_articles_count():
    page = '<article><p>One.<p class="ad">Buy.<p>Two.</p><p class="promo">Buy.</p>Loose.<ul><li>Three<li class="share">Share <p>it</p><li>Four</ul>Five.</article><article class="comment"><p>Nice.</p></article><aside><article><p>Teaser.</p></article></aside>'
    assert html_extract.main_text(page).split("\n") == ["One.", "Two.", "Loose.", "Three", "Four", "Five."]
    assert html_extract.main_text(f'<article>{STORY}</article><div class="comments"><article><p>Nice.</p></article></div>').count("Nice") == 0
