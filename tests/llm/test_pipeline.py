"""The pipeline's stages on planted cases."""

import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codeloom.llm import near_copies, simhash

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """The smallest table with copies, near copies, texts without letters, repeated rows and nulls planted."""
    own = spark.read.parquet(f"{SF}/documents.parquet")
    row = own.where("length(text) > 3000 AND lang = 'en'").orderBy("doc_id").first()
    planted = [
        (900_001, row.text, "en", "p", 1), (900_002, row.text.upper(), "en", "p", 1), (900_003, row.text[:1500] + " extra " + row.text[1500:], "en", "p", 1), (900_004, "12 34 !!", "en", "p", 1), (900_005, None, None, None, None),
        (900_006, "", "en", "p", 0), (900_007, "The and of that this is a line of its own " + row.text[100:260], "en", "p", 1), (900_007, "The and of that this is a line of its own " + row.text[100:260], "en", "p", 1),
    ]
    path = str(tmp_path_factory.mktemp("p") / "documents.parquet")
    own.unionByName(spark.createDataFrame(planted, own.schema)).write.parquet(path)
    return os.path.dirname(path), row


def staged(spark, docs, upto):
    df = spark.read.parquet(f"{docs[0]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, docs[0])
        if name == upto:
            return df
    raise AssertionError(upto)


def test_languages_keep_clean_documents(spark, docs):
    kept = {r.doc_id for r in staged(spark, docs, "language_id").select("doc_id").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").where(F.col("text").rlike("[a-z]{3}")).collect()}
    assert not kept & {900_004, 900_005, 900_006} and {900_001, 900_002, 900_003, 900_007} <= kept and len(clean - kept) <= len(clean) // 100


def test_copies_go(spark, docs):
    rows = staged(spark, docs, "exact_dedup").collect()
    ids = [r.doc_id for r in rows]
    assert docs[1].doc_id not in ids and 900_001 not in ids and ids.count(900_002) == 1 and ids.count(900_007) == 1


def test_near_copies_go(spark, docs):
    before, after = staged(spark, docs, "exact_dedup"), staged(spark, docs, "simhash_dedup")
    assert after.columns == before.columns and after.join(before, "doc_id", "left_anti").isEmpty() and after.count() <= before.count()


def test_planted_near_copy_goes(spark, docs):
    after = {r.doc_id for r in staged(spark, docs, "simhash_dedup").select("doc_id").collect()}
    assert not {900_002, 900_003} <= after


@pytest.fixture(scope="module")
def texts_of_sets():
    """The word sets of a larger table, each with its least id, and the pairs of them by similarity."""
    rows = duckdb.sql("SELECT doc_id, coalesce(text, '') FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY doc_id").fetchall()
    own = {}
    for i, t in rows:
        own.setdefault(frozenset(re.findall(r"[^\x20\x09-\x0D]+", t.translate(simhash._LOWER))), (i, t))
    items = [(i, s, t) for s, (i, t) in own.items()]
    return items, [(a, b, len(x & y) / max(1, len(x | y))) for k, (a, x, _) in enumerate(items) for b, y, _ in items[:k] if 0.6 * max(len(x), len(y)) <= min(len(x), len(y))]


@pytest.fixture(scope="module")
def groups(spark):
    return {r.doc_id: r.component_id for r in near_copies.near_groups(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}


def test_near_copies_against_brute_force(texts_of_sets, groups):
    _, pairs = texts_of_sets
    alike = [(a, b) for a, b, j in pairs if j >= 0.8]
    assert len(alike) > 50 and sum(groups[a] == groups[b] for a, b in alike) >= 0.9 * len(alike)
    graph = {i: i for i in groups}  # fingerprints estimate a similarity: what is linked has 0.7 at least

    def root(i):
        while graph[i] != i:
            i = graph[i]
        return i

    for a, b, j in pairs:
        if j >= 0.7:
            graph[root(a)] = root(b)
    merged = [(a, b) for a, b, _ in pairs if groups[a] == groups[b]]
    assert merged and all(root(a) == root(b) for a, b in merged)


def test_near_copies_by_shingles_are_caught(texts_of_sets, groups):
    cut = [(i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}) for i, _, t in texts_of_sets[0] if (w := re.findall(r"[^\x20\x09-\x0D]+", t.translate(simhash._LOWER)))]
    pairs = [(a, b) for k, (a, x) in enumerate(cut) for b, y in cut[:k] if 0.8 * max(len(x), len(y)) <= min(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y)]
    assert len(pairs) >= 5 and sum(groups[a] == groups[b] for a, b in pairs) >= 0.9 * len(pairs)


def test_passages_go(spark, docs):
    after = {r.doc_id: r for r in staged(spark, docs, "suffix_dedup").collect()}
    if 900_007 in after:
        assert docs[1].text[150:210] not in after[900_007].text and after[900_007].n_chars == len(after[900_007].text)


def test_columns_of_any_name_pass(spark):
    """Names that operators use, with values that must come back, through all stages that return documents."""
    own = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    names = ["score", "lang_pred", "n_bytes", "n_removed", "n_spans", "kept", "keep_id", "node", "segments", "fp", "key", "hash", "block", "rest", "size", "count", "component_id", "odd name", "a.b"]
    df = own.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id")).alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, df, "")
        assert after.columns == df.columns
        rows = after.collect()
        assert rows and all(r[n] == f"{n}:{r.doc_id}" for r in rows for n in names)
        df = spark.createDataFrame(rows, df.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, df, "").count() >= len(rows)


def test_run(spark, docs):
    rows = corpus_pipeline.run(spark, docs[0]).collect()
    assert rows and max(r.offset + r.length for r in rows) <= 1024
    tokens = {}
    for r in rows:
        tokens.setdefault(r.doc_id, [r.doc_tokens, 0])[1] += r.length
    assert all(n == found for n, found in tokens.values())


def test_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
