"""Queries over the driver's tables, one for each operator that they can exercise, with the same in DuckDB SQL."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import checkpoints
from codeloom import functions as fn
from codeloom.operators import answers, cost, extract, graph, imports, index, render, semantic, store, tournament, vector
from codeloom.plans.services import CountingService
from codeloom.schema import VECTOR_SIZE
from codeloom.sources import files as sources
from codeloom.sources import repository
from codeloom.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query_vector(rows: DataFrame) -> list[float]:
    return list(rows.orderBy("vec_id").select("embedding").first().embedding)


def _two_columns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[float]]:
    rows = table(spark, sf_dir, "embeddings")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(after, "vec_id").select(F.col("vec_id").alias("id"), "embedding", "other"), _query_vector(rows)


_Q = "(SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1)"
_TWO = "WITH s AS (SELECT a.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], q) AS d, list_cosine_similarity(b.embedding::DOUBLE[], q) AS s FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1, " + _Q + ")"


@query(f"SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], q), 6) AS distance FROM embeddings, {_Q} ORDER BY list_cosine_similarity(embedding::DOUBLE[], q) DESC, vec_id LIMIT 10")
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vector.knn(rows, _query_vector(rows), "embedding", key="vec_id").select("vec_id", F.round("_distance", 6).alias("distance"))


@query(
    "WITH s AS (SELECT q.vec_id AS query, r.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 9) AS s FROM embeddings q, embeddings r WHERE q.vec_id % 20 = 0)"
    " SELECT query, vec_id, round(s, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) <= 10"
)
def knn_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 20 against all rows."""
    rows = table(spark, sf_dir, "embeddings")
    return vector.knn_many(rows, rows.where("vec_id % 20 = 0"), "embedding", key="vec_id").select("query", "vec_id", F.round("similarity", 6).alias("similarity"))


@query(_TWO + " SELECT id, round(greatest(d, s), 6) AS similarity, CASE WHEN s > d THEN 'signature' ELSE 'description' END AS match_field FROM s ORDER BY greatest(d, s) DESC, id LIMIT 10")
def search_two_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, q = _two_columns(spark, sf_dir)
    return vector.search_vectors(rows, q, "embedding", "other").select("id", F.round("similarity", 6).alias("similarity"), "match_field")


@query(_TWO + " SELECT * FROM (SELECT id, round(greatest(d, s), 6) AS similarity, CASE WHEN s > d THEN 'signature' ELSE 'description' END AS match_field FROM s ORDER BY greatest(d, s) DESC, id LIMIT 10) WHERE similarity >= 0.3")
def search_min_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, q = _two_columns(spark, sf_dir)
    return vector.at_least(vector.search_vectors(rows, q, "embedding", "other").select("id", F.round("similarity", 6).alias("similarity"), "match_field"), 0.3)


@query("SELECT doc_id, lang, source FROM documents WHERE source = 'src3'")
def get_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.get_by_file(table(spark, sf_dir, "documents").withColumn("file_path", F.col("source")), "src3").select("doc_id", "lang", "source")


@query("SELECT page_id AS id, url FROM pages WHERE page_id = 7 LIMIT 1")
def get_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.get_by_id(table(spark, sf_dir, "pages").withColumn("id", F.col("page_id")), 7).select("id", "url")


@query("SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages WHERE starts_with(regexp_replace(url, '^https?://', ''), 'blog.')")
def get_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"))
    return rows.where(F.col("path").startswith("blog."))


@query("SELECT o_orderkey, 'o/' || o_orderpriority || '/' || o_orderstatus AS file_path FROM orders WHERE o_orderpriority = '1-URGENT'")
def get_by_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("/", F.lit("o"), "o_orderpriority", "o_orderstatus").alias("file_path"))
    return store.get_by_directory(rows, "o/1-URGENT")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS source_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", fn.content_hash(F.coalesce("text", F.lit(""))).alias("source_hash"))


@query(
    "WITH f AS (SELECT doc_id, sha256(text) AS source_hash FROM documents), s AS (SELECT d.doc_id, sha256(CASE WHEN d.doc_id % 3 = 0 THEN d.text || ' as it was' ELSE d.text END) AS source_hash FROM documents d JOIN labels l USING (doc_id))"
    " SELECT f.doc_id, f.source_hash FROM f LEFT JOIN (SELECT DISTINCT * FROM s) s USING (doc_id) WHERE s.source_hash IS DISTINCT FROM f.source_hash"
)
def incremental_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents are stored, a third of them with an older text: changed and new ones are left."""
    docs, own = table(spark, sf_dir, "documents"), F.col("text")
    files = docs.select(F.col("doc_id").alias("file_path"), fn.content_hash(own).alias("source_hash"))
    older = F.when(F.col("doc_id") % 3 == 0, F.concat(own, F.lit(" as it was"))).otherwise(own)
    stored = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("file_path"), fn.content_hash(older).alias("source_hash"))
    return store.changed_files(files, stored).select(F.col("file_path").alias("doc_id"), "source_hash")


@query(
    "WITH n AS (SELECT o_orderkey, 'X' AS o_orderstatus, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_orderkey + 100000000, 'N', o_totalprice FROM orders WHERE o_totalprice > 400000)"
    " SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM n UNION ALL SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.o_orderkey = o.o_orderkey)"
)
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    own = orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    raised = orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"))
    added = orders.where("o_totalprice > 400000").select((F.col("o_orderkey") + 100000000).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), "o_totalprice")
    return store.upsert(own, raised.unionByName(added), "o_orderkey").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("SELECT doc_id, source, lang FROM documents WHERE source NOT IN ('src1', 'src2') UNION ALL SELECT doc_id + 1000000000, source, 'xx' FROM documents WHERE source IN ('src1', 'src2') AND lang = 'en'")
def replace_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    new = docs.where(F.col("source").isin("src1", "src2") & (F.col("lang") == "en")).select((F.col("doc_id") + 1000000000).alias("doc_id"), "source", F.lit("xx").alias("lang"))
    return store.replace_by(docs, new, "source").select("doc_id", "source", "lang")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def delete_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"))
    return store.delete_by(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), gone, "c_nationkey").select("c_custkey", "c_nationkey")


@query(
    "WITH s AS (SELECT o_orderkey AS id, o_custkey AS file_path, 3 AS n FROM orders WHERE o_orderstatus = 'F')"
    " SELECT o.o_orderkey AS id, o.o_custkey AS file_path, CASE WHEN o.o_custkey IN (SELECT file_path FROM s) THEN coalesce(s.n, 0) + 1 ELSE 0 END::BIGINT AS mutation_count FROM orders o LEFT JOIN s ON s.id = o.o_orderkey"
)
def mutation_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    new = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("file_path"))
    stored = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("file_path"), F.lit(3).cast("bigint").alias("mutation_count"))
    return store.inherit_mutations(new, stored).select("id", "file_path", "mutation_count")


@query(
    "WITH s AS (SELECT n_nationkey AS file_path, 'N.' || n_name AS name, CASE WHEN n_regionkey % 2 = 0 THEN 'R' || n_regionkey END AS parent FROM nation),"
    " d AS (SELECT c_nationkey AS file_path, n_name AS bare, CASE WHEN n_regionkey % 2 = 0 THEN 'R' || n_regionkey END AS parent, arg_max(c_name, c_custkey) AS found FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' GROUP BY ALL)"
    " SELECT s.file_path, s.name, s.parent, d.found AS description FROM s LEFT JOIN d ON s.file_path = d.file_path AND split_part(s.name, '.', -1) = d.bare AND s.parent IS NOT DISTINCT FROM d.parent"
)
def describe_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    parent = F.when(F.col("n_regionkey") % 2 == 0, F.concat(F.lit("R"), F.col("n_regionkey").cast("string")))
    symbols = nation.select(F.col("n_nationkey").alias("file_path"), F.concat(F.lit("N."), "n_name").alias("name"), parent.alias("parent"))
    told = customer.where("c_mktsegment = 'BUILDING'").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    item = F.struct(F.col("c_custkey").alias("k"), F.col("n_name").alias("name"), F.lit("").alias("kind"), parent.alias("parent"), F.col("c_name").alias("description"))
    described = told.groupBy(F.col("c_nationkey").alias("file_path")).agg(F.struct(F.sort_array(F.collect_list(item)).alias("symbols")).alias("description"))
    return semantic.match_descriptions(symbols, described).select("file_path", "name", "parent", "description")


_MODULES = "WITH m AS (SELECT DISTINCT 'f' || (p_partkey % 50) AS file_path, replace(lower(p_type), ' ', '.') AS module FROM part)"


_STEMS = "replace(lower(regexp_replace(p_type, ' [^ ]+$', '')), ' ', '/')"


@query(
    _MODULES + f", f AS (SELECT DISTINCT CASE WHEN p_partkey % 4 = 0 THEN 'deep/' WHEN p_partkey % 4 = 1 THEN 'src/' ELSE '' END || {_STEMS} || CASE WHEN p_size % 2 = 0 THEN '.py' ELSE '/__init__.py' END AS path FROM part WHERE p_size < 25),"
    " g AS (SELECT path FROM f UNION SELECT 'deep/economy/__init__.py' UNION SELECT 'deep/small/__init__.py'),"
    " r(name, prefix) AS (VALUES ('economy', 'deep/'), ('small', 'deep/')),"
    " c AS (SELECT file_path, module, n, i.k AS k, CASE i.k WHEN 0 THEN b || '.py' WHEN 1 THEN b || '/__init__.py' WHEN 2 THEN 'src/' || b || '.py' WHEN 3 THEN 'src/' || b || '/__init__.py' WHEN 4 THEN prefix || b || '.py' ELSE prefix || b || '/__init__.py' END AS path"
    " FROM (SELECT file_path, module, r.prefix, u.n AS n, array_to_string(list_slice(string_split(module, '.'), 1, u.n), '/') AS b FROM m LEFT JOIN r ON split_part(module, '.', 1) = r.name, unnest(range(1, len(string_split(module, '.')) + 1)) AS u(n)), range(6) AS i(k))"
    " SELECT file_path, module, arg_min(path, -n * 10 + k) AS target FROM c JOIN g USING (path) GROUP BY ALL"
)
def candidate_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six candidates: modules and packages at the root, in src/ and below the roots that ``package_roots`` finds."""
    part = table(spark, sf_dir, "part")
    modules = part.select(F.concat(F.lit("f"), (F.col("p_partkey") % 50).cast("string")).alias("file_path"), F.replace(F.lower("p_type"), F.lit(" "), F.lit(".")).alias("module")).distinct()
    stem = F.replace(F.lower(F.regexp_replace("p_type", " [^ ]+$", "")), F.lit(" "), F.lit("/"))
    kind = F.col("p_partkey") % 4
    before = F.when(kind == 0, "deep/").when(kind == 1, "src/").otherwise("")
    found = part.where("p_size < 25").select(F.concat(before, stem, F.when(F.col("p_size") % 2 == 0, F.lit(".py")).otherwise(F.lit("/__init__.py"))).alias("path"))
    paths = found.unionByName(spark.createDataFrame([("deep/economy/__init__.py",), ("deep/small/__init__.py",)], "path string")).distinct()
    roots = extract.package_roots(spark.createDataFrame([("deep/economy/__init__.py",), ("deep/small/__init__.py",)], "path string"))
    return extract.resolve_imports(modules, paths, roots)


@query(
    "WITH d AS (SELECT DISTINCT 'r' || (p_size % 7) || CASE WHEN p_partkey % 3 = 0 THEN '/' ELSE '/x/' END || lower(split_part(p_type, ' ', 1)) || CASE WHEN p_partkey % 5 = 0 THEN '/sub' ELSE '' END AS dir FROM part),"
    " t AS (SELECT dir, regexp_replace(dir, '(^|/)[^/]*$', '') AS up FROM d),"
    " n AS (SELECT split_part(dir, '/', -1) AS name, CASE WHEN up = '' THEN '' ELSE up || '/' END AS prefix FROM t WHERE up NOT IN (SELECT dir FROM d))"
    " SELECT name, arg_min(prefix, (length(prefix), prefix)) AS prefix FROM n WHERE prefix NOT IN ('', 'src/') AND name NOT IN ('src', 'lib', 'pkg') GROUP BY name"
)
def package_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = F.concat(F.lit("r"), (F.col("p_size") % 7).cast("string"), F.when(F.col("p_partkey") % 3 == 0, F.lit("/")).otherwise(F.lit("/x/")), F.lower(F.substring_index("p_type", " ", 1)), F.when(F.col("p_partkey") % 5 == 0, F.lit("/sub")).otherwise(F.lit("")))
    return extract.package_roots(table(spark, sf_dir, "part").select(F.concat(stem, F.lit("/__init__.py")).alias("path")).distinct())


_RATES = "(VALUES ('gpt-5.4-mini', 0.75, 4.5, 0.075, 0.0), ('gpt-4.1', 2.0, 8.0, 0.0, 0.0), ('text-embedding-3-small', 0.02, 0.0, 0.0, 0.0)) r(model, i, o, cr, cw)"


@query(
    f"WITH c AS (SELECT CASE role WHEN 'user' THEN 'gpt-5.4-mini' WHEN 'assistant' THEN 'gpt-4.1' ELSE 'other' END AS model, length(text) AS it, turn * 10 AS ot, turn * 5 AS cr, turn % 4 AS cc, CASE WHEN role = 'user' THEN turn * 3 ELSE 0 END AS et FROM conversations),"
    f" p AS (SELECT c.*, (greatest(it - c.cr, 0) * coalesce(i, 0) + ot * coalesce(o, 0) + c.cr * coalesce(r.cr, 0) + cc * coalesce(cw, 0) + et * coalesce(i, 0)) / 1e6 AS dollars FROM c LEFT JOIN {_RATES} USING (model))"
    " SELECT model, count(*) AS calls, sum(it)::BIGINT AS input_tokens, sum(ot)::BIGINT AS output_tokens, sum(cr)::BIGINT AS cache_read, sum(cc)::BIGINT AS cache_creation, sum(et)::BIGINT AS embedding_tokens, round(sum(dollars)::DOUBLE, 6) AS dollars,"
    " round(CASE WHEN sum(it) + sum(cc) > 0 THEN sum(cr) / (sum(it) + sum(cc)) ELSE 0 END, 6) AS cache_hit_rate FROM p GROUP BY ROLLUP (model)"
)
def cost_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.when(F.col("role") == "user", "gpt-5.4-mini").when(F.col("role") == "assistant", "gpt-4.1").otherwise("other")
    calls = table(spark, sf_dir, "conversations").select(
        model.alias("model"), F.length("text").cast("bigint").alias("input_tokens"), (F.col("turn") * 10).alias("output_tokens"), (F.col("turn") * 5).alias("cache_read"), (F.col("turn") % 4).cast("bigint").alias("cache_creation"), F.when(F.col("role") == "user", F.col("turn") * 3).otherwise(0).cast("bigint").alias("embedding_tokens")
    )
    found = cost.totals(cost.priced(calls, cost.rates(spark)))
    return found.withColumns({"dollars": F.round("dollars", 6), "cache_hit_rate": F.round("cache_hit_rate", 6)})


@query("SELECT doc_id, coalesce(starts_with(upper(list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\r]'), lambda x: trim(x, ' \t')), lambda x: x <> '')[1]), 'TH'), false) AS holds FROM documents")
def verdict_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.regexp_replace("text", r"(?i)\A(\s*)TH", "$1TRUE")
    return table(spark, sf_dir, "documents").select("doc_id", fn.verdict(text).alias("holds"))


@query("SELECT conv_id, turn, (turn % 11)::INT AS score FROM conversations")
def score_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("SCORE: "), (F.col("turn") % 11).cast("string"), F.lit("/10 - "), F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", fn.score_value(text).alias("score"))


@query("SELECT page_id, split_part(b, '/', -2) || '/' || split_part(b, '/', -1) AS repo_id FROM (SELECT page_id, regexp_replace(regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '/+$', ''), '\\.git$', '') AS b FROM pages)")
def repo_id_from_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.substring_index(F.substring_index("url", "#", 1), "?", 1)
    return table(spark, sf_dir, "pages").select("page_id", fn.repo_id_from_url(F.concat(F.regexp_replace(url, "/+$", ""), F.lit(".git"))).alias("repo_id"))


@query("SELECT p_partkey, p_brand || '::' || replace(p_name, ' ', '.') AS id, replace(p_name, ' ', '.') AS name, split_part(p_name, ' ', -1) AS bare, p_brand || '::__module__' AS module_id FROM part")
def names_and_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.replace("p_name", F.lit(" "), F.lit(".")).alias("n"))
    ids = rows.withColumn("id", fn.symbol_id(F.col("p_brand"), F.col("n")))
    return ids.select("p_partkey", "id", fn.name_from_id(F.col("id")).alias("name"), fn.bare_name(F.col("n")).alias("bare"), fn.module_id(F.col("p_brand")).alias("module_id"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 <> 2 THEN 'a: ' || replace(p_name, ' ', ', ') END AS args, CASE WHEN p_partkey % 3 = 0 THEN 'list[' || p_size || ']' END AS returns FROM part")
def signature_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    args, name = F.replace("p_name", F.lit(" "), F.lit(",\n  ")), F.concat(F.lit("f"), F.col("p_partkey").cast("string"))
    kind = F.col("p_partkey") % 3
    text = F.when(kind == 0, F.concat(F.lit("async def "), name, F.lit("(a: "), args, F.lit(") -> list["), F.col("p_size").cast("string"), F.lit("]:"))).when(kind == 1, F.concat(F.lit("def "), name, F.lit("(a: "), args, F.lit("):"))).otherwise(F.concat(F.lit("class "), name, F.lit("(Base):")))
    return table(spark, sf_dir, "part").select("p_partkey", fn.signature_args(text).alias("args"), fn.signature_returns(text).alias("returns"))


@query("SELECT page_id, CASE WHEN contains(p, '/') THEN regexp_replace(p, '/[^/]*$', '') ELSE '.' END AS directory FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS p FROM pages)")
def directory_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", fn.directory_of(F.regexp_replace("url", "^https?://", "")).alias("directory"))


@query("SELECT d AS directory, count(*) AS files, string_agg(page_id::VARCHAR, ',' ORDER BY page_id) AS ids FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '/[^/]*$', '') AS d FROM pages) GROUP BY d")
def prefix_dir_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", fn.directory_of(F.regexp_replace("url", "^https?://", "")).alias("directory"))
    return rows.groupBy("directory").agg(F.count("*").alias("files"), F.array_join(F.transform(F.sort_array(F.collect_list("page_id")), lambda x: x.cast("string")), ",").alias("ids"))



@query(
    "WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '[^\r\n]*(\r\n|\r|\n)|[^\r\n]+$') AS l FROM documents WHERE text IS NOT NULL),"
    " b AS (SELECT doc_id, text, list_transform(l, lambda x: regexp_replace(x, '(\r\n|\r|\n)$', '')) AS l, len(l) > 0 AND regexp_matches(l[-1], '(\r|\n)$') AS ended FROM t)"
    " SELECT doc_id, array_to_string(list_concat(l[:1], ['x', 'y'], l[3:]), '\n') || CASE WHEN ended THEN '\n' ELSE '' END AS spliced, array_to_string(l[2:3], '\n') AS sliced FROM b"
)
def splice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    return docs.select("doc_id", fn.splice_lines(F.col("text"), F.lit(2), F.lit(2), F.lit("x\ny")).alias("spliced"), fn.slice_lines(F.col("text"), F.lit(2), F.lit(3)).alias("sliced"))


_LINES = "len(regexp_extract_all(replace(coalesce(text, ''), '{}', '\n'), '[^\r\n]*(\r\n|\r|\n)|[^\r\n]+$'))"


@query(
    f"WITH t AS (SELECT conv_id, turn, {_LINES.format(' ')} AS a, {_LINES.format('e')} AS b FROM conversations)"
    " SELECT conv_id, turn, 'diff: ' || a || ' -> ' || b || ' lines (' || CASE WHEN b >= a THEN '+' ELSE '' END || (b - a) || ')' AS stat FROM t"
)
def diff_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a line for each word, and with a line for each part between two e."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", fn.diff_stat(F.replace(text, F.lit(" "), F.lit("\n")), F.replace(text, F.lit("e"), F.lit("\n"))).alias("stat"))


def _layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph without cycles: parts to their suppliers, these to nations, these to regions, customers to nations."""

    def pairs(name: str, a: str, src: str, b: str, dst: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(a), F.col(src).cast("string")).alias("src"), F.concat(F.lit(b), F.col(dst).cast("string")).alias("dst"))

    parts = pairs("lineitem", "p", "l_partkey", "s", "l_suppkey").unionByName(pairs("supplier", "s", "s_suppkey", "n", "s_nationkey"))
    return parts.unionByName(pairs("nation", "n", "n_nationkey", "r", "n_regionkey")).unionByName(pairs("customer", "c", "c_custkey", "n", "c_nationkey")).distinct()


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of many small cycles: every line item ties its part to one of the same twenty."""
    dst = F.floor(F.col("l_partkey") / 20) * 20 + F.col("l_suppkey") % 20
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("f"), dst.cast("string")).alias("dst")).distinct()


_LAYERED = (
    "e AS (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier"
    " UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"
)
_BLOCKS = "e AS (SELECT DISTINCT 'f' || l_partkey AS src, 'f' || ((l_partkey // 20) * 20 + l_suppkey % 20) AS dst FROM lineitem)"


@query(f"WITH {_LAYERED} SELECT 'imports' AS side, dst AS file_path FROM e WHERE src = 's7' UNION SELECT 'importers', src FROM e WHERE dst = 's7'")
def graph_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _layered(spark, sf_dir)
    return graph.direct_imports(edges, "s7").withColumn("side", F.lit("imports")).unionByName(graph.direct_importers(edges, "s7").withColumn("side", F.lit("importers")))


@query(f"WITH RECURSIVE {_LAYERED}, r AS (SELECT dst FROM e WHERE src = 'p1' UNION SELECT e.dst FROM r JOIN e ON e.src = r.dst) SELECT dst AS file_path FROM r WHERE dst <> 'p1'")
def graph_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.descendants(_layered(spark, sf_dir), "p1")


@query(f"WITH RECURSIVE {_LAYERED}, r AS (SELECT src FROM e WHERE dst = 'r1' UNION SELECT e.src FROM r JOIN e ON e.dst = r.src) SELECT src AS file_path FROM r WHERE src <> 'r1'")
def graph_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ancestors(_layered(spark, sf_dir), "r1")


_CLOSURE = f"WITH RECURSIVE {_BLOCKS}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst)"


@query(f"{_CLOSURE} SELECT src, dst FROM r")
def graph_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(_blocks(spark, sf_dir))


@query(
    f"{_CLOSURE}, p AS (SELECT a.src AS n, a.dst AS m FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src), c AS (SELECT n, min(m) AS component FROM p GROUP BY n)"
    " SELECT component, count(*) AS size, string_agg(n, ',' ORDER BY n) AS members FROM c GROUP BY component HAVING count(*) > 1"
)
def graph_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycles(_blocks(spark, sf_dir)).select("component", "size", F.array_join("members", ",").alias("members"))


@query(
    f"WITH RECURSIVE {_LAYERED}, n AS (SELECT src AS x FROM e UNION SELECT dst FROM e), w(x, d) AS (SELECT x, 0 FROM n UNION SELECT e.dst, d + 1 FROM w JOIN e ON e.src = w.x)"
    " SELECT x AS file_path, max(d)::INT AS layer FROM w GROUP BY x"
)
def graph_topo_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.topological_layers(_layered(spark, sf_dir))


@query(
    f"WITH {_LAYERED}, n AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS p FROM (SELECT src AS x FROM e UNION SELECT dst FROM e))"
    " SELECT a.p::BIGINT AS from_pos, b.p::BIGINT AS to_pos FROM e JOIN n a ON a.x = e.src JOIN n b ON b.x = e.dst"
)
def graph_node_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _layered(spark, sf_dir)
    g = graph.ImportGraph.of(edges.select(F.col("src").alias("file_path")), edges)
    return graph.node_link(g.nodes, g.edges)


@query(f"WITH {_LAYERED} SELECT src, dst FROM e WHERE src <> 'p1' UNION SELECT 'p1', dst FROM e WHERE src = 'p2'")
def graph_update_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _layered(spark, sf_dir)
    g = graph.ImportGraph.of(edges.select(F.col("src").alias("file_path")), edges)
    moved = edges.where("src = 'p2'").select(F.lit("p1").alias("src"), "dst")
    return g.update_files(spark.createDataFrame([("p1",)], "file_path string"), moved).edges


@query(f"WITH {_LAYERED} SELECT (SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e)) AS files, (SELECT count(*) FROM e) AS edges")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _layered(spark, sf_dir)
    g = graph.ImportGraph.of(edges.select(F.col("src").alias("file_path")), edges)
    both = g.nodes.select(F.lit(1).alias("f"), F.lit(0).alias("e")).unionByName(g.edges.select(F.lit(0).alias("f"), F.lit(1).alias("e")))
    return both.agg(F.sum("f").alias("files"), F.sum("e").alias("edges"))


@query(
    "WITH f AS (SELECT r_name AS region, string_agg('    <fn name=\"' || n_name || '\" args=\"k: int\" returns=\"str\" />', '\n' ORDER BY n_name) AS body FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name)"
    " SELECT 'w' AS directory, '<index>\n' || string_agg('  <file path=\"' || region || '.py\" doc=\"About &quot;' || region || '&quot;\">\n' || body || '\n  </file>', '\n' ORDER BY region) || '\n</index>' AS block FROM f"
)
def render_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    path = F.concat(F.lit("w/"), "r_name", F.lit(".py"))
    functions = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(path.alias("file_path"), fn.symbol_id(path, F.col("n_name")).alias("id"), F.lit("function").alias("kind"), F.lit(None).cast("string").alias("description"), F.concat(F.lit("def "), "n_name", F.lit("(k: int) -> str:")).alias("signature"))
    modules = region.select(path.alias("file_path"), fn.module_id(path).alias("id"), F.lit("module").alias("kind"), F.concat(F.lit('About "'), "r_name", F.lit('"')).alias("description"), F.lit("").alias("signature"))
    return render.render_directories(functions.unionByName(modules))


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return incremental.event_counts(events).withColumns({"total": F.round("total", 4), "window_start": F.col("window_start").cast("timestamp_ntz")})


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and content of a Python file for each part, in packages of two levels."""
    k, n = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    path = F.concat(F.lit("lib/g"), (F.col("p_partkey") % 7).cast("string"), F.lit("/h"), (F.col("p_partkey") % 3).cast("string"), F.lit("/m"), k, F.lit(".py"))
    lines = [
        F.concat(F.lit("import os.path, g"), (F.col("p_partkey") % 7).cast("string"), F.lit(" as top")), F.concat(F.lit("from . import m"), k), F.lit("from ..h1 import x, y"), F.lit("from os.path import join"), F.lit(""), F.lit("@top"),
        F.concat(F.lit("def f"), k, F.lit("(a, *, b: int = "), n, F.lit(") -> str:")), F.lit("    return a"), F.lit(""), F.concat(F.lit("class C"), n, F.lit("(Base, kind="), k, F.lit("):")), F.lit("    async def go(self):"), F.lit("        return 1"), F.lit(""),
    ]
    broken = F.when(F.col("p_partkey") % 50 == 49, F.lit("def (")).otherwise(F.concat_ws("\n", *lines))
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", path.alias("path"), broken.alias("content"))


_P = "SELECT p_partkey AS k, p_size AS n, 'lib/g' || (p_partkey % 7) || '/h' || (p_partkey % 3) AS dir, 'lib/g' || (p_partkey % 7) || '/h' || (p_partkey % 3) || '/m' || p_partkey || '.py' AS file_path FROM part"
_DEF = "'def f' || k || '(a, *, b: int=' || n || ') -> str:'"


@query(
    f"WITH p AS ({_P}), s AS (SELECT k, file_path, 'f' || k AS name, 'function' AS kind, {_DEF} AS signature, '@top\ndef f' || k || '(a, *, b: int = ' || n || ') -> str:\n    return a' AS source, 6 AS start_line, 8 AS end_line, NULL AS parent FROM p"
    " UNION ALL SELECT k, file_path, 'C' || n, 'class', 'class C' || n || '(Base, kind=' || k || '):', 'class C' || n || '(Base, kind=' || k || '):\n    async def go(self):\n        return 1', 10, 12, NULL FROM p"
    " UNION ALL SELECT k, file_path, 'C' || n || '.go', 'method', 'async def go(self):', '    async def go(self):\n        return 1', 11, 12, 'C' || n FROM p)"
    " SELECT * EXCLUDE (k) FROM s WHERE k % 50 <> 49"
)
def extract_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_symbols(_sources(spark, sf_dir)).where("error IS NULL").drop("error")


@query(f"SELECT file_path FROM ({_P}) WHERE k % 50 = 49")
def extract_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_symbols(_sources(spark, sf_dir)).where("error LIKE 'AST parse error%' AND name IS NULL").select("file_path")


@query(f"SELECT file_path, 'method' AS kind, 11 AS start_line, 12 AS end_line FROM ({_P}) WHERE k % 50 <> 49 AND n = 7")
def symbol_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.symbol_by_name(extract.extract_symbols(_sources(spark, sf_dir)), "C7.go").select("file_path", "kind", "start_line", "end_line")


_IMPORTS = (
    "i AS (SELECT file_path, dir, k, u.* FROM p, (VALUES (0, 'os.path', 0, '', false), (1, 'top', 0, '', false), (2, NULL, 1, 'm', true), (3, 'h1', 2, 'x,y', true), (4, 'os.path', 0, 'join', true)) u(pos, module, level, names, is_from) WHERE k % 50 <> 49)"
)


@query(
    f"WITH p AS ({_P}), {_IMPORTS} SELECT file_path, pos, CASE WHEN pos = 1 THEN 'g' || (k % 7) ELSE module END AS module, level, CASE WHEN pos = 2 THEN 'm' || k ELSE names END AS names, is_from FROM i"
)
def extract_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_imports(_sources(spark, sf_dir)).withColumn("names", F.array_join("names", ","))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files, and the packages of all but the second directory: lib/g0, lib/g1 and so on are packages, of lib/g2 only the lower level is."""
    files = _sources(spark, sf_dir).select("path")
    up = files.select(F.regexp_replace("path", "/[^/]*$", "").alias("d")).distinct()
    lower = up.select(F.concat("d", F.lit("/__init__.py")).alias("path"))
    upper = up.select(F.concat(F.regexp_replace("d", "/[^/]*$", ""), F.lit("/__init__.py")).alias("path")).where("path <> 'lib/g2/__init__.py'")
    return files.unionByName(lower).unionByName(upper).distinct()


_PACKAGES = "k AS (SELECT file_path, k, CASE WHEN k % 7 = 2 THEN 'h' || (k % 3) ELSE 'g' || (k % 7) || '.h' || (k % 3) END AS package FROM p)"


@query(f"WITH p AS ({_P}), {_PACKAGES} SELECT file_path AS path, package FROM k")
def packages_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.packages_of_files(_paths(spark, sf_dir))
    return found.where(~F.col("path").endswith("__init__.py"))


_ABSOLUTE = (
    f"WITH p AS ({_P}), {_PACKAGES}, a AS (SELECT file_path, k, 0 AS nth, 'os.path' AS module FROM k UNION ALL SELECT file_path, k, 1, 'g' || (k % 7) FROM k UNION ALL SELECT file_path, k, 2, package || '.m' || k FROM k"
    " UNION ALL SELECT file_path, k, 3, CASE WHEN contains(package, '.') THEN split_part(package, '.', 1) || '.h1' ELSE 'h1' END FROM k)"
)


@query(f"{_ABSOLUTE} SELECT file_path, module, (row_number() OVER (PARTITION BY file_path ORDER BY nth) - 1)::INT AS pos FROM a WHERE k % 50 <> 49")
def absolute_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In order of first mention: os.path is imported twice and counts once."""
    return extract.absolute_imports(extract.extract_imports(_sources(spark, sf_dir)), extract.packages_of_files(_paths(spark, sf_dir)))


@query(
    f"{_ABSOLUTE}, f AS (SELECT dir || '/__init__.py' AS path FROM p UNION SELECT regexp_replace(dir, '/[^/]*$', '') || '/__init__.py' FROM p WHERE k % 7 <> 2 UNION SELECT file_path FROM p),"
    " r AS (SELECT DISTINCT 'g' || (k % 7) AS name FROM p WHERE k % 7 <> 2), s AS (SELECT DISTINCT 'h' || (k % 3) AS name FROM p WHERE k % 7 = 2),"
    " b AS (SELECT a.file_path, module, u.n, CASE WHEN split_part(module, '.', 1) IN (SELECT name FROM r) THEN 'lib/' WHEN split_part(module, '.', 1) IN (SELECT name FROM s) THEN 'lib/g2/' END || array_to_string(list_slice(string_split(module, '.'), 1, u.n), '/') AS stem FROM a, unnest(range(1, len(string_split(module, '.')) + 1)) AS u(n) WHERE k % 50 <> 49),"
    " c AS (SELECT file_path, module, n, i.k AS k, stem || CASE i.k WHEN 0 THEN '.py' ELSE '/__init__.py' END AS path FROM b, range(2) AS i(k)),"
    " t AS (SELECT file_path, module, arg_min(path, -n * 10 + k) AS target FROM c JOIN f USING (path) GROUP BY ALL)"
    " SELECT DISTINCT file_path AS src, target AS dst FROM t"
)
def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from sources to edges."""
    paths = _paths(spark, sf_dir)
    modules = extract.absolute_imports(extract.extract_imports(_sources(spark, sf_dir)), extract.packages_of_files(paths))
    return extract.import_edges(extract.resolve_imports(modules, paths, extract.package_roots(paths)))


@query(
    "WITH c AS (SELECT n_regionkey, n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey), m AS (SELECT n_regionkey, string_agg('      <method name=\"' || lower(n_name) || '\" args=\"self, k: int\" />', '\n' ORDER BY n_name) AS body FROM c GROUP BY ALL),"
    " b AS (SELECT r_name, '    <fn name=\"top\" args=\"\" />\n    <cls name=\"Bare\" />\n    <cls name=\"Of' || r_name || '\">\n' || body || '\n    </cls>' AS body FROM m JOIN region ON n_regionkey = r_regionkey)"
    " SELECT 'w' AS directory, 'w/' || r_name || '.py' AS file_path, '  <file path=\"' || r_name || '.py\">\n' || body || '\n  </file>' AS block FROM b"
)
def render_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class with a method for each nation, one without methods, a function, and a method of a class without a row, which is left out."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    path = F.concat(F.lit("w/"), "r_name", F.lit(".py"))
    none = F.lit(None).cast("string").alias("description")
    row = lambda df, name, kind, signature: df.select(path.alias("file_path"), fn.symbol_id(path, name).alias("id"), F.lit(kind).alias("kind"), none, signature.alias("signature"))
    both = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    own = F.concat(F.lit("Of"), "r_name")
    rows = row(both, F.concat(own, F.lit("."), F.lower("n_name")), "method", F.lit("def go(self, k: int):")).unionByName(row(region, own, "class", F.concat(F.lit("class "), own, F.lit(":"))))
    rows = rows.unionByName(row(region, F.lit("Bare"), "class", F.lit("class Bare(Base):"))).unionByName(row(region, F.lit("top"), "function", F.lit("def top():"))).unionByName(row(region, F.lit("Gone.x"), "method", F.lit("def x(self):")))
    return render.render_files(rows)


@query(
    "SELECT o_orderkey, 'codeloom: f' || o_orderkey || ' @ ' || o_orderstatus || '.py' || '\n\n' || 'old: ' || CASE WHEN o_orderstatus = 'O' THEN '(none)' ELSE 'was ' || o_orderpriority END || '\nnew: ' || o_orderpriority || '\n\nfidelity: TRUE\nprudence: '"
    " || CASE WHEN o_orderstatus = 'O' THEN 'skipped (no old comment)' WHEN o_orderstatus = 'F' THEN 'force' ELSE 'TRUE' END || '\n\ndiff: 2 -> 3 lines (+1)' AS message FROM orders"
)
def commit_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, fresh = F.col("o_orderstatus"), F.col("o_orderstatus") == "O"
    change = F.struct(
        F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("name"), F.when(~fresh, F.concat(F.lit("was "), "o_orderpriority")).alias("old_comment"), F.col("o_orderpriority").alias("new_comment"),
        F.lit("x").alias("fidelity_evidence"), (status != "P").alias("prudence_skipped"), F.lit("y").alias("prudence_evidence"),
    )
    message = fn.commit_message(F.concat(status, F.lit(".py")), F.array(change), fn.diff_stat(F.lit("a\nb"), F.lit("a\nb\nc")))
    return table(spark, sf_dir, "orders").select("o_orderkey", message.alias("message"))


@query(
    "WITH o AS (SELECT conv_id, turn, role, text, CASE WHEN length(trim(role)) > length(trim('turn ' || turn)) THEN '1,2' WHEN length(trim(role)) = length(trim('turn ' || turn)) THEN '1,2' ELSE '2,1' END AS ranking FROM conversations)"
    " SELECT conv_id, turn, ranking, 'moderate' AS spread FROM o"
)
def semantic_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stub puts the longer option first, of equal ones the first."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array("role", F.concat(F.lit("turn "), F.col("turn").cast("string"))).alias("o"))
    ranked = semantic.sem_rank(rows, F.lit("long"), F.col("o"), semantic.StubClient())
    return ranked.select("conv_id", "turn", F.array_join(F.transform("ranking", lambda x: x.cast("string")), ",").alias("ranking"), "spread")


@query(ORACLE_SQL["graph_descendants"])
def graph_descendants_at_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rounds of joins that graphs beyond one task take."""
    return graph.descendants(_layered(spark, sf_dir), "p1", small=0)


@query(ORACLE_SQL["graph_cycles"])
def graph_cycles_at_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycles(_blocks(spark, sf_dir), small=0).select("component", "size", F.array_join("members", ",").alias("members"))


@query(ORACLE_SQL["graph_topo_layers"])
def graph_topo_layers_at_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.topological_layers(_layered(spark, sf_dir), small=0)


@query(
    "SELECT conv_id, turn, ("
    + " + ".join(f"CASE WHEN regexp_matches(lower(coalesce(text, '')), '(^|[^\\p{{L}}\\p{{N}}_]){w}([^\\p{{L}}\\p{{N}}_]|$)') THEN 1 ELSE 0 END" for w in ("polite", "and", "short"))
    + ")::INT AS score FROM conversations"
)
def semantic_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stub's score is the number of words that a turn shares with the quality."""
    rows = table(spark, sf_dir, "conversations")
    return semantic.sem_score(rows.select("conv_id", "turn", "text"), F.lit("polite and short"), F.col("text"), semantic.StubClient()).select("conv_id", "turn", "score")


@query("SELECT item_id, text FROM benchmark WHERE trim(coalesce(text, '')) <> ''")
def semantic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stub holds a claim to be true if neither artifact is empty."""
    return semantic.sem_filter(table(spark, sf_dir, "benchmark"), F.lit("B fits A"), F.lit("spec"), F.coalesce("text", F.lit("")), semantic.StubClient())


@query()
def semantic_embed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    client = semantic.StubClient()
    rows = table(spark, sf_dir, "benchmark").withColumn("v", semantic.embed_for_store(F.col("text"), client))
    return vector.knn(rows, semantic.embed_query("the and of", client), "v", key="item_id").select("item_id", F.round("_distance", 6).alias("distance"))


_CONTENT = (
    "'import os.path, g' || (k % 7) || ' as top\nfrom . import m' || k || '\nfrom ..h1 import x, y\nfrom os.path import join\n\n@top\ndef f' || k || '(a, *, b: int = ' || n || ') -> str:\n    return a\n\nclass C' || n || '(Base, kind=' || k || '):\n    async def go(self):\n        return 1\n'"
)


@query(
    f"WITH p AS (SELECT *, sha256({_CONTENT}) AS source_hash FROM ({_P}) WHERE k % 50 <> 49),"
    f" r AS (SELECT k, file_path, '__module__' AS name, 'module' AS kind, 'Module of 3 symbols.' AS description, '' AS signature, source_hash FROM p UNION ALL SELECT k, file_path, 'f' || k, 'function', 'The function f' || k || '.', {_DEF}, source_hash FROM p"
    " UNION ALL SELECT k, file_path, 'C' || n, 'class', 'The class C' || n || '.', 'class C' || n || '(Base, kind=' || k || '):', source_hash FROM p UNION ALL SELECT k, file_path, 'C' || n || '.go', 'method', 'The method C' || n || '.go.', 'async def go(self):', source_hash FROM p)"
    " SELECT file_path || '::' || name AS id, file_path, kind, description, signature, source_hash, 'a/b' AS repo_id, (CASE WHEN k % 5 <> 0 THEN 0 WHEN kind = 'module' THEN 3 ELSE 1 END)::BIGINT AS mutation_count, 'unknown' AS git_author FROM r"
)
def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbol table's rows for files as they are indexed, described by the stub; a fifth of the files has been stored before."""
    files = _sources(spark, sf_dir).select("path", "content", fn.content_hash(F.col("content")).alias("source_hash"), "p_partkey")
    symbols = extract.extract_symbols(files)
    sound = files.where(F.col("p_partkey") % 50 != 49)
    described = semantic.describe_modules(sound, symbols, semantic.StubClient())
    stored = files.where(F.col("p_partkey") % 5 == 0).select(fn.module_id(F.col("path")).alias("id"), F.col("path").alias("file_path"), F.lit(2).cast("bigint").alias("mutation_count"))
    no_git = spark.createDataFrame([], "file_path string, last_modified string, git_author string")
    rows = index.symbol_rows(sound.drop("p_partkey"), symbols, described, semantic.StubClient(), no_git, "a/b", stored)
    return rows.select("id", "file_path", "kind", "description", "signature", "source_hash", "repo_id", "mutation_count", "git_author")


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoints.folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "WITH a AS (SELECT p_brand AS file_path, p_partkey AS k, p_size AS n, 'first' AS description FROM part), b AS (SELECT file_path, k, n, CASE WHEN n < 10 THEN 'second' ELSE description END AS description FROM a),"
    " c AS (SELECT file_path, k, description FROM b WHERE file_path <> 'Brand#3' UNION ALL SELECT file_path, k, 'third' FROM b WHERE file_path = 'Brand#3' AND n > 25)"
    " SELECT file_path || '::s' || k AS id, file_path, description FROM c WHERE file_path <> 'Brand#7'"
)
def store_maintained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store in the checkpoint folder after an insert, an update, the replacement of a file and the removal of one."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), VECTOR_SIZE)

    def rows(description: str, only: str = "true") -> DataFrame:
        own = table(spark, sf_dir, "part").where(only).select(F.col("p_brand").alias("file_path"), fn.symbol_id(F.col("p_brand"), F.concat(F.lit("s"), F.col("p_partkey").cast("string"))).alias("id"))
        filled = {"kind": "function", "description": description, "signature": "", "source_hash": "h", "last_modified": "t", "git_author": "a", "repo_id": "r"}
        return own.withColumns({n: F.lit(v) for n, v in filled.items()} | {"mutation_count": F.lit(0).cast("bigint"), "description_vector": zeros, "signature_vector": zeros})

    symbols = store.SymbolStore(spark, _scratch(spark, "store")).ensure()
    symbols.upsert(rows("first"))
    symbols.upsert(rows("second", "p_size < 10"))
    symbols.replace_files(rows("third", "p_brand = 'Brand#3' AND p_size > 25"))
    symbols.delete_by_file("Brand#7")
    return symbols.read().select("id", "file_path", "description")


@query(f"WITH {_LAYERED} SELECT src, dst FROM e")
def graph_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph as it comes back from tables, which is how large ones are saved."""
    edges, path = _layered(spark, sf_dir), _scratch(spark, "graph")
    graph.ImportGraph.of(edges.select(F.col("src").alias("file_path")), edges).save(path, small=10)
    return graph.ImportGraph.load(spark, path).edges


def _written(files: DataFrame, root: str) -> None:
    """Write files (path, content) below a folder that driver and workers see, by tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
                with open(f"{root}/{path}", "w", encoding="utf-8", newline="") as file:
                    file.write(content)
            yield batch.slice(0, 0)

    files.select("path", "content").mapInArrow(run, "path string, content string").write.format("noop").mode("overwrite").save()


@query(
    f"WITH p AS ({_P}), f AS (SELECT file_path AS path, CASE WHEN k % 50 = 49 THEN 'def (' ELSE {_CONTENT} END AS content FROM p UNION ALL SELECT DISTINCT dir || '/__init__.py', '' FROM p)"
    " SELECT path, strlen(content)::BIGINT AS size, sha256(content) AS source_hash, starts_with(path, 'lib/g3/h1/m1') AS below FROM f"
)
def repository_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of files as the partitioned source lists it and workers read it; of a prefix, listed by itself, the same."""
    root = f"{re.sub('^file:/+', '/', _scratch(spark, 'tree'))}"
    files = _sources(spark, sf_dir).select("path", "content")
    initial = files.select(F.concat(F.regexp_replace("path", "/[^/]*$", ""), F.lit("/__init__.py")).alias("path"), F.lit("").alias("content")).distinct()
    _written(files.unionByName(initial), root)
    listed = repository.list_files(spark, root)
    some = repository.list_files(spark, root, prefix="lib/g3/h1/m1").select("path", F.lit(True).alias("below"))
    read = sources.read_listed(listed, root).select("path", fn.content_hash(F.col("content")).alias("source_hash"))
    return read.join(listed, "path").join(some, "path", "left").select("path", "size", "source_hash", F.coalesce("below", F.lit(False)).alias("below"))


@query(
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id, (CASE WHEN strlen(t) > 20000 THEN 0 ELSE strlen(t) END)::BIGINT AS bytes, (CASE WHEN strlen(t) > 20000 THEN 0 ELSE length(t) - length(replace(t, ' ', '')) END)::BIGINT AS blanks, strlen(t) > 20000 AS refused FROM d"
)
def embed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector for each document from a service that refuses requests of many inputs and long texts: only the latter have none."""
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", semantic.embed_checked(F.col("text"), CountingService(), 4).alias("e"))
    return found.select("doc_id", F.col("e.vector")[0].cast("bigint").alias("bytes"), F.col("e.vector")[1].cast("bigint").alias("blanks"), F.col("e.error").isNotNull().alias("refused"))


@query(
    "SELECT conv_id, turn, CASE WHEN length(t) % 7 = 3 THEN NULL ELSE (length(t) % 11)::INT END AS score, n AS first_calls, 0::BIGINT AS second_calls FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations), (SELECT count(DISTINCT coalesce(text, ''))::BIGINT AS n FROM conversations)"
)
def durable_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of the conversations scored by a service, out of a store of answers: equal texts are asked once, and a second run asks nothing."""
    turns, kept, meter = table(spark, sf_dir, "conversations"), answers.AnswerStore(spark, _scratch(spark, "answers"), buckets=8), semantic.Meter(spark)
    calls = []
    for _ in range(2):
        found = answers.generate(turns, F.col("text"), meter.client(CountingService()), semantic.PROMPTS["score"], kept)
        calls.append(int(meter.read()["total"]["calls"]))
    return found.select("conv_id", "turn", fn.score_value(F.col("answer.text")).alias("score"), F.lit(calls[0]).cast("bigint").alias("first_calls"), F.lit(calls[1] - calls[0]).cast("bigint").alias("second_calls"))


@query(
    "WITH t AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS d, b.embedding::DOUBLE[] AS s FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),"
    " p AS (SELECT q.vec_id AS query, t.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], d), 9) AS d, round(list_cosine_similarity(q.embedding::DOUBLE[], s), 9) AS s FROM embeddings q, t WHERE q.vec_id % 20 = 0)"
    " SELECT query, vec_id, round(greatest(d, s), 6) AS similarity, CASE WHEN s > d THEN 'signature' ELSE 'description' END AS match_field FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY greatest(d, s) DESC, vec_id) <= 10"
)
def search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search of two columns for each of a table of queries."""
    rows = table(spark, sf_dir, "embeddings")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    found = vector.search_many(rows.join(after, "vec_id"), rows.where("vec_id % 20 = 0"), ["embedding", "other"], key="vec_id")
    return found.select("query", "vec_id", F.round("similarity", 6).alias("similarity"), F.when(F.col("column") == 1, "signature").otherwise("description").alias("match_field"))


@query(
    "WITH o AS (SELECT 'all' AS ranking, p_partkey::VARCHAR AS id, p_size * 1000000 + p_partkey AS v FROM part UNION ALL SELECT p_brand, p_partkey::VARCHAR, p_size * 1000000 + p_partkey FROM part)"
    " SELECT ranking, id, row_number() OVER (PARTITION BY ranking ORDER BY v DESC) AS rank, 0::BIGINT AS failed FROM o"
)
def rank_many_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts in one ranking, and those of each brand in one, by a service that orders twenty at a time."""
    part = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").cast("string").alias("id"), F.concat((F.col("p_size") * 1_000_000 + F.col("p_partkey")).cast("string"), F.lit(" "), "p_name").alias("text"), F.lit("the greatest number first").alias("criteria"))
    options = part.withColumnRenamed("p_brand", "ranking").unionByName(part.drop("p_brand").withColumn("ranking", F.lit("all")))
    return tournament.rank_many(options, CountingService())


@query(
    f"WITH p AS (SELECT * FROM ({_P}) WHERE n < 50), k AS (SELECT file_path, k, n, 'g' || (k % 7) || '.h' || (k % 3) AS package FROM p),"
    " a AS (SELECT file_path, 'os.path' AS module FROM k WHERE n <> 1 AND k % 50 <> 49 UNION SELECT file_path, 'g' || (k % 7) FROM k WHERE n <> 1 AND k % 50 <> 49 UNION SELECT file_path, package || '.m' || k FROM k WHERE n <> 1 AND k % 50 <> 49"
    " UNION SELECT file_path, split_part(package, '.', 1) || '.h1' FROM k WHERE n <> 1 AND k % 50 <> 49 UNION SELECT file_path, 'g' || (k % 5) || '.late' FROM k WHERE n = 1 UNION SELECT file_path, 'h0' FROM k WHERE n = 1),"
    f" f AS (SELECT dir || '/__init__.py' AS path FROM ({_P}) UNION SELECT regexp_replace(dir, '/[^/]*$', '') || '/__init__.py' FROM ({_P}) UNION SELECT file_path FROM p UNION SELECT 'lib/g3/late.py'),"
    f" r AS (SELECT DISTINCT 'g' || (k % 7) AS name FROM ({_P})),"
    " b AS (SELECT file_path, module, u.n, 'lib/' || array_to_string(list_slice(string_split(module, '.'), 1, u.n), '/') AS stem FROM a, unnest(range(1, len(string_split(module, '.')) + 1)) AS u(n) WHERE split_part(module, '.', 1) IN (SELECT name FROM r)),"
    " c AS (SELECT file_path, module, n, i.k AS k, stem || CASE i.k WHEN 0 THEN '.py' ELSE '/__init__.py' END AS path FROM b, range(2) AS i(k)),"
    " t AS (SELECT file_path, module, arg_min(path, -n * 10 + k) AS target FROM c JOIN f USING (path) GROUP BY ALL)"
    " SELECT DISTINCT file_path AS src, target AS dst FROM t"
)
def import_edges_after_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges in the import tables after edits: files of size 1 get other imports, those of size 50 go, lib/g2 becomes a package, and a module that many wait for appears. Only what an edit touches is parsed."""
    files = _sources(spark, sf_dir).select("p_size", "path", "content").unionByName(_paths(spark, sf_dir).where(F.col("path").endswith("__init__.py")).select(F.lit(0).alias("p_size"), "path", F.lit("").alias("content")))
    hashed = checkpoints.checkpointed(files.withColumn("source_hash", fn.content_hash(F.col("content"))))
    k = F.regexp_extract("path", r"m(\d+)\.py$", 1).cast("int")
    other = F.concat(F.lit("import g"), (k % 5).cast("string"), F.lit(".late\nfrom h0 import x"))
    edited = hashed.where("p_size = 1").withColumn("content", other).withColumn("source_hash", fn.content_hash(F.col("content")))
    late = spark.range(1).select(F.lit("lib/g3/late.py").alias("path"), F.lit("").alias("content"), F.lit("late").alias("source_hash"))
    initial = spark.range(1).select(F.lit("lib/g2/__init__.py").alias("path"), F.lit("").alias("content"), F.lit("new").alias("source_hash"))
    found = imports.ImportIndex(spark, _scratch(spark, "imports"), buckets=8)
    found.update(hashed)
    found.update(edited, hashed.where("p_size = 50").select("path"))
    found.update(initial)
    found.update(late)
    return found.edges()


@query(
    _TWO + ", r AS (SELECT id, greatest(d, s) AS similarity, CASE WHEN s > d THEN 'signature' ELSE 'description' END AS field FROM s ORDER BY greatest(d, s) DESC, id LIMIT 10)"
    " SELECT printf('%6.3f  %-8s  %s::%s  (%s)', similarity, CASE WHEN id % 2 = 0 THEN 'function' ELSE 'method' END, 'a/' || (id % 9) || '.py', 'C.f' || id, field) AS line FROM r"
)
def search_printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, q = _two_columns(spark, sf_dir)
    path = F.concat(F.lit("a/"), (F.col("id") % 9).cast("string"), F.lit(".py"))
    name = F.concat(F.lit("C.f"), F.col("id").cast("string"))
    found = vector.search_vectors(rows, q, "embedding", "other")
    full = found.select(fn.symbol_id(path, name).alias("id"), path.alias("file_path"), F.when(F.col("id") % 2 == 0, "function").otherwise("method").alias("kind"), F.lit("").alias("description"), F.lit("").alias("signature"), "similarity", "match_field")
    return vector.format_results(vector.search_results(full))
