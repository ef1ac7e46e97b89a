"""Indexing: from files to symbol rows and import edges, as one plan over all changed files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.checkpoints import checkpointed
from codeloom.functions import content_hash, module_id, symbol_id
from codeloom.operators import extract, semantic
from codeloom.operators.graph import ImportGraph
from codeloom.operators.imports import ImportIndex
from codeloom.operators.store import SymbolStore, changed_files, inherit_mutations, last_definition
from codeloom.schema import VECTOR_SIZE
from codeloom.sources import files as source
from codeloom.sources.files import with_git_metadata


@dataclass
class IndexReport:
    """What an index run did, as a table with one row a file (status indexed, skipped or failed) and its sums."""

    files: DataFrame
    graph: ImportGraph

    def summary(self) -> dict[str, int]:
        row = self.files.agg(
            *[F.count_if(F.col("status") == s).alias(s) for s in ("indexed", "skipped", "failed")], F.coalesce(F.sum("symbols"), F.lit(0)).alias("symbols"), F.coalesce(F.sum("described"), F.lit(0)).alias("described")
        ).first()
        return row.asDict() | {"edges": self.graph.edge_count(), "files": self.graph.files().count()}


def symbol_rows(files: DataFrame, symbols: DataFrame, described: DataFrame, client: semantic.ModelClient, metadata: DataFrame, repo: str, stored: DataFrame) -> DataFrame:
    """Rows of the symbol table for files (path, content, source_hash): a row for each symbol and one for the module.

    A file of which a text couldn't be embedded has zeros there and no hash, so that the next run takes it for changed and asks again.
    Both sides of these joins grow with the files, and Spark's estimates know nothing of texts that are made of a few columns or by Python; so no side is broadcast, which would pass through the driver.
    """
    matched = semantic.match_descriptions(symbols.where(F.col("error").isNull()), described)
    own = matched.select("file_path", symbol_id(F.col("file_path"), F.col("name")).alias("id"), "kind", "description", F.coalesce("signature", F.lit("")).alias("signature"), "start_line")
    parsed = files.join(symbols.where(F.col("error").isNotNull()).select(F.col("file_path").alias("path")).distinct().hint("merge"), "path", "left_anti")
    modules = parsed.select(F.col("path").alias("file_path"), module_id(F.col("path")).alias("id"), F.lit("module").alias("kind")).join(described.select("file_path", F.nullif("description.module_description", F.lit("")).alias("description")).hint("merge"), "file_path", "left")
    rows = own.unionByName(modules.select("file_path", "id", "kind", "description", F.lit("").alias("signature"), F.lit(0).alias("start_line")))
    rows = last_definition(rows).drop("start_line").join(files.select(F.col("path").alias("file_path"), "source_hash").hint("merge"), "file_path")
    rows = with_git_metadata(rows, metadata).withColumn("repo_id", F.lit(repo))
    rows = inherit_mutations(rows, stored.select("id", "file_path", "mutation_count"))
    asked = checkpointed(rows.withColumns({"__d": semantic.embed_checked(F.col("description"), client, VECTOR_SIZE), "__s": semantic.embed_checked(F.col("signature"), client, VECTOR_SIZE)}))
    failed = asked.where("__d.error IS NOT NULL OR __s.error IS NOT NULL").groupBy("file_path").agg(F.first(F.coalesce("__d.error", "__s.error")).alias("embed_error"))
    hashed = asked.join(failed.hint("merge"), "file_path", "left").withColumn("source_hash", F.when(F.col("embed_error").isNull(), F.col("source_hash")).otherwise(F.lit("")))
    return hashed.withColumns({"description_vector": F.col("__d.vector"), "signature_vector": F.col("__s.vector")}).drop("__d", "__s")


def _indexed(spark: SparkSession, root: Path, wanted: DataFrame, store: SymbolStore, client: semantic.ModelClient, metadata: Callable[[], DataFrame], model: str, effort: str, force: bool) -> tuple[DataFrame, DataFrame]:
    """Parse, describe and store those of ``wanted`` (path, content, error, source_hash) that have changed. Gives the paths of what was stored, and a row for each file of ``wanted``: file_path, status, symbols, described, error."""
    stored = store.get(wanted.select(F.col("path").alias("file_path")))
    readable = wanted.where(F.col("error").isNull()).drop("error")
    changed = changed_files(readable.withColumnRenamed("path", "file_path"), stored, force).withColumnRenamed("file_path", "path")
    symbols = checkpointed(extract.extract_symbols(changed))
    broken = symbols.where(F.col("error").isNotNull()).select(F.col("file_path").alias("path"), "error")
    sound = checkpointed(changed.join(broken.select("path"), "path", "left_anti"))
    described = checkpointed(semantic.describe_modules(sound, symbols, client, model, effort))
    rows = checkpointed(symbol_rows(sound, symbols, described, client, metadata(), source.repo_id(spark, root), stored))
    if not rows.isEmpty():
        store.replace_files(rows)
    counted = rows.groupBy("file_path").agg(F.count_if(F.col("kind") != "module").alias("symbols"), F.count_if((F.col("kind") != "module") & F.col("description").isNotNull()).alias("described"), F.first("embed_error").alias("embed_error"))
    failures = wanted.where(F.col("error").isNotNull()).select("path", "error").unionByName(broken)
    done = wanted.select("path").join(failures, "path", "left").join(sound.select("path", F.lit(True).alias("new")), "path", "left").join(counted.withColumnRenamed("file_path", "path"), "path", "left").join(described.select(F.col("file_path").alias("path"), F.col("error").alias("note")), "path", "left")
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("new"), "indexed").otherwise("skipped")
    report = done.select(F.col("path").alias("file_path"), status.alias("status"), F.coalesce("symbols", F.lit(0)).alias("symbols"), F.coalesce("described", F.lit(0)).alias("described"), F.coalesce("error", "embed_error", "note").alias("error"))
    return sound.select(F.col("path").alias("file_path")), report


def imports_of(store: SymbolStore) -> ImportIndex:
    """The import tables that lie beside a store."""
    return ImportIndex(store.spark, f"{store.path}-imports")


def index_directory(spark: SparkSession, root: str | Path, store: SymbolStore, graph: ImportGraph, client: semantic.ModelClient, directory: str = "", model: str = semantic.DESCRIBE_MODEL, effort: str = "medium", force: bool = False, prune: bool = False) -> IndexReport:
    """Index the Python files of a directory of the repository at ``root``.

    Files whose hash the store has are left out before anything is parsed or asked. A file that can't be read or parsed keeps its old rows. All files of the repository are hashed, and those that the import tables don't have so are parsed for their
    imports, so an import finds its target whenever that appears. ``prune`` drops the rows of files that are gone.
    """
    root = Path(root).resolve()
    if not (root / directory).resolve().is_relative_to(root):
        raise ValueError(f"{directory} isn't inside {root}")
    store.ensure()
    everything = source.scan_repository(spark, root)  # all of it: an import may mean any file
    everything = checkpointed(everything.withColumn("source_hash", content_hash(F.col("content"))))
    own = directory.strip("/")
    wanted = everything if own in ("", ".") else everything.where((F.col("path") == own) | F.col("path").startswith(own + "/"))
    sound, report = _indexed(spark, root, wanted, store, client, lambda: source.git_metadata(spark, root), model, effort, force)
    paths = everything.select("path")
    if prune:
        store.prune(paths)
    imports = imports_of(store).ensure()
    known = imports.files.read().select(F.col("file_path").alias("path"))
    differing, gone = checkpointed(imports.differing(everything.withColumn("source_hash", F.coalesce("source_hash", F.lit(""))))), checkpointed(known.join(paths, "path", "left_anti"))
    if not differing.isEmpty() or not gone.isEmpty():
        imports.update(differing, gone)
    nodes = graph.files().unionByName(sound).distinct()
    outside = graph.edges.join(paths.select(F.col("path").alias("src")), "src", "left_anti").select("src", "dst")
    edges = imports.edges().join(nodes.withColumnRenamed("file_path", "src"), "src", "left_semi").select("src", "dst")
    return IndexReport(report, ImportGraph.of(checkpointed(nodes), checkpointed(outside.unionByName(edges))))


def index_file(spark: SparkSession, root: str | Path, path: str, store: SymbolStore, graph: ImportGraph, client: semantic.ModelClient, force: bool = True, model: str = semantic.DESCRIBE_MODEL, effort: str = "medium") -> IndexReport:
    """Index one file at the cost of one: it alone is read and parsed, and of the tables the buckets of its keys. Edges of other files change where the file has come to be, or is a package's first. Where there are no import tables yet, the directory's way makes them."""
    root, imports = Path(root).resolve(), imports_of(store)
    if not imports.exists():
        return index_directory(spark, root, store, graph, client, path, model, effort, force)
    if not (root / path).is_file():
        return IndexReport(spark.createDataFrame([], "file_path string, status string, symbols bigint, described bigint, error string"), graph)
    again = [p for p in imports.unfinished() if p != path]
    read = source.read_files(spark, root, [path, *[p for p in again if (root / p).is_file()]])
    read = checkpointed(read.withColumn("source_hash", content_hash(F.col("content"))))
    wanted = read.where(F.col("path") == path)
    sound, report = _indexed(spark, root, wanted, store, client, lambda: source.git_metadata(spark, root, path), model, effort, force)
    gone = spark.createDataFrame([(p,) for p in again if not (root / p).is_file()], "path string")
    touched = imports.update(read.withColumn("source_hash", F.coalesce("source_hash", F.lit(""))), gone)
    nodes = checkpointed(graph.files().unionByName(sound).distinct())
    known = touched.join(nodes, "file_path", "left_semi")
    edges = imports.edges(known)
    kept = graph.edges.join(touched.withColumnRenamed("file_path", "src"), "src", "left_anti").select("src", "dst")
    return IndexReport(report, ImportGraph.of(nodes, checkpointed(kept.unionByName(edges))))
