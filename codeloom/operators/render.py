"""Grouped index documents out of the symbol table."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.checkpoints import checkpointed
from codeloom.functions import directory_of, escape_attribute, signature_args, signature_returns
from codeloom.operators.store import get_by_directory
from codeloom.sources.files import atomic_write

SENTINEL, DOCUMENT = "<!-- codeloom:index -->", "CLAUDE.md"


def _tag(name: Column, args: Column, returns: Column) -> Column:
    """The attributes of a function or method; absent parts are left out."""
    optional = lambda label, value: F.coalesce(F.concat(F.lit(f' {label}="'), value, F.lit('"')), F.lit(""))
    return F.concat(F.lit('name="'), name, F.lit('"'), optional("args", args), optional("returns", returns))


def render_files(rows: DataFrame, order: str | None = None) -> DataFrame:
    """directory, file_path and block (its ``<file>`` element) for each file of the symbol rows.

    Functions come before classes; each in the order of ``order``, by default the id. Methods of a class that has no row are dropped.
    """
    by = [F.col(order)] if order else []
    name = F.substring_index("id", "::", -1)
    parts = rows.select(
        "file_path", F.col("kind"), F.struct(*by, F.col("id")).alias("at"), F.col("description"), name.alias("name"), F.substring_index(name, ".", 1).alias("owner"),
        _tag(F.substring_index(name, ".", -1), signature_args(F.trim("signature")), signature_returns(F.trim("signature"))).alias("tag"), F.instr(name, ".").alias("dot"),
    )
    methods = parts.where((F.col("kind") == "method") & (F.col("dot") > 0)).groupBy("file_path", "owner").agg(F.sort_array(F.collect_list(F.struct("at", F.concat(F.lit("      <method "), "tag", F.lit(" />")).alias("line")))).alias("m"))
    classes = parts.where("kind = 'class'").join(methods.withColumnRenamed("owner", "name"), ["file_path", "name"], "left")
    opened = F.concat(F.lit('    <cls name="'), F.col("name"), F.lit('"'))
    text = F.when(F.col("m").isNull(), F.concat(opened, F.lit(" />"))).otherwise(F.concat(opened, F.lit(">\n"), F.array_join(F.transform("m", lambda x: x.line), "\n"), F.lit("\n    </cls>")))
    lines = parts.where("kind = 'function'").select("file_path", F.lit(0).alias("rank"), "at", F.concat(F.lit("    <fn "), "tag", F.lit(" />")).alias("text")).unionByName(classes.select("file_path", F.lit(1).alias("rank"), "at", text.alias("text")))
    bodies = lines.groupBy("file_path").agg(F.sort_array(F.collect_list(F.struct("rank", "at", "text"))).alias("lines"))
    files = rows.groupBy("file_path").agg(F.min_by(F.when(F.col("kind") == "module", F.col("description")), F.when(F.col("kind") == "module", F.col("id"))).alias("doc"))
    doc = F.when(F.length("doc") > 0, F.concat(F.lit('" doc="'), escape_attribute(F.col("doc")), F.lit('">'))).otherwise(F.lit('">'))
    inside = F.concat(F.array_join(F.transform("lines", lambda x: x.text), "\n"), F.lit("\n"))
    block = F.concat(F.lit('  <file path="'), F.substring_index("file_path", "/", -1), doc, F.lit("\n"), F.coalesce(inside, F.lit("")), F.lit("  </file>"))
    return files.join(bodies, "file_path", "left").select(directory_of(F.col("file_path")).alias("directory"), "file_path", block.alias("block"))


def render_directories(rows: DataFrame, order: str | None = None) -> DataFrame:
    """directory and block (its ``<index>`` element), files in order of their path."""
    grouped = render_files(rows, order).groupBy("directory").agg(F.sort_array(F.collect_list(F.struct("file_path", "block"))).alias("f"))
    return grouped.select("directory", F.concat(F.lit("<index>\n"), F.array_join(F.transform("f", lambda x: x.block), "\n"), F.lit("\n</index>")).alias("block"))


def merge_document(existing: str | None, block: str) -> str:
    """A document with its index block replaced: after the sentinel, in place of an ``<index>`` element, or at the end."""
    if existing is None:
        return f"{SENTINEL}\n{block}"
    if SENTINEL in existing:
        return f"{existing.partition(SENTINEL)[0]}{SENTINEL}\n{block}"
    found = re.findall(r"<index>.*?</index>", existing, re.DOTALL)
    if found:
        if len(found) > 1:
            warnings.warn(f"{len(found)} index blocks: the first is replaced", stacklevel=2)
        return existing.replace(found[0], f"{SENTINEL}\n{block}", 1)
    return f"{existing}\n{SENTINEL}\n{block}"


def written_documents(rows: DataFrame, root: str | Path, directory: str = "", recursive: bool = True) -> DataFrame:
    """directory and document of each one written at or below ``directory``; rows of files elsewhere, and directories that aren't there, are left out.

    Tasks write, on the file system that they read sources from: a document is staged beside the old one, whose place it takes in one step. A task made again leaves documents alone that have their block already, so what stands behind it isn't cut twice.
    """
    directory, base = directory.strip("/") or ".", str(Path(root).resolve())
    chosen = get_by_directory(rows, directory)
    if not recursive:
        chosen = chosen.where(directory_of(F.col("file_path")) == directory)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again = TaskContext.get().attemptNumber() > 0
        for batch in batches:
            done = []
            for own, block in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                path = Path(base) / own / DOCUMENT
                if path.parent.is_dir():
                    existing = path.read_text(encoding="utf-8") if path.exists() else None
                    if not (again and existing is not None and f"{SENTINEL}\n{block}" in existing):
                        atomic_write(path, merge_document(existing, block))
                    done.append((own, str(path)))
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in (0, 1)], ["directory", "document"])

    return checkpointed(render_directories(chosen).mapInArrow(run, "directory string, document string"))


def write_documents(rows: DataFrame, root: str | Path, directory: str = "", recursive: bool = True) -> list[Path]:
    """Write the documents; their paths in order of their directories."""
    return [Path(root) / r.directory / DOCUMENT for r in written_documents(rows, root, directory, recursive).orderBy("directory").collect()]
