"""Table functions over Python sources, and the resolution of imports to files.

Parsing needs Python workers; all that follows - packages, candidates, first matches - is joins and aggregates.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import derive_package_roots
from codeloom.schema import AST_SYMBOLS, IMPORTS

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_NEWLINE = re.compile(r"\r\n?|\n")


def _first_line(node: ast.AST) -> int:
    return min([node.lineno, *[d.lineno for d in node.decorator_list]])


def function_signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    returns = f" -> {ast.unparse(node.returns)}" if node.returns else ""
    return f"{'async ' * isinstance(node, ast.AsyncFunctionDef)}def {node.name}({ast.unparse(node.args)}){returns}:"


def class_signature(node: ast.ClassDef) -> str:
    given = [ast.unparse(b) for b in node.bases] + [f"{k.arg}={ast.unparse(k.value)}" if k.arg else f"**{ast.unparse(k.value)}" for k in node.keywords]
    return f"class {node.name}({', '.join(given)}):" if given else f"class {node.name}:"


def symbols_of(source: str) -> list[dict]:
    """Functions and classes at the top of a module, and the functions directly in those classes, in document order."""
    lines = _NEWLINE.split(source)
    found = []

    def add(node: ast.AST, kind: str, parent: str | None) -> None:
        first, last = _first_line(node), node.end_lineno or node.lineno
        found.append({
            "name": f"{parent}.{node.name}" if parent else node.name, "kind": kind, "signature": class_signature(node) if kind == "class" else function_signature(node),
            "source": "\n".join(lines[first - 1 : last]), "start_line": first, "end_line": last, "parent": parent,
        })

    for node in ast.parse(source).body:
        if isinstance(node, _FUNCTIONS):
            add(node, "function", None)
        elif isinstance(node, ast.ClassDef):
            add(node, "class", None)
            for child in node.body:
                if isinstance(child, _FUNCTIONS):
                    add(child, "method", node.name)
    return found


def imports_of(source: str) -> list[dict]:
    """Import statements anywhere in a module, breadth first: module, level, imported names."""
    found = []
    for node in ast.walk(ast.parse(source)):
        if isinstance(node, ast.Import):
            found += [{"module": a.name, "level": 0, "names": [], "is_from": False} for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            found.append({"module": node.module, "level": node.level or 0, "names": [a.name for a in node.names], "is_from": True})
    return [x | {"pos": i} for i, x in enumerate(found)]


def _parsed(content: str | None, run) -> tuple[list[dict], str | None]:
    try:
        return run(content or ""), None
    except (SyntaxError, ValueError, RecursionError) as e:
        return [], f"AST parse error: {e}"


def extract_symbols(files: DataFrame) -> DataFrame:
    """file_path with a symbol's columns for each symbol of the files (path, content); one row with only ``error`` where a file doesn't parse."""
    names = [f.split()[0] for f in AST_SYMBOLS.split(", ")]

    form = pa.schema([(n, pa.int32() if n.endswith("_line") else pa.string()) for n in ("file_path", *names, "error")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                found, error = _parsed(content, symbols_of)
                rows += [{"file_path": path, **x} for x in found] if error is None else [{"file_path": path, "error": error}]
            yield pa.RecordBatch.from_pylist(rows, form)

    return files.select("path", "content").mapInArrow(run, f"file_path string, {AST_SYMBOLS}, error string")


def extract_imports(files: DataFrame) -> DataFrame:
    """The import statements of the files (path, content) that parse, as written."""

    form = pa.schema([("file_path", pa.string()), ("pos", pa.int32()), ("module", pa.string()), ("level", pa.int32()), ("names", pa.list_(pa.string())), ("is_from", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"file_path": path, **x} for path, content in zip(*[c.to_pylist() for c in batch.columns], strict=True) for x in _parsed(content, imports_of)[0]]
            yield pa.RecordBatch.from_pylist(rows, form)

    return files.select("path", "content").mapInArrow(run, IMPORTS)


def symbol_by_name(symbols: DataFrame, name: str) -> DataFrame:
    """The first symbol of that name in each file."""
    return symbols.where(F.col("name") == name).groupBy("file_path").agg(F.min_by(F.struct(*[c for c in symbols.columns if c != "file_path"]), "start_line").alias("s")).select("file_path", "s.*")


def package_directories(paths: DataFrame) -> DataFrame:
    """Directories (column dir) that hold an ``__init__.py``; the root is the empty string."""
    return paths.where(F.col("path").rlike(r"(^|/)__init__\.py$")).select(F.regexp_replace("path", r"/?__init__\.py$", "").alias("dir")).distinct()


def packages_of_files(paths: DataFrame) -> DataFrame:
    """path with its dotted package: the unbroken run of package directories above it; null outside of packages."""
    above = paths.select("path", F.posexplode(derive_package_roots(F.col("path"))).alias("up", "dir"))
    known = above.join(package_directories(paths).withColumn("is_package", F.lit(True)), "dir", "left")
    broken = known.groupBy("path").agg(F.min(F.when(F.col("is_package").isNull(), F.col("up"))).alias("gap"), F.count("*").alias("depth"))
    parts = F.split(F.regexp_replace("path", "/[^/]*$", ""), "/")
    run = F.coalesce(F.col("gap"), F.col("depth")).cast("int")
    named = F.when(run > 0, F.concat_ws(".", F.slice(parts, F.size(parts) - run + 1, run)))
    return paths.select("path").join(broken, "path", "left").select("path", named.alias("package"))


def absolute_imports(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """file_path, module, pos: each module a file imports by its absolute name, once, in order of first mention."""
    anchored = imports.join(packages.withColumnRenamed("path", "file_path"), "file_path", "left")
    parts = F.split("package", r"\.")
    keep = F.size(parts) - (F.col("level") - 1)
    base = F.slice(parts, F.lit(1), F.greatest(keep, F.lit(0)))
    targets = F.when(F.col("module").isNotNull(), F.array("module")).otherwise(F.col("names"))
    relative = F.transform(targets, lambda x: F.concat_ws(".", F.concat(base, F.array(x))))
    plain = F.when(F.col("module").isNotNull(), F.array("module")).otherwise(F.array().cast("array<string>"))
    usable = F.when(F.col("level") == 0, plain).when(F.col("package").isNotNull() & (keep >= 0), relative)
    named = anchored.select("file_path", "pos", F.posexplode(usable).alias("nth", "module")).where("module <> ''")
    first = named.groupBy("file_path", "module").agg(F.min(F.struct("pos", "nth")).alias("at"))
    return first.select("file_path", "module", (F.row_number().over(Window.partitionBy("file_path").orderBy("at")) - 1).alias("pos"))


#: Directory names that are never a package's root, and prefixes that resolution tries by itself.
NO_ROOTS, PLAIN_PREFIXES = ("src", "lib", "pkg"), ("", "src/")


def package_roots(paths: DataFrame) -> DataFrame:
    """name and prefix of top packages that lie elsewhere than at the root or in src/: of several, the shortest prefix, then the first in order."""
    found = package_directories(paths).where("dir <> ''").withColumn("up", F.regexp_replace("dir", "(^|/)[^/]*$", ""))
    tops = found.join(found.select(F.col("dir").alias("up")), "up", "left_anti")
    named = tops.select(F.substring_index("dir", "/", -1).alias("name"), F.when(F.col("up") == "", F.lit("")).otherwise(F.concat("up", F.lit("/"))).alias("prefix"))
    named = named.where(~F.col("prefix").isin(*PLAIN_PREFIXES) & ~F.col("name").isin(*NO_ROOTS))
    return named.groupBy("name").agg(F.min(F.struct(F.length("prefix").alias("n"), F.col("prefix"))).alias("best")).select("name", "best.prefix")


def import_candidates(names: DataFrame, roots: DataFrame) -> DataFrame:
    """module, path and rank of each file that a module (column module, distinct) may mean: the one with the least rank that exists is meant.

    Candidates are tried in order: the whole dotted name, then ever shorter ones; for each as a module, a package, both below src/, and below a registered root.
    """
    parted = names.select("module").withColumn("parts", F.split("module", r"\."))
    shorter = parted.select("module", "parts", F.explode(F.sequence(F.size("parts"), F.lit(1), F.lit(-1))).alias("n"))
    rooted = shorter.join(roots.withColumnRenamed("name", "top"), F.col("parts")[0] == F.col("top"), "left")
    path = F.concat_ws("/", F.slice("parts", F.lit(1), F.col("n")))
    tries = [F.concat(path, F.lit(".py")), F.concat(path, F.lit("/__init__.py")), F.concat(F.lit("src/"), path, F.lit(".py")), F.concat(F.lit("src/"), path, F.lit("/__init__.py")), F.concat("prefix", path, F.lit(".py")), F.concat("prefix", path, F.lit("/__init__.py"))]
    each = rooted.select("module", F.size("parts").alias("size"), "n", F.posexplode(F.array(*tries)).alias("nth", "path")).where(F.col("path").isNotNull())
    return each.select("module", "path", ((F.col("size") - F.col("n")) * len(tries) + F.col("nth")).alias("rank"))


def first_matches(candidates: DataFrame, paths: DataFrame) -> DataFrame:
    """module and target, for modules of which a candidate is among ``paths``."""
    return candidates.join(paths.select("path").distinct(), "path").groupBy("module").agg(F.min_by("path", "rank").alias("target"))


def resolve_imports(modules: DataFrame, paths: DataFrame, roots: DataFrame) -> DataFrame:
    """file_path, module and the file it means, for modules (file_path, module) that mean one of ``paths``."""
    return modules.join(first_matches(import_candidates(modules.select("module").distinct(), roots), paths), "module").select("file_path", "module", "target")


def import_edges(resolved: DataFrame) -> DataFrame:
    """Distinct (src, dst) edges; a file that imports itself has one, too."""
    return resolved.select(F.col("file_path").alias("src"), F.col("target").alias("dst")).distinct()
