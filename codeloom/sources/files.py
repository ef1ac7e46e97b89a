"""Files, git and references as sources, and the driver's file sinks.

Trees and logs are listed by the partitioned sources of ``repository``; what is listed is dealt anew by path before it is read, by workers that see the same file system.
"""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from datetime import UTC, datetime
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import repo_id_from_url
from codeloom.schema import FILES
from codeloom.sources import repository

#: Fixed values.
TEXT_SUFFIXES = (".py", ".md", ".xml", ".toml", ".yaml", ".yml", ".json", ".txt")
SKIPPED_DIRECTORIES = ("__pycache__", "node_modules", ".venv", ".claude")


def find_repo_root(start: str | Path = ".") -> Path:
    """The nearest ancestor with a ``.git``, or else the start."""
    here = Path(start).resolve()
    return next((p for p in (here, *here.parents) if (p / ".git").exists()), here)


def read_listed(listed: DataFrame, root: str | Path, tasks: int | None = None) -> DataFrame:
    """path, content and error of the files below ``root`` that a table (path) lists; a file that can't be read has an error and no content."""
    base = str(Path(root).resolve())

    def read(path: str) -> tuple[str, str | None, str | None]:
        try:
            with open(os.path.join(base, path), encoding="utf-8", newline="") as file:
                return path, file.read(), None
        except (OSError, UnicodeDecodeError) as e:
            return path, None, f"read error: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():  # a file at a time: no batch holds many large files
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in read(p)], ["path", "content", "error"])

    tasks = tasks or int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number of its own: lists are small, files aren't
    return listed.select("path").repartition(tasks, "path").mapInArrow(run, FILES)


def read_files(spark: SparkSession, root: str | Path, paths: list[str]) -> DataFrame:
    """path, content and error of some files below ``root``."""
    return read_listed(spark.createDataFrame([(p,) for p in paths], "path string"), root, max(1, min(len(paths) // 64 + 1, 4096)))


def scan_repository(spark: SparkSession, root: str | Path, below: str = "") -> DataFrame:
    """All Python files of a repository, or of one directory in it, as path (relative to the repository), content, error."""
    return read_listed(repository.list_files(spark, root, below), root)


def _git(root: str | Path, *args: str) -> str:
    return repository.git(str(root), *args)


def git_metadata(spark: SparkSession, root: str | Path, path: str | None = None) -> DataFrame:
    """file_path, last_modified and git_author of each file's last commit; of one file, out of its last entry in the log."""
    if path is None:
        return repository.last_commits(repository.commits(spark, root))
    when, _, author = _git(root, "log", "-1", "--format=%aI|%aN", "--", path).strip().partition("|")
    return spark.createDataFrame([(path, when, author)] if when else [], "file_path string, last_modified string, git_author string")


def with_git_metadata(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """Rows (file_path, ...) with last_modified and git_author: now and ``unknown`` where git knows nothing."""
    now = datetime.now(UTC).isoformat(timespec="seconds")
    joined = rows.join(metadata, "file_path", "left")
    return joined.withColumns({"last_modified": F.coalesce("last_modified", F.lit(now)), "git_author": F.coalesce(F.nullif("git_author", F.lit("")), F.lit("unknown"))})


def repo_id(spark: SparkSession, root: str | Path) -> str:
    """owner/repo of the origin, or the directory's name."""
    url = _git(root, "remote", "get-url", "origin").strip()
    if not url:
        return Path(root).resolve().name
    return spark.range(1).select(repo_id_from_url(F.lit(url)).alias("x")).first().x


class MissingKeyError(RuntimeError):
    """No key for a model service was found."""


def api_key(name: str = "OPENAI_API_KEY", start: str | Path = ".") -> str:
    """A key from the environment or the repository's ``.env``."""
    if os.environ.get(name):
        return os.environ[name]
    with suppress(OSError):
        for line in (find_repo_root(start) / ".env").read_text(encoding="utf-8").splitlines():
            key, equals, value = line.strip().removeprefix("export ").partition("=")
            if equals and key.strip() == name and value.strip():
                return value.strip().strip("\"'")
    raise MissingKeyError(f"{name} is set neither in the environment nor in .env")


def resolve(ref: str, label: str = "", log: Callable[[str], None] | None = None) -> str:
    """The text that a reference means: standard input, a symbol's file, a file, a directory's text files, a git range, or itself."""

    def say(kind: str, text: str) -> str:
        if log:
            log(f"{label}: {ref} ({kind}, {len(text)} chars)")
        return text

    if ref == "-":
        return sys.stdin.read()
    path, mark, symbol = ref.partition("::")
    if mark and os.path.isfile(path):
        return say("file::symbol", f"--- {ref} ---\n{Path(path).read_text(encoding='utf-8')}\n[Symbol: {symbol}]")
    here = Path(ref)
    with suppress(OSError):
        if here.is_file():
            return say("file", f"--- {ref} ---\n{here.read_text(encoding='utf-8')}")
        if here.is_dir():
            parts = []
            for file in sorted(here.rglob("*")):
                if file.suffix in TEXT_SUFFIXES and file.is_file() and not set(file.relative_to(here).parts[:-1]) & set(SKIPPED_DIRECTORIES):
                    with suppress(UnicodeDecodeError, PermissionError):
                        parts.append(f"--- {file} ---\n{file.read_text(encoding='utf-8')}")
            return say("directory", "\n".join(parts) if parts else f"[empty directory: {ref}]")
    if ".." in ref or ref.startswith("HEAD"):
        for verb in ("diff", "show"):
            if text := _git(".", verb, ref, "--"):
                return say(f"git {verb}", f"--- git {verb} {ref} ---\n{text}")
    return say("literal", ref)


def atomic_write(path: str | Path, content: str) -> None:
    """Write by a temporary file in the same folder, which takes the place of the old one in one step."""
    path = Path(path)
    handle, staged = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as file:
            file.write(content)
        if path.exists():
            os.chmod(staged, path.stat().st_mode)
        os.replace(staged, path)
    except BaseException:
        with suppress(OSError):
            os.unlink(staged)
        raise


def replace_file(spark: SparkSession, path: str, content: bytes) -> None:
    """Write a file of any of Hadoop's file systems by a staged one beside it, which takes its place in one rename."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs
    target, staged = fs.Path(path), fs.Path(f"{path}.{uuid.uuid4().hex}")
    context = fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(staged, False)
    out.write(bytearray(content))
    out.close()
    kind = getattr(fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    context.rename(staged, target, how)


def _hadoop(spark: SparkSession, path: str):  # noqa: ANN202  objects of the JVM
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_file(spark: SparkSession, path: str) -> str | None:
    """A text file of any of Hadoop's file systems, or None where there is none."""
    at, files = _hadoop(spark, path)
    if not files.exists(at):
        return None
    file = files.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
    finally:
        file.close()


def delete_file(spark: SparkSession, path: str) -> None:
    at, files = _hadoop(spark, path)
    files.delete(at, False)
