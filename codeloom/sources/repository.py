"""A repository's files and history as partitioned Spark data sources.

``codeloom_files`` lists a tree by tasks: the driver opens directories only until there are about ``tasks`` of them, and what it hasn't opened is listed where it is read; a directory of very many names is listed in slices of a checksum. The options prefix and only go down to the listing:
no directory is opened that can't hold such a path. (They are options and no pushed filters, as Spark 4.1 keeps what was once pushed into a Python source for all later uses of the same table.) ``codeloom_commits`` reads the log of one commit, fixed before, in ranges of positions. No list of paths is on the driver. Python workers must see the tree, as on a shared file system; Spark's own sources skip names that
begin with an underscore, and so every ``__init__.py``.

A directory that can't be opened is left out, as are links to directories. An empty or missing tree, or one without history, has no rows.
"""

from __future__ import annotations

import os
import subprocess
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from codeloom.functions.scalars import EXCLUDED_DIRECTORIES

TASKS, WIDE = 64, 50_000
FILES, COMMITS = "path string, size bigint", "position bigint, commit string, committed string, author string, file_path string"
_BATCH = 4096


def entered(relative: str, name: str) -> bool:
    """Whether a directory of this name in that one belongs to the repository."""
    return name not in EXCLUDED_DIRECTORIES and not (relative == ".claude" and name == ".venv")


class Listed(InputPartition):
    """One directory, with all that is below it or without, or a slice of its names."""

    def __init__(self, relative: str, deep: bool, slice: int = 0, slices: int = 1) -> None:  # noqa: A002
        super().__init__((relative, deep, slice, slices))
        self.relative, self.deep, self.slice, self.slices = relative, deep, slice, slices


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.suffix = os.path.abspath(options["root"]), options.get("suffix", ".py")
        self.tasks, self.wide = int(options.get("tasks", TASKS)), int(options.get("wide", WIDE))
        below, self.prefix, self.only = options.get("below", "").strip("/"), options.get("prefix", ""), options.get("only")
        below = "" if below in ("", ".") else f"{below}/"
        self.empty = not (self.prefix.startswith(below) or below.startswith(self.prefix))
        self.prefix = max(self.prefix, below, key=len)

    def _entries(self, relative: str) -> Iterator[os.DirEntry]:
        try:
            with os.scandir(os.path.join(self.root, relative)) as found:
                yield from found
        except OSError:
            return

    def partitions(self) -> list[Listed]:
        aim = self.prefix if self.only is None else self.only
        if self.empty or not aim.startswith(self.prefix):
            return [Listed("", False, 0, 0)]
        start = aim.rpartition("/")[0]
        above = start.split("/") if start else []
        if not all(entered("/".join(above[:k]), name) for k, name in enumerate(above)):
            return [Listed("", False, 0, 0)]
        waiting, out = [start], []
        while waiting and len(waiting) + len(out) < self.tasks:
            now = waiting.pop(0)
            names = 0
            for entry in self._entries(now):
                names += 1
                if entry.is_dir(follow_symlinks=False) and entered(now, entry.name) and self.only is None:
                    waiting.append(f"{now}/{entry.name}" if now else entry.name)
            slices = -(-max(names, 1) // self.wide)
            out += [Listed(now, False, k, slices) for k in range(slices)]
        return out + [Listed(now, True) for now in waiting]

    def _paths(self, part: Listed) -> Iterator[tuple[str, int]]:
        stack = [part.relative] if part.slices else []
        while stack:
            now = stack.pop()
            for entry in self._entries(now):
                if part.slices > 1 and zlib.crc32(entry.name.encode(errors="surrogateescape")) % part.slices != part.slice:
                    continue
                path = f"{now}/{entry.name}" if now else entry.name
                if entry.is_dir(follow_symlinks=False):
                    if part.deep and entered(now, entry.name):
                        stack.append(path)
                elif entry.name.endswith(self.suffix) and path.startswith(self.prefix) and self.only in (None, path) and not entry.is_dir():
                    try:
                        yield path, entry.stat().st_size
                    except OSError:  # gone meanwhile, or a link to nothing: reading it will say so
                        yield path, 0

    def read(self, partition: Listed) -> Iterator[pa.RecordBatch]:
        rows = []
        for path, size in self._paths(partition):
            if not any("\ud800" <= c <= "\udfff" for c in path):  # names that aren't UTF-8 have no text form
                rows.append((path, size))
            if len(rows) == _BATCH:
                yield _rows(rows, [pa.string(), pa.int64()], ["path", "size"])
                rows = []
        yield _rows(rows, [pa.string(), pa.int64()], ["path", "size"])


def _rows(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


class FileSource(DataSource):
    """Options: root; below, prefix, only, suffix, tasks, wide."""

    @classmethod
    def name(cls) -> str:
        return "codeloom_files"

    def schema(self) -> str:
        return FILES

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(self.options)


def git(root: str, *args: str) -> str:
    """What git says, or nothing where it fails."""
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, errors="replace")
    return done.stdout if done.returncode == 0 else ""


class Range(InputPartition):
    """Positions of a log, from the newest commit, which is 0."""

    def __init__(self, head: str, first: int, most: int) -> None:
        super().__init__((head, first, most))
        self.head, self.first, self.most = head, first, most


class LogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.commits = os.path.abspath(options["root"]), int(options.get("commits", 1000))

    def partitions(self) -> list[Range]:
        head = git(self.root, "rev-parse", "HEAD").strip()
        n = int(git(self.root, "rev-list", "--count", head).strip() or 0) if head else 0
        return [Range(head, k, self.commits) for k in range(0, n, self.commits)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        kinds, names = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()], [x.split()[0] for x in COMMITS.split(", ")]
        rows, at = [], partition.first - 1
        if partition.head:
            command = ["git", "-C", self.root, "-c", "core.quotepath=off", "log", partition.head, f"--skip={partition.first}", f"--max-count={partition.most}", "--format=%x00%H|%aI|%aN", "--name-only"]
            with subprocess.Popen(command, stdout=subprocess.PIPE, text=True, errors="replace") as log:
                stamp = ("", "", "")
                for line in log.stdout:
                    line = line.rstrip("\n")
                    if line.startswith("\0"):
                        commit, when, author = line[1:].split("|", 2)
                        stamp, at = (commit, when, author), at + 1
                    elif line:
                        rows.append((at, *stamp, line))
                    if len(rows) == _BATCH:
                        yield _rows(rows, kinds, names)
                        rows = []
        yield _rows(rows, kinds, names)


class CommitSource(DataSource):
    """Options: root; commits, the number a task reads."""

    @classmethod
    def name(cls) -> str:
        return "codeloom_commits"

    def schema(self) -> str:
        return COMMITS

    def reader(self, schema: StructType) -> LogReader:
        return LogReader(self.options)


def list_files(spark: SparkSession, root: str | os.PathLike, below: str = "", prefix: str = "", only: str | None = None, suffix: str = ".py", tasks: int = TASKS, wide: int = WIDE) -> DataFrame:
    """path (relative to ``root``) and size of the files of a tree: below a directory, with a prefix, or one path."""
    spark.dataSource.register(FileSource)
    options = {"root": str(root), "below": below, "prefix": prefix, "suffix": suffix, "tasks": tasks, "wide": wide} | ({} if only is None else {"only": only})
    return spark.read.format("codeloom_files").options(**options).load()


def commits(spark: SparkSession, root: str | os.PathLike, each: int = 1000) -> DataFrame:
    """The files of each commit of a repository's log: position (0 is the newest), commit, committed, author, file_path."""
    spark.dataSource.register(CommitSource)
    return spark.read.format("codeloom_commits").options(root=str(root), commits=each).load()


def last_commits(log: DataFrame) -> DataFrame:
    """file_path, last_modified and git_author of each file's newest commit."""
    newest = log.groupBy("file_path").agg(F.min_by(F.struct("committed", "author"), "position").alias("c"))
    return newest.select("file_path", F.col("c.committed").alias("last_modified"), F.col("c.author").alias("git_author"))
