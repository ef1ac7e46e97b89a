"""The symbol store: versions of the buckets of one parquet table, named by numbered pointer files."""

from __future__ import annotations

import json
import re
import time
import uuid
import zlib
from typing import Self

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.schema import SYMBOLS, VECTOR_SIZE


def last_definition(rows: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """One row for each key: the one that stands last by ``order``, by default start_line where there is one, else the rows' order in their table."""
    order = order or ("start_line" if "start_line" in rows.columns else None)
    placed = rows.withColumn("__at", F.monotonically_increasing_id())
    by = [F.col(order).desc_nulls_last()] if order else []
    return placed.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*by, F.desc("__at")))).where("__n = 1").drop("__n", "__at")


def upsert(target: DataFrame, source: DataFrame, key: str = "id") -> DataFrame:
    """``target`` with the rows of ``source`` in place of those with their keys."""
    return target.join(source.select(key).distinct(), key, "left_anti").select(*target.columns).unionByName(source.select(*target.columns))


def replace_by(target: DataFrame, source: DataFrame, column: str = "file_path", also: DataFrame | None = None) -> DataFrame:
    """``target`` without all rows of the values of ``column`` that ``source`` (and ``also``) has, and with ``source``."""
    gone = source.select(column).distinct() if also is None else source.select(column).unionByName(also.select(column)).distinct()
    return target.join(gone, column, "left_anti").select(*target.columns).unionByName(source.select(*target.columns))


def delete_by(target: DataFrame, values: DataFrame, column: str = "file_path") -> DataFrame:
    return target.join(values.select(column).distinct(), column, "left_anti").select(*target.columns)


def changed_files(files: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """Rows of files (file_path, source_hash, ...) whose hash the store doesn't hold; placed before anything expensive."""
    return files if force else files.join(stored.select("file_path", "source_hash").distinct(), ["file_path", "source_hash"], "left_anti").select(*files.columns)


def inherit_mutations(new: DataFrame, stored: DataFrame, key: str = "id", group: str = "file_path", count: str = "mutation_count") -> DataFrame:
    """``new`` with its mutation count: 0 in a group never stored before, otherwise one more than the key's own count, which is 0 for a new key."""
    before = stored.groupBy(key).agg(F.max(count).alias("__before"))
    known = stored.select(group).distinct().withColumn("__known", F.lit(True))
    joined = new.drop(count).join(before.hint("merge"), key, "left").join(known.hint("merge"), group, "left")
    value = F.when(F.col("__known"), F.coalesce("__before", F.lit(0)) + 1).otherwise(F.lit(0)).cast("bigint")
    return joined.withColumn(count, value).drop("__before", "__known")


def get_by_id(rows: DataFrame, symbol: str) -> DataFrame:
    return rows.where(F.col("id") == symbol).limit(1)


def get_by_file(rows: DataFrame, path: str) -> DataFrame:
    return rows.where(F.col("file_path") == path)


def get_by_directory(rows: DataFrame, directory: str, column: str = "file_path") -> DataFrame:
    """Rows below a directory; the whole table for the root. The prefix is literal: its _ and % match themselves only."""
    directory = directory.strip()
    if directory in ("", "/", "."):
        return rows
    return rows.where(F.col(column).startswith(directory.rstrip("/") + "/"))


BUCKETS, GROW, FEW = 64, 256 << 20, 1000
_POINTER = re.compile(r"CURRENT-(\d{12})")


class KeyedTable:
    """A table in a folder that all executors reach, split into buckets by a checksum of its key, a string.

    A write makes new files for the buckets it concerns, however large the others are, and then adds a pointer that names each bucket's version. Pointers are numbered, made once and never changed; the one with the greatest
    number that can be read counts. So a writer that stops at any point leaves the table as it was before or after, a second writer of the same number fails, and readers keep the version they opened: a table may be read and
    replaced in one plan. The last two pointers and what they name are kept. Files are sorted by key, so prefix
    and equality filters skip row groups, and a lookup reads the buckets of its keys only. When a bucket exceeds ``grow`` bytes, the number of buckets is doubled in a write of all: each row is
    rewritten so a bounded number of times, and a bucket's size, which is what a small write costs, doesn't grow with the table.
    Files go through Hadoop's file systems, not through local paths.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = BUCKETS, grow: int = GROW) -> None:
        self.spark, self.path, self.schema, self.key, self.buckets, self.grow = spark, path.rstrip("/"), schema, key, buckets, grow
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        """The numbers of all pointers, greatest first."""
        folder = self._path(self.path)
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted((int(m[1]) for m in map(_POINTER.fullmatch, names) if m), reverse=True)

    def _at(self, number: int) -> str:
        return f"{self.path}/CURRENT-{number:012d}"

    def _load(self, number: int) -> dict | None:
        """A pointer, or nothing if it can't be read: it was never finished, or is gone since."""
        try:
            file = self._fs.open(self._path(self._at(number)))
        except Py4JJavaError as e:
            if "FileNotFoundException" not in str(e.java_exception):
                raise
            return None
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")) | {"number": number}
        except ValueError:
            return None
        finally:
            file.close()

    def _pointer(self) -> dict | None:
        for _ in range(3):  # pointers that were listed may have given way to newer ones
            numbers = self._numbers()
            for number in numbers:
                if found := self._load(number):
                    self.buckets = found["buckets"]
                    return found
            if not numbers:
                break
        return None

    def bucket_of(self, key: str) -> int:
        return zlib.crc32(key.encode()) % self.buckets

    def ensure(self) -> Self:
        """Create an empty table if there is none."""
        if self._pointer() is None:
            self._add({"buckets": self.buckets, "versions": {}})
        return self

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows of all buckets, or of some."""
        versions = (self._pointer() or {"versions": {}})["versions"]
        paths = [f"{self.path}/versions/{v}/bucket={k}" for k, v in versions.items() if buckets is None or int(k) in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _add(self, pointer: dict) -> None:
        """Add the next pointer; then drop the pointers before the last two, and the versions that only these name."""
        numbers = self._numbers()
        number = max(numbers, default=0) + 1
        out = self._fs.create(self._path(self._at(number)), False)
        out.write(bytearray(json.dumps({"buckets": pointer["buckets"], "versions": pointer["versions"]}).encode()))
        out.close()
        known = {n: self._load(n) for n in numbers}
        readable = [n for n in numbers if known[n]]
        kept = set(pointer["versions"].values()).union(*[known[n]["versions"].values() for n in readable[:1]])
        for n in readable[1:]:
            for version in set(known[n]["versions"].values()) - kept:
                self._fs.delete(self._path(f"{self.path}/versions/{version}"), True)
        for n in numbers:
            if readable and n < readable[0]:
                self._fs.delete(self._path(self._at(n)), False)

    def vacuum(self, seconds: float = 86_400) -> None:
        """Drop versions that no pointer names, of writers that stopped, if they are older than that."""
        live = {v for n in self._numbers() if (p := self._load(n)) for v in p["versions"].values()}
        folder = self._path(f"{self.path}/versions")
        for status in self._fs.listStatus(folder) if live and self._fs.exists(folder) else []:
            name = status.getPath().getName()
            if name not in live and int(name.partition("-")[0]) < time.time_ns() - seconds * 1e9:
                self._fs.delete(status.getPath(), True)

    def _write(self, rows: DataFrame, concerned: list[int] | None) -> None:
        """``rows`` become all there is in the concerned buckets, or in the table."""
        before = self._pointer() or {"versions": {}}
        version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        checked = rows.select(*[F.col(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name).cast(f.dataType) for f in self.schema.fields])
        for f in self.schema.fields:
            if isinstance(f.dataType, T.ArrayType) and f.name.endswith("_vector"):
                wrong = F.raise_error(F.concat(F.lit(f"{f.name}: not {VECTOR_SIZE} numbers for "), F.col("id"))).cast("array<float>")
                checked = checked.withColumn(f.name, F.when(F.size(f.name) == VECTOR_SIZE, F.col(f.name).cast("array<float>")).otherwise(wrong))
        made = self._files(checked, version, self.buckets)
        kept = {} if concerned is None else {k: v for k, v in before["versions"].items() if int(k) not in concerned}
        pointer = {"buckets": self.buckets, "versions": kept | dict.fromkeys(made, version)}
        self._add(pointer)
        if (largest := max(made.values(), default=0)) > self.grow:
            self._double(largest)

    def _files(self, rows: DataFrame, version: str, buckets: int) -> dict[str, int]:
        """Write rows by bucket; the bytes of each bucket that has any."""
        order = [self.key, *(["id"] if self.key != "id" and "id" in self.schema.names else [])]
        placed = rows.withColumn("bucket", (F.crc32(F.col(self.key)) % buckets).cast("int")).repartition("bucket").sortWithinPartitions("bucket", *order)
        placed.write.partitionBy("bucket").parquet(f"{self.path}/versions/{version}")
        folders = [x.getPath() for x in self._fs.listStatus(self._path(f"{self.path}/versions/{version}")) if x.isDirectory()]
        return {x.getName().removeprefix("bucket="): self._fs.getContentSummary(x).getLength() for x in folders}

    def _double(self, largest: int) -> None:
        """Write the table in twice as many buckets, or as many times twice as the largest one asks for."""
        while largest > self.grow:
            self.buckets, largest = self.buckets * 2, largest // 2
        buckets, rows = self.buckets, self.read()  # reading takes the number from the pointer
        version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        made = self._files(rows, version, buckets)
        self.buckets = buckets
        self._add({"buckets": buckets, "versions": dict.fromkeys(made, version)})

    def _bucket(self) -> Column:
        return (F.crc32(F.col(self.key)) % self.buckets).cast("int")

    def _concerned(self, *tables: DataFrame | None) -> list[int]:
        """The buckets of the tables' keys: as many numbers as there are buckets, at most."""
        self._pointer()
        return sorted({r.b for t in tables if t is not None for r in t.select(self._bucket().alias("b")).distinct().collect()})

    def exists(self) -> bool:
        return self._pointer() is not None

    def get(self, keys: DataFrame) -> DataFrame:
        """The rows of the keys in ``keys`` (its column of the key's name), out of their buckets; the filter of FEW keys goes down to the scan."""
        wanted = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        few = [r[0] for r in wanted.limit(FEW + 1).collect()]
        if len(few) <= FEW:
            self._pointer()
            return self.read(sorted({self.bucket_of(k) for k in few})).where(F.col(self.key).isin(few))
        return self.read(self._concerned(wanted)).join(wanted, self.key, "left_semi").select(*self.schema.names)

    def replace(self, rows: DataFrame, emptied: DataFrame | None = None) -> None:
        """All rows of the keys in ``rows`` (and ``emptied``) give way to ``rows``, in one write."""
        if concerned := self._concerned(rows, emptied):
            self._write(replace_by(self.read(concerned), rows.select(*self.schema.names), self.key, emptied), concerned)

    def change(self, added: DataFrame, removed: DataFrame) -> None:
        """Whole rows come and go, in one write; a row is never there twice."""
        if concerned := self._concerned(added, removed):
            names = self.schema.names
            self._write(self.read(concerned).join(removed.select(*names).distinct(), names, "left_anti").unionByName(added.select(*names)).distinct(), concerned)


class SymbolStore(KeyedTable):
    """The symbol table: a KeyedTable by file path, with rows that are named by id."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType = SYMBOLS, buckets: int = BUCKETS, grow: int = GROW) -> None:
        super().__init__(spark, path, schema, "file_path", buckets, grow)

    def upsert(self, rows: DataFrame) -> None:
        """Insert or replace by id; the last definition of an id wins, no rows change nothing."""
        if concerned := self._concerned(rows):
            self._write(upsert(self.read(concerned), last_definition(rows)), concerned)

    def delete_by_file(self, path: str) -> None:
        own = [self.bucket_of(path)]
        self._write(self.read(own).where(F.col("file_path") != path), own)

    def replace_files(self, rows: DataFrame, emptied: DataFrame | None = None) -> None:
        """All rows of the files in ``rows`` (and ``emptied``) give way to ``rows``, in one write."""
        if concerned := self._concerned(rows, emptied):
            self._write(replace_by(self.read(concerned), last_definition(rows), also=emptied), concerned)

    def prune(self, paths: DataFrame) -> None:
        """Drop the rows of files that aren't among ``paths`` (column path); buckets without such files stay as they are."""
        known = paths.select(F.col("path").alias("file_path")).distinct()
        if concerned := self._concerned(self.read().select("file_path").join(known, "file_path", "left_anti")):
            self._write(self.read(concerned).join(known, "file_path", "left_semi"), concerned)

    def get_by_id(self, symbol: str) -> DataFrame:
        self._pointer()
        return get_by_id(self.read([self.bucket_of(symbol.partition("::")[0])]), symbol)

    def get_by_file(self, path: str) -> DataFrame:
        self._pointer()
        return get_by_file(self.read([self.bucket_of(path)]), path)

    def get_by_directory(self, directory: str) -> DataFrame:
        return get_by_directory(self.read(), directory)

    def search(self, vector: list[float], column: str, top_k: int = 10) -> DataFrame:
        from codeloom.operators.vector import knn

        return knn(self.read(), vector, column, top_k)
