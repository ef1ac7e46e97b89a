"""Import statements and what they mean, kept in tables so that an edit costs what it touches.

An ``ImportIndex`` has one row for each file - its hash, its statements, the modules they name and the files these mean - and two inverted indexes: ``waiting``, from a path to the modules that would mean it if it were there, and
``users``, from a module to the files that import it. All are KeyedTables, so a lookup reads the buckets of its keys. A change of a file's text parses that file and resolves its modules. A path that comes or goes also resolves the
modules that wait for it, in the files that use them. Only where an ``__init__.py`` comes or goes are keys of all files scanned: packages below it get other names, and top packages are found again.

Updates may be run again: what they write follows from the files as they are. A note of the paths of an update lies beside the tables from before its first write until after its last; ``unfinished`` gives it to the next user, who passes those files again.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.checkpoints import checkpointed
from codeloom.operators import extract
from codeloom.operators.store import KeyedTable
from codeloom.sources.files import delete_file, read_file, replace_file

STATEMENT = "struct<pos:int,module:string,level:int,names:array<string>,is_from:boolean>"
FILE_ROWS = f"file_path string, source_hash string, statements array<{STATEMENT}>, modules array<string>, links array<struct<module:string,target:string>>"
WAITING, USERS, ROOTS = "path string, module string", "module string, file_path string", "name string, prefix string"
#: To begin with: a table doubles them when a bucket grows large.
BUCKETS = 8


def _schema(fields: str) -> T.StructType:
    return T.StructType.fromDDL(fields)


def _initial(path: Column) -> Column:
    return path.rlike(r"(^|/)__init__\.py$")


class ImportIndex:
    """The import tables of one repository, in a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        table = lambda name, fields, key: KeyedTable(spark, f"{self.path}/{name}", _schema(fields), key, buckets)
        self.files, self.waiting, self.users = table("files", FILE_ROWS, "file_path"), table("waiting", WAITING, "path"), table("users", USERS, "module")
        self.roots = KeyedTable(spark, f"{self.path}/roots", _schema(ROOTS), "name", 1)

    def exists(self) -> bool:
        return self.files.exists()

    def ensure(self) -> ImportIndex:
        for t in (self.files, self.waiting, self.users, self.roots):
            t.ensure()
        return self

    def links(self) -> DataFrame:
        """file_path, module and target of all files."""
        return self.files.read().select("file_path", F.inline("links"))

    def edges(self, paths: DataFrame | None = None) -> DataFrame:
        """Distinct (src, dst); of the files in ``paths`` (column file_path) only, if given."""
        rows = self.files.read() if paths is None else self.files.get(paths)
        return extract.import_edges(rows.select("file_path", F.inline("links")))

    def unfinished(self) -> list[str]:
        """The paths of an update that stopped half-way."""
        return json.loads(read_file(self.spark, f"{self.path}/PENDING") or "[]")

    def differing(self, files: DataFrame) -> DataFrame:
        """Rows of ``files`` (path, content, source_hash) that the tables don't have as they are, or of which an update stopped half-way."""
        known = self.files.read().select(F.col("file_path").alias("path"), "source_hash")
        if again := self.unfinished():
            known = known.where(~F.col("path").isin(again))
        return files.join(known, ["path", "source_hash"], "left_anti").select(*files.columns)

    def _known(self, paths: DataFrame) -> DataFrame:
        """Those of ``paths`` (column path) that the tables have."""
        return self.files.get(paths.select(F.col("path").alias("file_path"))).select(F.col("file_path").alias("path"))

    def _anchored(self, statements: DataFrame, come: DataFrame, gone: DataFrame) -> DataFrame:
        """file_path, module and pos of files' statements, given by rows (file_path, statements), with what is in the tables, comes and goes."""
        flat = checkpointed(statements.select("file_path", F.inline("statements")))
        own = flat.select(F.col("file_path").alias("path")).distinct()
        above = own.select(F.explode(extract.derive_package_roots(F.col("path"))).alias("d")).distinct().select(F.when(F.col("d") == "", "__init__.py").otherwise(F.concat("d", F.lit("/__init__.py"))).alias("path"))
        there = self._known(above).unionByName(come.join(above, "path", "left_semi")).join(gone, "path", "left_anti")
        near = checkpointed(own.unionByName(there).distinct())
        return extract.absolute_imports(flat, extract.packages_of_files(near).join(own, "path", "left_semi"))

    def update(self, changed: DataFrame, gone: DataFrame | None = None) -> DataFrame:
        """Take files (path, content, source_hash; a null content has no statements) as they are now, and forget those of ``gone`` (column path). Gives file_path of all whose links may differ, the gone ones too; checkpointed."""
        self.ensure()
        changed = checkpointed(changed.select("path", "content", "source_hash"))
        given = changed.select("path")
        gone = checkpointed(given.limit(0) if gone is None else self._known(gone.select("path").distinct()).join(given, "path", "left_anti"))
        come = checkpointed(given.join(self._known(given), "path", "left_anti"))
        touched = given.unionByName(gone)
        names = [r.path for r in touched.limit(10_001).collect()]
        if len(names) <= 10_000:  # a larger update is one of the whole repository, which passes every file again by its hash
            replace_file(self.spark, f"{self.path}/PENDING", json.dumps(sorted({*names, *self.unfinished()})).encode())

        own_form = F.struct("pos", "module", "level", "names", "is_from")
        parsed = extract.extract_imports(changed.where(F.col("content").isNotNull())).groupBy("file_path").agg(F.array_sort(F.collect_list(own_form)).alias("statements"))
        empty = F.array().cast(f"array<{STATEMENT}>")
        new = checkpointed(changed.select(F.col("path").alias("file_path"), "source_hash").join(parsed, "file_path", "left").withColumn("statements", F.coalesce("statements", empty)))

        initials = checkpointed(come.unionByName(gone).where(_initial(F.col("path"))).select(F.regexp_replace("path", r"/?__init__\.py$", "").alias("d")))
        roots, moved = self.roots.read(), None
        if not initials.isEmpty():
            held = self.files.read().select("file_path", "source_hash", "statements").join(touched.withColumnRenamed("path", "file_path"), "file_path", "left_anti")
            relative = held.where(F.exists("statements", lambda x: x.level > 0))
            below = relative.withColumn("d", F.explode(extract.derive_package_roots(F.col("file_path")))).join(initials, "d", "left_semi").drop("d").distinct()
            new = checkpointed(new.unionByName(below))
            packages = self.files.read().select(F.col("file_path").alias("path")).join(gone, "path", "left_anti").unionByName(come).where(_initial(F.col("path")))
            roots = checkpointed(extract.package_roots(packages))
            before = self.roots.read()
            moved = checkpointed(roots.exceptAll(before).unionByName(before.exceptAll(roots)).select("name").distinct())

        modules = checkpointed(self._anchored(new.select("file_path", "statements"), come, gone))
        fresh = new.select("file_path")
        shifted = self.waiting.get(come.unionByName(gone)).select("module")
        if moved is not None and not moved.isEmpty():
            shifted = shifted.unionByName(self.users.read().join(moved, F.substring_index("module", ".", 1) == F.col("name"), "left_semi").select("module"))
        shifted = checkpointed(shifted.distinct())
        mine = modules.select("module").distinct()
        asked = checkpointed(mine.unionByName(shifted).distinct())
        candidates = checkpointed(extract.import_candidates(asked, roots))
        there = self._known(candidates.select("path").distinct()).unionByName(come.join(candidates, "path", "left_semi")).join(gone, "path", "left_anti")
        meant = checkpointed(extract.first_matches(candidates, there))

        linked = modules.join(meant, "module", "left").groupBy("file_path").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "module"))), lambda x: x.module).alias("modules"),
            F.array_sort(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("module", "target")))).alias("links"),
        )
        none = {"modules": F.array().cast("array<string>"), "links": F.array().cast("array<struct<module:string,target:string>>")}
        rows = new.join(linked, "file_path", "left").withColumns({c: F.coalesce(c, v) for c, v in none.items()})
        rows = rows.select(*self.files.schema.names)
        if not shifted.isEmpty():
            rows = rows.unionByName(self._patched(shifted, meant, fresh.unionByName(gone.withColumnRenamed("path", "file_path"))))
        rows = checkpointed(rows)

        before = self.files.get(fresh.unionByName(gone.withColumnRenamed("path", "file_path"))).select(F.explode("modules").alias("module"), "file_path").distinct()
        after = modules.select("module", "file_path").distinct()
        used = checkpointed(after.join(before, ["module", "file_path"], "left_anti"))
        unused = checkpointed(before.join(after, ["module", "file_path"], "left_anti"))
        unheard = asked if moved is not None else used.select("module").distinct().join(self.users.get(used.select("module")).select("module"), "module", "left_anti")
        self.waiting.change(candidates.join(unheard, "module", "left_semi").select("path", "module").distinct(), candidates.limit(0))
        self.users.change(used, unused)
        if moved is not None:
            self.roots.replace(roots, moved)
        self.files.replace(rows, gone.withColumnRenamed("path", "file_path"))
        delete_file(self.spark, f"{self.path}/PENDING")
        return checkpointed(rows.select("file_path").unionByName(gone.withColumnRenamed("path", "file_path")).distinct())

    def _patched(self, shifted: DataFrame, meant: DataFrame, taken: DataFrame) -> DataFrame:
        """The rows of the files that use one of the modules ``shifted``, but for those in ``taken``, with the links of these modules as in ``meant``."""
        held = self.files.get(self.users.get(shifted).select("file_path").distinct().join(taken, "file_path", "left_anti"))
        none = F.array().cast("array<struct<module:string,target:string>>")
        again = held.select("file_path", F.explode("modules").alias("module")).join(shifted, "module", "left_semi").join(meant, "module")
        again = again.groupBy("file_path").agg(F.collect_list(F.struct("module", "target")).alias("found"))
        stay = held.select("file_path", F.explode("links").alias("l")).join(shifted, F.col("l.module") == F.col("module"), "left_anti").groupBy("file_path").agg(F.collect_list("l").alias("kept"))
        patched = held.join(again, "file_path", "left").join(stay, "file_path", "left").withColumn("links", F.array_sort(F.concat(F.coalesce("kept", none), F.coalesce("found", none))))
        return patched.select(*self.files.schema.names)
