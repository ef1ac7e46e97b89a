"""Answers of a model that outlast the task, the session and the driver that asked.

``AnswerStore`` is a table of answers by request - a hash of model, prompt, options and content - and a journal beside it. ``generate`` asks for what the table lacks, each distinct request once. A task writes what it has got to the journal after each round of open requests, before it asks
on; when it is made again, it reads its journal first. So a lost task asks at most its open requests again, and a lost driver none that was journaled: the next call takes the journals it finds into the table. Failed requests are given back with their error and not stored, so the next call asks them again.

A rate of requests a minute holds for all tasks together: each takes an even share of it for the tasks that run at a time. One driver writes at a time, as with any KeyedTable.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.checkpoints import checkpointed
from codeloom.operators import semantic
from codeloom.operators.store import KeyedTable

ANSWER = f"request string, {semantic.RESULT}"
_FORM = pa.schema([(x.split()[0], {"string": pa.string(), "bigint": pa.int64(), "array<string>": pa.list_(pa.string())}[x.split()[1]]) for x in ANSWER.split(", ")])


class Pace:
    """So many calls a minute, evenly; no bound if None. Threads of a task take their turns from one."""

    def __init__(self, per_minute: float | None, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.gap, self.next, self.now, self.sleep = 60.0 / per_minute if per_minute else 0.0, 0.0, now, sleep

    def turn(self) -> float:
        """When the next call may begin."""
        self.next = max(self.next, self.now()) + self.gap
        return self.next - self.gap

    def wait(self, at: float) -> None:
        if (left := at - self.now()) > 0:
            self.sleep(left)


class Journal:
    """What the tasks of one call have got, in files of a folder that driver and executors share: one for each round, named by partition, so that a task made again finds its own."""

    def __init__(self, folder: str, call: str) -> None:
        self.files, root = fs.FileSystem.from_uri(re.sub("^file:/+", "/", folder.replace("s3a://", "s3://")))
        self.root = f"{root}/{call}"

    def read(self, part: int) -> dict[str, dict]:
        """The answers of all attempts of a partition; a file that was never finished is left out."""
        found: dict[str, dict] = {}
        for info in self.files.get_file_info(fs.FileSelector(self.root, allow_not_found=True)):
            if info.base_name.startswith(f"{part}-") and info.base_name.endswith(".jsonl"):
                with self.files.open_input_stream(info.path) as file:
                    for line in file.read().decode().splitlines():
                        row = json.loads(line)
                        found[row["request"]] = row
        return found

    def write(self, part: int, rows: list[dict]) -> None:
        """Rows of one round, under a name that others read only when it is whole."""
        self.files.create_dir(self.root, recursive=True)
        staged = f"{self.root}/{part}-{uuid.uuid4().hex}"
        with self.files.open_output_stream(f"{staged}.open") as file:
            file.write("".join(json.dumps(r) + "\n" for r in rows).encode())
        self.files.move(f"{staged}.open", f"{staged}.jsonl")


class AnswerStore:
    """Answers by request in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.table = KeyedTable(spark, f"{self.path}/answers", T.StructType.fromDDL(ANSWER), "request", buckets).ensure()
        self.journals = f"{self.path}/journals"

    def _folder(self) -> Any:
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.journals)

    def recover(self) -> int:
        """Take journals into the table and drop them; how many calls they are of."""
        folder = self._folder()
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        calls = [x.getPath() for x in files.listStatus(folder)] if files.exists(folder) else []
        if calls:
            rows = self.spark.read.schema(ANSWER).option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").json([c.toString() for c in calls])
            self.keep(rows)
        for call in calls:
            files.delete(call, True)
        return len(calls)

    def keep(self, rows: DataFrame) -> None:
        """Store answers; one of each request."""
        self.table.replace(rows.where("error IS NULL AND request IS NOT NULL").dropDuplicates(["request"]))


def requests_of(content: Column, prompt: str, model: str, options: dict[str, Any]) -> Column:
    """The hash that names a request."""
    same = hashlib.sha256(json.dumps([model, prompt, options], sort_keys=True).encode()).hexdigest()
    return F.sha2(F.concat(F.lit(same), F.coalesce(content, F.lit(""))), 256)


def generate(rows: DataFrame, content: Column, client: semantic.ModelClient, prompt: str, store: AnswerStore, model: str = semantic.SCORE_MODEL, concurrency: int = semantic.CONCURRENCY, per_minute: float | None = None, tasks: int | None = None, **options: Any) -> DataFrame:
    """``rows`` with the struct ``answer`` of semantic.RESULT, from the store or asked now; null content counts as empty, and equal requests are asked once."""
    if not model.startswith("gpt-"):
        raise ValueError(f"unknown model: {model}")
    store.recover()
    spark = rows.sparkSession
    named = rows.withColumn("__request", requests_of(content, prompt, model, options))
    asked = named.groupBy(F.col("__request").alias("request")).agg(F.first(F.coalesce(content, F.lit(""))).alias("content"))
    missing = checkpointed(asked.join(store.table.read().select("request"), "request", "left_anti"))
    call, journals = uuid.uuid4().hex, store.journals
    tasks = tasks or max(1, min(missing.count(), spark.sparkContext.defaultParallelism))
    share = per_minute / min(tasks, spark.sparkContext.defaultParallelism) if per_minute else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        journal, part, pace = Journal(journals, call), TaskContext.get().partitionId(), Pace(share)
        had = journal.read(part)

        def one(given: tuple[str, str, float]) -> dict:
            request, text, at = given
            pace.wait(at)
            row = dict.fromkeys(_FORM.names) | {"request": request, "model": model}
            try:
                got = semantic.with_retries(lambda: client.generate(semantic.Request(prompt, text, model, **options)))
            except Exception as e:
                return row | {"error": f"{type(e).__name__}: {e}"}
            return row | {"text": got.texts[0], "structured": semantic._structured(got.texts[0], options.get("form")), "texts": got.texts, **got.usage}

        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                given = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
                if known := [had[r] for r, _ in given if r in had]:
                    yield pa.RecordBatch.from_pylist(known, _FORM)
                still = [x for x in given if x[0] not in had]
                for first in range(0, len(still), concurrency):
                    found = list(pool.map(one, [(r, t, pace.turn()) for r, t in still[first : first + concurrency]]))
                    if good := [x for x in found if x["error"] is None]:
                        journal.write(part, good)
                    yield pa.RecordBatch.from_pylist(found, _FORM)

    answered = checkpointed(missing.repartition(tasks, "request").mapInArrow(run, ANSWER))
    store.keep(answered)
    store.recover()  # its own journal: all of it is in the table by now
    failed = answered.where("error IS NOT NULL")
    found = store.table.read().unionByName(failed)
    result = F.struct(*[x.split()[0] for x in semantic.RESULT.split(", ")])
    return named.join(found.select(F.col("request").alias("__request"), result.alias("answer")), "__request", "left").select(*rows.columns, "answer")
