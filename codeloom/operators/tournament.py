"""Rankings of any number of options by a model that orders a few at a time.

A sample sort whose comparisons are prompts of ``most`` options. In each round, every group of more than ``most`` options gets pivots, half as many as a prompt holds, chosen by a hash; one prompt orders the pivots, and each other option is placed between them by a prompt that holds the pivots and
as many others as there is room for. So a group falls into one more group than it has pivots, and rounds follow the logarithm of its size. Groups that fit a prompt are ordered by one. What comes out is one order for each ranking; with answers that agree with each other it is theirs, and each prompt holds a bounded
text however many options there are.

Prompts of a round are made by tasks from options dealt by group and a hash, so a ranking with most of the options is spread, and asked through ``semantic.generate``. Where an answer leaves options out or names them twice, its first mentions count and what is missing follows in the order given; where a
prompt fails, its options stay in the order given, and ``failed`` counts it for its ranking. Equal options are options of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.checkpoints import checkpointed
from codeloom.operators import semantic

MOST, SALTS = 20, 64
_OPTION = re.compile(r"^\s*\d+\.\s*OPTION (\d+)", re.MULTILINE)
PROMPTS = "ranking string, place string, criteria string, ids array<string>, pivots int, content string"
PLACED = "ranking string, place string, id string"


def order_of(answer: str | None, n: int) -> list[int]:
    """The options of an answer from 0, best first: all of them, each once."""
    found = list(dict.fromkeys(k for k in (int(x) - 1 for x in _OPTION.findall(answer or "")) if 0 <= k < n))
    return found + sorted(set(range(n)) - set(found))


def _content(criteria: str, texts: list[str]) -> str:
    return f"CRITERIA\n{criteria}\n" + "\n".join(f"OPTION {k}:\n{t}" for k, t in enumerate(texts, 1))


def _prompts(options: DataFrame, pivots: DataFrame | None, most: int) -> DataFrame:
    """Prompts (PROMPTS) for options (ranking, place, criteria, id, text): of one group and at most ``most``, the group's pivots among them. A group without pivots fits one prompt and isn't spread."""
    if pivots is None:
        rows = options.withColumns({"salt": F.lit(0), "pivot_ids": F.array().cast("array<string>"), "pivot_texts": F.array().cast("array<string>")})
    else:
        rows = options.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(pivots, ["ranking", "place"])
    form = pa.schema([("ranking", pa.string()), ("place", pa.string()), ("criteria", pa.string()), ("ids", pa.list_(pa.string())), ("pivots", pa.int32()), ("content", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def made() -> list[dict]:
            if not held:
                return []
            first = held[0]
            texts = [*first["pivot_texts"], *[r["text"] for r in held]]
            return [{"ranking": key[0], "place": key[1], "criteria": first["criteria"], "ids": [*first["pivot_ids"], *[r["id"] for r in held]], "pivots": len(first["pivot_ids"]), "content": _content(first["criteria"], texts)}]

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                own = row["ranking"], row["place"], row["salt"]
                if own != key or len(held) + len(row["pivot_ids"]) >= most:
                    out += made()
                    key, held = own, []
                held.append(row)
            yield pa.RecordBatch.from_pylist(out, form)
        yield pa.RecordBatch.from_pylist(made(), form)

    dealt = rows.select("ranking", "place", "salt", "criteria", "id", "text", "pivot_ids", "pivot_texts").repartition("ranking", "place", "salt").sortWithinPartitions("ranking", "place", "salt", "id")
    return dealt.mapInArrow(run, PROMPTS)


def _code(k: int) -> str:
    return f"{k:06d}"


def _placed(asked: DataFrame, between: bool) -> DataFrame:
    """ranking, place and id of the options that aren't pivots, after the answers: ``between`` the pivots, by how many stand before, or in the answer's order."""
    form = pa.schema([("ranking", pa.string()), ("place", pa.string()), ("id", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                ids, n = row["ids"], row["pivots"]
                order = order_of(row["text"], len(ids))
                if not between:
                    out += [{"ranking": row["ranking"], "place": row["place"] + _code(k), "id": ids[x]} for k, x in enumerate(order)]
                    continue
                before = 0
                for x in order:
                    before += x < n
                    if x >= n:
                        out.append({"ranking": row["ranking"], "place": row["place"] + _code(2 * before), "id": ids[x]})
            yield pa.RecordBatch.from_pylist(out, form)

    return asked.select("ranking", "place", "ids", "pivots", F.col("answer.text").alias("text")).mapInArrow(run, PLACED)


def rank_many(options: DataFrame, client: semantic.ModelClient, most: int = MOST, model: str = semantic.RANK_MODEL) -> DataFrame:
    """ranking, id, rank (from 1, best first) and failed, the number of the ranking's prompts that had no answer, for options (ranking, criteria, id, text): strings; ids are distinct in a ranking, nulls of the others count as empty."""
    if most < 4:
        raise ValueError("a prompt must hold four options at least")
    blank = F.lit("")
    rows = options.select(*[F.coalesce(F.col(c).cast("string"), blank).alias(c) for c in ("ranking", "criteria", "id", "text")]).withColumn("place", blank)
    rows, done, failed = checkpointed(rows), None, []

    def asked(prompts: DataFrame) -> DataFrame:
        found = checkpointed(semantic.generate(prompts, F.col("content"), client, semantic.PROMPTS["rank"], model))
        failed.append(found.where("answer.error IS NOT NULL").select("ranking"))
        return found

    while True:
        sizes = rows.groupBy("ranking", "place").count()
        small = rows.join(sizes.where(F.col("count") <= most), ["ranking", "place"], "left_semi")
        ready = _placed(asked(_prompts(small, None, most)), False)
        done = checkpointed(ready) if done is None else done.unionByName(checkpointed(ready))
        rows = checkpointed(rows.join(sizes.where(F.col("count") > most), ["ranking", "place"], "left_semi"))
        if rows.isEmpty():
            break
        mark = F.xxhash64("ranking", "place", "id")
        near = Window.partitionBy("ranking", "place", "salt").orderBy("mark", "id")
        first = rows.withColumns({"mark": mark, "salt": F.pmod(F.hash("id"), F.lit(SALTS))}).withColumn("n", F.row_number().over(near)).where(F.col("n") <= most // 2)
        chosen = first.withColumn("n", F.row_number().over(Window.partitionBy("ranking", "place").orderBy("mark", "id"))).where(F.col("n") <= most // 2)
        chosen = checkpointed(chosen.select("ranking", "place", "criteria", "id", "text"))
        ordered = checkpointed(_placed(asked(_prompts(chosen, None, most)), False))
        width = len(_code(0))
        ordered = ordered.select("ranking", F.expr(f"left(place, length(place) - {width})").alias("place"), "id", F.expr(f"cast(right(place, {width}) AS int)").alias("k"))
        done = done.unionByName(ordered.select("ranking", F.concat("place", F.lpad((F.col("k") * 2 + 1).cast("string"), width, "0")).alias("place"), "id"))
        texts = ordered.join(chosen.select("ranking", "place", "id", "text"), ["ranking", "place", "id"]).groupBy("ranking", "place").agg(F.array_sort(F.collect_list(F.struct("k", "id", "text"))).alias("p"))
        pivots = checkpointed(texts.select("ranking", "place", F.col("p.id").alias("pivot_ids"), F.col("p.text").alias("pivot_texts")))
        others = rows.join(chosen, ["ranking", "place", "id"], "left_anti")
        moved = checkpointed(_placed(asked(_prompts(others, pivots, most)), True))
        rows = checkpointed(moved.join(rows.drop("place"), ["ranking", "id"]).select("ranking", "criteria", "id", "text", "place"))
    missed = None
    for f in failed:
        missed = f if missed is None else missed.unionByName(f)
    missed = missed.groupBy("ranking").agg(F.count("*").alias("failed"))
    return numbered(done).join(missed, "ranking", "left").select("ranking", "id", "rank", F.coalesce("failed", F.expr("0L")).alias("failed"))


def numbered(placed: DataFrame) -> DataFrame:
    """ranking, id and rank, in order of the place: ranges are numbered by themselves and moved by the counts of those before, so no task sorts a whole ranking."""
    ranged = checkpointed(placed.repartitionByRange("ranking", "place", "id").withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("ranking").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("ranking", "part").count().withColumn("start", F.coalesce(F.sum("count").over(before), F.expr("0L"))).drop("count")
    own = F.row_number().over(Window.partitionBy("ranking", "part").orderBy("place", "id"))
    return ranged.withColumn("own", own).join(starts, ["ranking", "part"]).select("ranking", "id", (F.col("start") + F.col("own")).alias("rank"))
