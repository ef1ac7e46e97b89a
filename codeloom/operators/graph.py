"""The import graph as two tables: nodes (file_path) and edges (src, dst), where src imports dst.

Neighbour questions are filters. Reachability, strong components and topological layers have two ways: a graph of at most SMALL edges, a size that is checked, is solved by one task
in memory; a larger one by rounds of joins whose results are checkpointed.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.checkpoints import checkpointed
from codeloom.operators import _small
from codeloom.schema import EDGES, NODES
from codeloom.sources.files import replace_file

SMALL = 200_000


class CycleError(ValueError):
    """A topological order was asked of a graph with a cycle."""


def is_small(edges: DataFrame, most: int = SMALL) -> bool:
    return edges.limit(most + 1).count() <= most


def _in_one_task(edges: DataFrame, solve: Callable[[list[tuple[str, str]]], list[tuple]], schema: str) -> DataFrame:
    """For graphs whose size was checked."""
    form = pa.schema([(name, pa.int32() if kind == "int" else pa.string()) for name, kind in (x.split() for x in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = [e for b in batches for e in zip(*[c.to_pylist() for c in b.columns], strict=True)]
        yield pa.RecordBatch.from_pylist([dict(zip(form.names, row, strict=True)) for row in solve(every)], form)

    return edges.select("src", "dst").distinct().coalesce(1).mapInArrow(run, schema)


def flipped(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def direct_imports(edges: DataFrame, path: str) -> DataFrame:
    return edges.where(F.col("src") == path).select(F.col("dst").alias("file_path")).distinct()


def direct_importers(edges: DataFrame, path: str) -> DataFrame:
    return edges.where(F.col("dst") == path).select(F.col("src").alias("file_path")).distinct()


def descendants(edges: DataFrame, path: str, small: int = SMALL) -> DataFrame:
    """file_path of all that a file imports, directly or not, without itself; no rows for a file the graph doesn't know."""
    edges = checkpointed(edges.select("src", "dst").distinct())
    if is_small(edges, small):
        return _in_one_task(edges, lambda e: [(x,) for x in sorted(_small.reached(e, path) - {path})], NODES)
    seen = front = checkpointed(edges.where(F.col("src") == path).select(F.col("dst").alias("node")).distinct())
    while not front.isEmpty():
        front = checkpointed(front.join(edges, front.node == edges.src).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
        seen = seen.unionByName(front)
    return seen.where(F.col("node") != path).select(F.col("node").alias("file_path"))


def ancestors(edges: DataFrame, path: str, small: int = SMALL) -> DataFrame:
    """file_path of all that import a file, directly or not: what a change of it may touch."""
    return descendants(flipped(edges), path, small)


def closure(edges: DataFrame) -> DataFrame:
    """All pairs (src, dst) joined by a path of one edge or more: by nature up to the square of the number of nodes.

    Paths double in each round, and only pairs found in the round before are joined: with all on either side.
    """
    pairs = front = checkpointed(edges.select("src", "dst").distinct())
    while not front.isEmpty():
        after = front.alias("a").join(pairs.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))
        before = pairs.alias("a").join(front.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))
        front = checkpointed(after.unionByName(before).distinct().join(pairs, ["src", "dst"], "left_anti"))
        pairs = pairs.unionByName(front)
    return pairs


TRIMS, WORTH = 8, 0.05


def _trimmed(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Edges between nodes that have edges both in and out, after up to TRIMS rounds, as long as a round takes WORTH of the nodes, and the nodes left out: each a component by itself."""
    alone = None
    for _ in range(TRIMS):
        ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
        degrees = checkpointed(ends.groupBy("node").agg(F.max("out").alias("out"), F.max("in").alias("in")))
        gone = degrees.where("out = 0 OR in = 0").select("node")
        many, all_nodes = degrees.agg(F.count_if(F.expr("out = 0 OR in = 0")), F.count("*")).first()
        if not many or many < WORTH * all_nodes:
            break
        alone = gone if alone is None else alone.unionByName(gone)
        left = checkpointed(edges.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
        ended = degrees.join(gone, "node", "left_anti").select("node").join(left.select(F.col("src").alias("node")).union(left.select("dst")), "node", "left_anti")
        alone, edges = alone.unionByName(checkpointed(ended)), left
    return edges, alone


def chains(edges: DataFrame) -> DataFrame | None:
    """node, start, first, length and low of the nodes with one edge in and one out, if they are WORTH of all: the node that their chain hangs on, the chain's first node, and how far it is from the start (by the sum of ``length``). On a ring of such nodes only, start is null and low its least node.

    Each node points back along its chain, and then at what that points at, twice as far in each round: rounds follow the logarithm of the longest chain. ``edges`` are distinct (src, dst, length) without loops.
    """
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    degrees = checkpointed(ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("in").alias("in")))
    inner = degrees.where("out = 1 AND in = 1").select("node")
    n, all_nodes = inner.count(), degrees.count()
    if not n or n < WORTH * all_nodes:
        return None
    state = inner.join(edges, F.col("node") == F.col("dst")).select("node", F.col("src").alias("at"), F.col("node").alias("first"), F.col("length").cast("bigint").alias("length"), F.col("node").alias("low"))
    state = checkpointed(state.join(inner.select(F.col("node").alias("at"), F.lit(True).alias("moves")), "at", "left").select("node", "at", "first", "length", "low", F.coalesce("moves", F.lit(False)).alias("moves")))
    for _ in range(n.bit_length() + 1):
        if state.where("moves").isEmpty():
            break
        far = state.select(F.col("node").alias("at"), F.col("at").alias("to"), F.col("first").alias("f"), F.col("length").alias("l"), F.col("low").alias("w"), F.col("moves").alias("m"))
        further = state.where("moves").join(far, "at").select("node", F.col("to").alias("at"), F.col("f").alias("first"), (F.col("length") + F.col("l")).alias("length"), F.least("low", "w").alias("low"), F.col("m").alias("moves"))
        state = checkpointed(state.where("NOT moves").unionByName(further))
    return state.select("node", F.when(~F.col("moves"), F.col("at")).alias("start"), "first", "length", "low")


def _contracted(edges: DataFrame, found: DataFrame) -> DataFrame:
    """src, dst and length between the nodes that are on no chain, the longest of several; and first, the first node of the chain that an edge stands for, or null."""
    kept = edges.join(found.select(F.col("node").alias("dst")), "dst", "left_anti")  # into nodes on no chain
    back = found.select(F.col("node").alias("src"), "start", "first", F.col("length").alias("before"))
    return checkpointed(kept.join(back, "src", "left").select(F.coalesce("start", "src").alias("src"), "dst", (F.col("length") + F.coalesce("before", F.lit(0))).alias("length"), "first"))


def strong_components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """node and component (its least node) of every node with an edge.

    Of a larger graph, what has no edges in or out is trimmed, and chains are contracted, again while that takes a share of the nodes; what is left is coloured in rounds.
    """
    edges = checkpointed(edges.select("src", "dst").distinct())
    if is_small(edges, small):
        return _in_one_task(edges, lambda e: sorted(_small.strong_components(e).items()), "node string, component string")
    every = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    inner, passes = edges.where("src <> dst"), []
    while True:
        inner, _ = _trimmed(inner)
        found = chains(inner.withColumn("length", F.lit(1)))
        if found is None:
            break
        joined = _contracted(inner.withColumn("length", F.lit(1)), found)
        passes.append((found, joined.where("first IS NOT NULL").select("first", F.col("dst").alias("end"))))
        inner = checkpointed(joined.where("src <> dst").select("src", "dst").distinct())
    labels = _coloured(inner)
    for found, ended in reversed(passes):
        labels = checkpointed(labels)
        at = found.where("start IS NOT NULL").join(ended, "first").select("node", "start", "end")
        at = at.join(labels.select(F.col("node").alias("start"), F.col("colour").alias("a")), "start", "left").join(labels.select(F.col("node").alias("end"), F.col("colour").alias("b")), "end", "left")
        same = F.coalesce("a", "start") == F.coalesce("b", "end")
        inside = at.where(same).select("node", F.coalesce("a", "start").alias("colour"))
        heads = at.where(same & F.col("a").isNull()).select(F.col("start").alias("node"), F.col("start").alias("colour")).distinct()
        rings = found.where("start IS NULL").select("node", F.col("low").alias("colour"))
        labels = labels.unionByName(inside).unionByName(heads).unionByName(rings)
    labels = checkpointed(labels)
    least = labels.groupBy("colour").agg(F.min("node").alias("component"))
    named = labels.join(least, "colour").select(F.col("node").alias("own"), "component")
    return every.join(named, F.col("node") == F.col("own"), "left").select("node", F.coalesce("component", "node").alias("component"))


def _coloured(edges: DataFrame) -> DataFrame:
    """node and colour, alike in a strong component, of the nodes of some edges: in each round a node takes the least name among those that reach it, and those that reach back to it within their colour are its component."""
    done = edges.select(F.col("src").alias("node"), F.col("src").alias("colour")).limit(0)
    left = checkpointed(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct())
    while not left.isEmpty():
        inner = checkpointed(edges.join(left.withColumnRenamed("node", "src"), "src", "left_semi").join(left.withColumnRenamed("node", "dst"), "dst", "left_semi"))
        colour = _spread(left.withColumn("colour", F.col("node")), inner)
        coloured = inner.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("c")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("d")), "dst").where("c = d")
        back = checkpointed(coloured.select(F.col("dst").alias("from"), F.col("src").alias("to")))
        found = front = checkpointed(colour.where("node = colour"))
        while not front.isEmpty():
            front = checkpointed(front.join(back, front.node == back["from"]).select(F.col("to").alias("node"), "colour").distinct().join(found.select("node"), "node", "left_anti"))
            found = found.unionByName(front)
        done = done.unionByName(found)
        left = checkpointed(left.join(found.select("node"), "node", "left_anti"))
    return done


def _spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Each node's least label among the nodes that reach it."""
    while True:
        offered = edges.join(labels.withColumnRenamed("node", "src"), "src").groupBy("dst").agg(F.min("colour").alias("offer"))
        new = checkpointed(labels.join(offered, labels.node == offered.dst, "left").select("node", F.least("colour", "offer").alias("colour"), (F.col("offer") < F.col("colour")).alias("moved")))
        labels = new.select("node", "colour")
        if new.where("moved").isEmpty():
            return labels


def cycles(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """component, size and sorted members of the strong components of two nodes or more; a file that imports itself isn't one."""
    found = strong_components(edges, small).groupBy("component").agg(F.count("*").alias("size"), F.sort_array(F.collect_list("node")).alias("members"))
    return found.where("size > 1")


def topological_layers(edges: DataFrame, nodes: DataFrame | None = None, small: int = SMALL) -> DataFrame:
    """file_path and layer: every importer lies in a lower layer than what it imports. Raises CycleError where there is no such order.

    Of a larger graph, chains are contracted to edges of their length first, again while that takes a share of the nodes; then rounds follow the depth of what is left.
    """
    edges = checkpointed(edges.select("src", "dst").distinct())
    every = edges.select(F.col("src").alias("file_path")).union(edges.select("dst")).distinct()
    if is_small(edges, small):
        found = checkpointed(_in_one_task(edges, lambda e: sorted(_small.layers(e).items()), "file_path string, layer int"))
    else:
        found = _layers(edges, every)
    if every.join(found, "file_path", "left_anti").limit(1).count():
        raise CycleError("the graph has a cycle")
    if nodes is None:
        return found
    return nodes.select("file_path").distinct().join(found, "file_path", "left").select("file_path", F.coalesce("layer", F.lit(0)).alias("layer"))


def _layers(edges: DataFrame, every: DataFrame) -> DataFrame:
    """file_path and layer of the nodes that have one; those on or behind a cycle have none."""
    if not edges.where("src = dst").isEmpty():
        raise CycleError("a file imports itself")
    long, passes = edges.withColumn("length", F.lit(1).cast("bigint")), []
    while (found := chains(long)) is not None:
        if not found.where("start IS NULL").isEmpty():
            raise CycleError("the graph has a cycle")
        joined = _contracted(long, found)
        if not joined.where("src = dst").isEmpty():
            raise CycleError("the graph has a cycle")
        passes.append(found)
        long = checkpointed(joined.groupBy("src", "dst").agg(F.max("length").alias("length")))
    ended = None
    for found in passes:
        ended = found.select(F.col("node").alias("file_path")) if ended is None else ended.unionByName(found.select(F.col("node").alias("file_path")))
    still = every if ended is None else every.join(ended, "file_path", "left_anti")
    still, done = checkpointed(still.withColumn("layer", F.lit(0).cast("bigint"))), None
    while not still.isEmpty():
        free = checkpointed(still.join(long.select(F.col("dst").alias("file_path")).distinct(), "file_path", "left_anti"))
        if free.isEmpty():
            break
        done = free if done is None else done.unionByName(free)
        offers = long.join(free.withColumnRenamed("file_path", "src"), "src").groupBy(F.col("dst").alias("file_path")).agg(F.max(F.col("layer") + F.col("length")).alias("offer"))
        still = checkpointed(still.join(free.select("file_path"), "file_path", "left_anti").join(offers, "file_path", "left").select("file_path", F.greatest("layer", F.coalesce("offer", F.lit(0))).alias("layer")))
        long = checkpointed(long.join(free.select(F.col("file_path").alias("src")), "src", "left_anti"))
    done = every.withColumn("layer", F.lit(0)).limit(0) if done is None else done
    for found in reversed(passes):
        done = checkpointed(done)
        along = found.join(done.select(F.col("file_path").alias("start"), "layer"), "start").select(F.col("node").alias("file_path"), (F.col("layer") + F.col("length")).alias("layer"))
        done = done.unionByName(along)
    return checkpointed(done.select("file_path", F.col("layer").cast("int").alias("layer")))


def topological_sort(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    return topological_layers(edges, nodes).orderBy("layer", "file_path")


def node_positions(nodes: DataFrame) -> DataFrame:
    """file_path and position, from 0, in order of the path.

    Ranges of paths are numbered by themselves and moved by the counts of the ranges before, so no task sorts all.
    """
    ranged = checkpointed(nodes.select("file_path").distinct().repartitionByRange("file_path").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("file_path")) - 1
    return ranged.withColumn("rank", rank).join(starts, "part").select("file_path", (F.col("start") + F.col("rank")).alias("position"))


def node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """from_pos and to_pos of each edge whose ends are both nodes."""
    at = node_positions(nodes)
    joined = edges.select("src", "dst").distinct().join(at.select(F.col("file_path").alias("src"), F.col("position").alias("from_pos")), "src")
    return joined.join(at.select(F.col("file_path").alias("dst"), F.col("position").alias("to_pos")), "dst").select("from_pos", "to_pos")


class ImportGraph:
    """Nodes and edges with the changes that indexing makes to them. Each change gives a new graph."""

    def __init__(self, nodes: DataFrame, edges: DataFrame) -> None:
        self.nodes, self.edges = nodes, edges

    @classmethod
    def empty(cls, spark: SparkSession) -> ImportGraph:
        return cls(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame) -> ImportGraph:
        ends = edges.select(F.col("src").alias("file_path")).union(edges.select("dst"))
        return cls(nodes.select("file_path").union(ends).distinct(), edges.select("src", "dst").distinct())

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ImportGraph:
        """Read what ``save`` wrote; a missing file is an empty graph."""
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return cls.empty(spark)
        whole = spark.read.schema("tables string, nodes array<string>, edges array<array<bigint>>").json(path, multiLine=True)
        if tables := whole.select("tables").first().tables:
            return cls(spark.read.schema(NODES).parquet(f"{tables}/nodes"), spark.read.schema(EDGES).parquet(f"{tables}/edges"))
        nodes = whole.select(F.posexplode("nodes").alias("position", "file_path"))
        pairs = whole.select(F.explode("edges").alias("e")).select(F.col("e")[0].alias("a"), F.col("e")[1].alias("b"))
        edges = pairs.join(nodes.select(F.col("position").alias("a"), F.col("file_path").alias("src")), "a").join(nodes.select(F.col("position").alias("b"), F.col("file_path").alias("dst")), "b")
        return cls.of(nodes.select("file_path"), edges.select("src", "dst"))

    def save(self, path: str, small: int = SMALL) -> None:
        """Write node-link JSON, nodes and edges sorted; of a graph of more than ``small`` edges or nodes, which can't be one document, two tables and a JSON file that names their folder. Either takes the old file's place in one step.

        Tables that no file names any more are dropped after that, but for the last.
        """
        spark = self.nodes.sparkSession
        if is_small(self.edges, small) and is_small(self.nodes, small):
            nodes = [r.file_path for r in self.nodes.select("file_path").distinct().orderBy("file_path").collect()]
            at = {x: i for i, x in enumerate(nodes)}
            edges = sorted([at[r.src], at[r.dst]] for r in self.edges.distinct().collect() if r.src in at and r.dst in at)
            replace_file(spark, path, json.dumps({"nodes": nodes, "edges": edges}, indent=2).encode())
            return
        own = f"{path}.tables/{time.time_ns():020d}"
        self.nodes.select("file_path").distinct().repartitionByRange("file_path").write.parquet(f"{own}/nodes")
        inner = self.edges.select("src", "dst").distinct().join(self.nodes.select(F.col("file_path").alias("src")).distinct(), "src", "left_semi").join(self.nodes.select(F.col("file_path").alias("dst")).distinct(), "dst", "left_semi")
        inner.select("src", "dst").repartitionByRange("src").sortWithinPartitions("src", "dst").write.parquet(f"{own}/edges")
        replace_file(spark, path, json.dumps({"tables": own}).encode())
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.tables")
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for name in sorted(x.getPath().getName() for x in fs.listStatus(folder))[:-2]:
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.tables/{name}"), True)

    def _of(self, path: str, imports: list[str]) -> DataFrame:
        return self.nodes.sparkSession.createDataFrame([(path, x) for x in imports], EDGES)

    def add_file(self, path: str, imports: list[str]) -> ImportGraph:
        node = self.nodes.sparkSession.createDataFrame([(path,)], NODES)
        return ImportGraph.of(self.nodes.unionByName(node), self.edges.unionByName(self._of(path, imports)))

    def remove_file(self, path: str) -> ImportGraph:
        return ImportGraph(self.nodes.where(F.col("file_path") != path), self.edges.where((F.col("src") != path) & (F.col("dst") != path)))

    def update_file(self, path: str, imports: list[str]) -> ImportGraph:
        return ImportGraph(self.nodes, self.edges.where(F.col("src") != path)).add_file(path, imports)

    def update_files(self, nodes: DataFrame, edges: DataFrame) -> ImportGraph:
        """Many files at once: the outbound edges of ``nodes`` give way to ``edges``."""
        kept = self.edges.join(nodes.select(F.col("file_path").alias("src")), "src", "left_anti").select("src", "dst")
        return ImportGraph.of(self.nodes.unionByName(nodes.select("file_path")), kept.unionByName(edges.select("src", "dst")))

    def files(self) -> DataFrame:
        return self.nodes.select("file_path").distinct()

    def edge_count(self) -> int:
        return self.edges.distinct().count()

    def ancestors(self, path: str) -> DataFrame:
        return ancestors(self.edges, path)

    def descendants(self, path: str) -> DataFrame:
        return descendants(self.edges, path)

    def direct_importers(self, path: str) -> DataFrame:
        return direct_importers(self.edges, path)

    def direct_imports(self, path: str) -> DataFrame:
        return direct_imports(self.edges, path)

    def cycles(self) -> DataFrame:
        return cycles(self.edges)

    def topo_sort(self) -> DataFrame:
        return topological_sort(self.edges, self.nodes)
