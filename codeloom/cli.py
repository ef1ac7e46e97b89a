"""The command line: index search graph egg get put assert score rank.

Models are asked over HTTP with the key in OPENAI_API_KEY (environment or .env), at OPENAI_BASE_URL if that is set. With ``--stub`` before the verb, or CODELOOM_CLIENT=stub, answers are made by rule without a network; what is
stored then is made up, and the log says so.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from codeloom.operators import edit, extract, index, semantic, vector
from codeloom.operators.graph import ImportGraph
from codeloom.operators.render import write_documents
from codeloom.operators.store import SymbolStore
from codeloom.sources import provider
from codeloom.sources.files import MissingKeyError, api_key, find_repo_root, resolve

VERBS = ("index", "search", "graph", "egg", "get", "put", "assert", "score", "rank")


def _log(verb: str, message: str) -> None:
    print(f"{verb:>8} | {message}", file=sys.stderr, flush=True)


class Session:
    """A repository's store and graph, opened when first asked for."""

    def __init__(self, client: semantic.ModelClient | None = None, spark: SparkSession | None = None) -> None:
        self.root = find_repo_root()
        self._client = client
        self._spark = spark
        self.home = self.root / ".codeloom"
        self.graph_path = f"file://{self.home}/imports.json"

    @property
    def spark(self) -> SparkSession:
        if self._spark is None:
            self._spark = SparkSession.builder.master(os.environ.get("CODELOOM_MASTER", "local[*]")).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        return self._spark

    @property
    def client(self) -> semantic.ModelClient:
        if self._client is None:
            self._client = provider.HttpClient(api_key(start=self.root), os.environ.get("OPENAI_BASE_URL") or provider.BASE_URL)
        return self._client

    @property
    def store(self) -> SymbolStore:
        self.home.mkdir(exist_ok=True)
        return SymbolStore(self.spark, f"file://{self.home}/symbols").ensure()

    @property
    def graph(self) -> ImportGraph:
        return ImportGraph.load(self.spark, self.graph_path)

    def relative(self, path: str) -> str:
        full = Path(path).resolve()
        return full.relative_to(self.root).as_posix() if full.is_relative_to(self.root) else path


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="codeloom")
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, *flags: tuple[str, dict]) -> None:
        own = verbs.add_parser(name)
        for flag, options in flags:
            own.add_argument(*flag.split(), **options)

    need, switch = {"required": True}, {"action": "store_true"}
    verb("index", ("--target", need), ("--model", {"default": semantic.DESCRIBE_MODEL}), ("--effort", {"default": "medium", "choices": ["low", "medium", "high"]}), ("--force", switch), ("--prune", switch))
    verb("search", ("--query", need), ("-n --top-k", {"type": int, "default": vector.TOP_K}), ("--min-similarity", {"type": float, "default": 0.0}))
    verb("graph", ("--target", need), ("--mode", {"default": "blast-radius", "choices": ["blast-radius", "depends", "cycles"]}), ("--json", switch))
    verb("egg", ("--target", need), ("--no-recursive", switch))
    verb("get", ("--name", need), ("--file", need), ("--source-only", switch))
    verb("put", ("--file", need), ("--name", need), ("--new-source", need), ("--new-comment", need), ("--force", switch))
    verb("assert", ("--claim", need), ("--a", need), ("--b", need), ("--model", {"default": semantic.ASSERT_MODEL}))
    verb("score", ("--quality", need), ("--target", need), ("--model", {"default": semantic.SCORE_MODEL}))
    verb("rank", ("--criteria", need), ("--options", {"required": True, "nargs": "+"}), ("--model", {"default": semantic.RANK_MODEL}))
    return top


def _index(s: Session, a: argparse.Namespace) -> int:
    if not Path(a.target).exists():
        _log("index", f"{a.target} doesn't exist")
        return 1
    report = index.index_directory(s.spark, s.root, s.store, s.graph, s.client, s.relative(a.target), a.model, a.effort, a.force, a.prune)
    report.graph.save(s.graph_path)
    total = report.summary()
    for row in report.files.where(F.col("status") == "failed").orderBy("file_path").toLocalIterator():
        _log("index", f"{row.file_path}: {row.error}")
    _log("index", ", ".join(f"{v} {k}" for k, v in total.items()))
    return int(total["failed"] > 0)


def _search(s: Session, a: argparse.Namespace) -> int:
    found = vector.search_vectors(s.store.read(), semantic.embed_query(a.query, s.client), top_k=a.top_k)
    for row in vector.format_results(vector.search_results(vector.at_least(found, a.min_similarity))).collect():
        print(row.line)
    return 0


def _graph(s: Session, a: argparse.Namespace) -> int:
    graph, target = s.graph, s.relative(a.target)
    if a.mode == "cycles":
        out = [r.members for r in graph.cycles().orderBy("component").collect()]
    else:
        rows = graph.ancestors(target) if a.mode == "blast-radius" else graph.descendants(target)
        out = [r.file_path for r in rows.orderBy("file_path").collect()]
    print(json.dumps({"target": target, "mode": a.mode, "result": out}, indent=2) if a.json else "\n".join(" -> ".join(x) if isinstance(x, list) else x for x in out))
    return 0


def _egg(s: Session, a: argparse.Namespace) -> int:
    if not Path(a.target).is_dir():
        _log("egg", f"{a.target} isn't a directory")
        return 1
    for path in write_documents(s.store.read(), s.root, s.relative(a.target), not a.no_recursive):
        print(path)
    return 0


def _get(s: Session, a: argparse.Namespace) -> int:
    if not Path(a.file).is_file():
        _log("get", f"{a.file} isn't a file")
        return 1
    found = next((x for x in extract.symbols_of(Path(a.file).read_text(encoding="utf-8")) if x["name"] == a.name), None)
    if found is None:
        _log("get", f"{a.name} isn't in {a.file}")
        return 1
    if not a.source_only and (row := s.store.get_by_id(f"{s.relative(a.file)}::{a.name}").first()) and row.description:
        print(f"# {row.description}")
    print(found["source"])
    return 0


def _put(s: Session, a: argparse.Namespace) -> int:
    new = sys.stdin.read() if a.new_source == "-" else a.new_source
    try:
        if stopped := edit.recover(s.root, s.store, s.graph, s.client, s.graph_path):
            _log("put", f"finished an earlier flush of {stopped.file_path}")
        with edit.edit(s.root, s.relative(a.file), s.store, s.graph, s.client, s.graph_path) as context:
            context.put(a.name, new, a.new_comment, a.force)
            report = context.flush()
    except (edit.FidelityError, edit.PrudenceWarning) as e:
        _log("put", f"{e}\n{e.evidence}")
        return 2 if isinstance(e, edit.FidelityError) else 3
    except edit.FlushError as e:
        _log("put", str(e))
        return 4
    except (ValueError, OSError) as e:
        _log("put", str(e))
        return 1
    for warning in filter(None, (report.format_warning, report.document_warning)):
        _log("put", f"warning: {warning}")
    _log("put", f"{report.file_path}: {report.bytes_written} bytes, {report.graph_edges} edges, commit {report.commit or 'none'}")
    return 0


def _assert(s: Session, a: argparse.Namespace) -> int:
    print(semantic.run_assert(a.claim, resolve(a.a, "a"), resolve(a.b, "b"), s.client, a.model, log=lambda m: _log("assert", m))[1])
    return 0


def _score(s: Session, a: argparse.Namespace) -> int:
    print(semantic.score(a.quality, resolve(a.target, "target"), s.client, a.model, lambda m: _log("score", m)))
    return 0


def _rank(s: Session, a: argparse.Namespace) -> int:
    if len(a.options) < 2:
        _log("rank", "at least two options are needed")
        return 1
    print(semantic.rank(a.criteria, [resolve(o, "option") for o in a.options], s.client, a.model, lambda m: _log("rank", m)))
    return 0


def main(argv: Sequence[str] | None = None, client: semantic.ModelClient | None = None, spark: SparkSession | None = None) -> int:
    """Run one verb; its exit code, 2 for an unknown one."""
    argv = list(sys.argv[1:] if argv is None else argv)
    stub = argv[:1] == ["--stub"]
    argv = argv[stub:]
    if not argv or argv[0] not in VERBS:
        _log("codeloom", f"verbs: {' '.join(VERBS)}; --stub before a verb asks no model")
        return 2
    if client is None and (stub or os.environ.get("CODELOOM_CLIENT") == "stub"):
        _log(argv[0], "no model is asked: answers and vectors are made by rule")
        client = semantic.StubClient()
    a = _parser().parse_args(argv)
    run = {"index": _index, "search": _search, "graph": _graph, "egg": _egg, "get": _get, "put": _put, "assert": _assert, "score": _score, "rank": _rank}
    try:
        return run[a.verb](Session(client, spark), a)
    except (provider.ServiceError, MissingKeyError) as e:
        _log(a.verb, str(e))
        return 1


if __name__ == "__main__":
    sys.exit(main())
