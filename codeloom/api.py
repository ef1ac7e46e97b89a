"""The engine's verbs as functions."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame

from codeloom.operators import extract, semantic, vector
from codeloom.operators.edit import EditContext, FidelityError, FlushError, PrudenceWarning, edit, recover
from codeloom.operators.graph import ImportGraph
from codeloom.operators.index import index_directory, index_file
from codeloom.operators.render import write_documents as egg
from codeloom.operators.semantic import rank, run_assert, score
from codeloom.operators.store import SymbolStore

__all__ = [
    "EditContext", "FidelityError", "FlushError", "GetResult", "ImportGraph", "PrudenceWarning", "SymbolStore", "edit", "egg", "generate_batch", "get", "index_directory", "index_file", "rank", "recover", "run_assert",
    "score", "search",
]


@dataclass
class GetResult:
    name: str
    kind: str
    source: str
    signature: str
    description: str | None
    file_path: str
    start_line: int
    end_line: int


def search(query: str, store: SymbolStore, client: semantic.ModelClient, top_k: int = vector.TOP_K, min_similarity: float = 0.0) -> DataFrame:
    """The symbols most like a query, by description or signature."""
    found = vector.search_vectors(store.read(), semantic.embed_query(query, client), top_k=top_k)
    return vector.search_results(vector.at_least(found, min_similarity))


def get(path: str | Path, name: str, store: SymbolStore | None = None, root: str | Path | None = None) -> GetResult:
    """A symbol of a file as it stands, with its stored description where there is a store."""
    symbol = next((s for s in extract.symbols_of(Path(path).read_text(encoding="utf-8")) if s["name"] == name), None)
    if symbol is None:
        raise ValueError(f"symbol {name!r} not found in {path}")
    description = None
    if store is not None:
        full, base = Path(path).resolve(), Path(root or ".").resolve()
        key = full.relative_to(base).as_posix() if full.is_relative_to(base) else str(full)
        row = store.get_by_id(f"{key}::{name}").select("description").first()
        description = row.description if row else None
    return GetResult(symbol["name"], symbol["kind"], symbol["source"], symbol["signature"], description, str(path), symbol["start_line"], symbol["end_line"])


def generate_batch(client: semantic.ModelClient, prompt: str, contents: list[str], model: str = semantic.SCORE_MODEL, concurrency: int = semantic.CONCURRENCY) -> list[semantic.Answer]:
    """Answers in the order of the contents, so many at a time, from the driver; ``semantic.generate`` does it for tables."""
    with ThreadPoolExecutor(concurrency) as pool:
        return list(pool.map(lambda c: semantic.ask_once(client, prompt, c, model), contents))
