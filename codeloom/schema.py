"""The fixed schemas of the engine."""

from __future__ import annotations

from pyspark.sql import types as T

VECTOR_SIZE = 256
EMBED_SIZE = 1536
MODULE = "__module__"


def symbols_schema() -> T.StructType:
    """The symbol table: twelve columns, the key is id."""
    text, vector = T.StringType(), T.ArrayType(T.FloatType(), False)
    kinds = {
        "id": (text, False), "file_path": (text, False), "kind": (text, False), "description": (text, True), "description_vector": (vector, False), "signature": (text, False),
        "signature_vector": (vector, False), "source_hash": (text, False), "last_modified": (text, False), "git_author": (text, False), "mutation_count": (T.LongType(), False), "repo_id": (text, False),
    }
    return T.StructType([T.StructField(name, kind, null) for name, (kind, null) in kinds.items()])


SYMBOLS = symbols_schema()
FILES = "path string, content string, error string"
AST_SYMBOLS = "name string, kind string, signature string, source string, start_line int, end_line int, parent string"
IMPORTS = "file_path string, pos int, module string, level int, names array<string>, is_from boolean"
NODES, EDGES = "file_path string", "src string, dst string"
DESCRIPTION = "module_description string, symbols array<struct<name:string,kind:string,parent:string,description:string>>"
RATES = "model string, input double, output double, cache_read double, cache_write double"
