"""Scanning, extraction, resolution, indexing, rendering, editing and the command line on a small repository."""

import json
import math
import random
import subprocess
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from codeloom import api, cli
from codeloom.operators import edit, extract, graph, imports, index, render, semantic, store, vector
from codeloom.sources import files, provider, repository

MINI = {
    "app/__init__.py": "", "app/core.py": "import json\nfrom . import util\nfrom app.models import User\n", "app/util.py": "from app import core\n", "app/models.py": "import app.core as c\n",
    "src/lib1/__init__.py": "", "src/lib1/b.py": "", "src/lib1/a.py": "import lib1.b.c\nfrom .. import z\nfrom ... import z\n", "packages/foo/foo/__init__.py": "", "packages/foo/foo/x.py": "",
    "tools/run.py": "import foo.x\nimport app.core\nfrom .helpers import h\n", "tools/bad.py": "def (\n", ".venv/skip.py": "x = 1\n",
}
SOURCE = '''import functools

@functools.lru_cache
def load(path: str, n=1) -> dict:
    def inner(): ...
    return {}

class Repo(Base, metaclass=M):
    """doc"""
    async def get(self, k):
        return k
    @property
    def size(self): return 0
    class Inner:
        def no(self): ...

if True:
    def hidden(): ...
'''


@pytest.fixture
def repo(tmp_path):
    for path, text in MINI.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q")
    run("config", "user.email", "a@b.c")
    run("config", "user.name", "Ann")
    run("remote", "add", "origin", "https://github.com/o/r.git")
    run("add", "-A")
    run("commit", "-qm", "x")
    return tmp_path


def test_scan(spark, repo):
    paths = [r.path for r in repository.list_files(spark, repo).orderBy("path").collect()]
    assert paths == sorted(p for p in MINI if not p.startswith(".venv")) and len(paths) == 11
    rows = files.scan_repository(spark, repo).collect()
    assert {r.path: r.content for r in rows} == {p: t for p, t in MINI.items() if not p.startswith(".venv")}
    (repo / "app/latin.py").write_bytes(b"\xff\xfe\xff")
    bad = files.read_files(spark, repo, ["app/latin.py", "app/none.py"]).collect()
    assert all(r.content is None and r.error.startswith("read error") for r in bad)
    assert {r.path for r in files.scan_repository(spark, repo, "app").collect()} == {p for p in MINI if p.startswith("app/")} | {"app/latin.py"}


def test_trees_are_listed_by_tasks(spark, tmp_path):
    rnd = random.Random(4)
    want = {}
    for k in range(400):
        path = "/".join([rnd.choice(["a", "b", "_c", "d e", "é", ".claude", "__pycache__", ".venv"]) for _ in range(rnd.randrange(5))] + [f"m{k}.{rnd.choice(['py', 'txt', 'py'])}"])
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x" * k)
        parts = path.split("/")[:-1]
        if path.endswith(".py") and not {"__pycache__", ".venv"} & set(parts):
            want[path] = k
    (tmp_path / "link").symlink_to(tmp_path / "a")
    (tmp_path / "broken.py").symlink_to(tmp_path / "nothing")
    want["broken.py"] = 0
    for tasks, wide in ((1, 50), (7, 3), (1000, 100_000)):
        listed = repository.list_files(spark, tmp_path, tasks=tasks, wide=wide)
        assert {r.path: r["size"] for r in listed.collect()} == want and listed.count() == len(want)
        assert listed.rdd.getNumPartitions() >= tasks or tasks == 1000
        for prefix in ("a/", "a/b", "é/a/m1", "nothing/", ".venv/"):
            assert {r.path for r in repository.list_files(spark, tmp_path, prefix=prefix, tasks=tasks, wide=wide).collect()} == {p for p in want if p.startswith(prefix)}
        one = min(want)
        assert [r.path for r in repository.list_files(spark, tmp_path, only=one, tasks=tasks).collect()] == [one] and repository.list_files(spark, tmp_path, only=one, prefix="zz").count() == 0
        assert {r.path for r in repository.list_files(spark, tmp_path, "a", "a/b/", tasks=tasks).collect()} == {p for p in want if p.startswith("a/b/")} and repository.list_files(spark, tmp_path, "a", "b/").count() == 0
    assert repository.list_files(spark, tmp_path / "none").count() == 0 and repository.list_files(spark, tmp_path, "none").count() == 0


def test_only_what_may_hold_a_path_is_opened(tmp_path):
    for d in "abc":
        (tmp_path / d / "x").mkdir(parents=True)
    opened = lambda **options: [p.relative for p in repository.TreeReader({"root": str(tmp_path), **options}).partitions()]
    assert opened(prefix="b/x") == ["b", "b/x"] and opened(only="c/x/m.py") == ["c/x"] and opened(below="a", prefix="a/x/") == ["a/x"]


def test_logs_are_read_in_ranges(spark, repo, tmp_path):
    for k in range(7):
        (repo / f"app/{'core' if k % 3 else 'new é'}.py").write_text(f"x = {k}\n")
        subprocess.run(["git", "-C", str(repo), "add", "-A"], check=True)
        subprocess.run(["git", "-C", str(repo), "commit", "-qm", f"c{k}", f"--author=A|{k} <a@b>"], check=True)
    one = {tuple(r) for r in repository.commits(spark, repo, 100).collect()}
    log = repository.commits(spark, repo, 2)
    assert {tuple(r) for r in log.collect()} == one and log.rdd.getNumPartitions() == 4 and {r[0] for r in one} == set(range(8))
    last = {r.file_path: r.git_author for r in repository.last_commits(log).collect()}
    assert (last["app/core.py"], last["app/new é.py"], last["app/util.py"]) == ("A|5", "A|6", "Ann")
    assert last == {r.file_path: r.git_author for p in last for r in files.git_metadata(spark, repo, p).collect()}
    (tmp_path / "bare").mkdir()
    assert repository.commits(spark, tmp_path / "bare").count() in (0, len(one)) and repository.commits(spark, "/").count() == 0


def test_symbols(spark):
    rows = extract.extract_symbols(spark.createDataFrame([("a.py", SOURCE), ("b.py", "def ("), ("c.py", None)], "path string, content string")).collect()
    found = [(r.name, r.kind, r.start_line, r.end_line, r.parent, r.signature) for r in rows if r.file_path == "a.py"]
    assert found == [
        ("load", "function", 3, 6, None, "def load(path: str, n=1) -> dict:"), ("Repo", "class", 8, 15, None, "class Repo(Base, metaclass=M):"),
        ("Repo.get", "method", 10, 11, "Repo", "async def get(self, k):"), ("Repo.size", "method", 12, 13, "Repo", "def size(self):"),
    ]
    assert [r.error[:16] for r in rows if r.file_path == "b.py"] == ["AST parse error:"] and not [r for r in rows if r.file_path == "c.py"]
    assert extract.symbols_of("x = '\f '\ndef f():\n    return 1\n")[0]["source"] == "def f():\n    return 1"
    twice = extract.extract_symbols(spark.createDataFrame([("a.py", "def f(a): ...\ndef f(b): ...\n")], "path string, content string"))
    assert extract.symbol_by_name(twice, "f").first().signature == "def f(a):"


def resolved(spark, root):
    everything = files.scan_repository(spark, root).where("error IS NULL")
    paths = everything.select("path")
    modules = extract.absolute_imports(extract.extract_imports(everything), extract.packages_of_files(paths))
    roots = extract.package_roots(paths)
    return modules, roots, extract.import_edges(extract.resolve_imports(modules, paths, roots))


def test_imports_and_edges(spark, repo):
    modules, roots, edges = resolved(spark, repo)
    by_file = {}
    for r in modules.orderBy("file_path", "pos").collect():
        by_file.setdefault(r.file_path, []).append(r.module)
    assert by_file == {"app/core.py": ["json", "app.util", "app.models"], "app/util.py": ["app"], "app/models.py": ["app.core"], "src/lib1/a.py": ["lib1.b.c", "z"], "tools/run.py": ["foo.x", "app.core"]}
    assert [tuple(r) for r in roots.collect()] == [("foo", "packages/foo/")]
    assert {tuple(r) for r in edges.collect()} == {
        ("app/core.py", "app/models.py"), ("app/core.py", "app/util.py"), ("app/util.py", "app/__init__.py"), ("app/models.py", "app/core.py"), ("src/lib1/a.py", "src/lib1/b.py"), ("tools/run.py", "app/core.py"), ("tools/run.py", "packages/foo/foo/x.py"),
    }


def test_root_conflicts_go_to_the_first(spark, repo):
    (repo / "packages/bar/foo").mkdir(parents=True)
    (repo / "packages/bar/foo/__init__.py").write_text("")
    _, roots, edges = resolved(spark, repo)
    assert [tuple(r) for r in roots.collect()] == [("foo", "packages/bar/")]
    assert ("tools/run.py", "packages/bar/foo/__init__.py") in {tuple(r) for r in edges.collect()}


def test_index_twice_and_edit(spark, repo, tmp_path_factory):
    (repo / "app/repo.py").write_text(SOURCE)
    home = tmp_path_factory.mktemp("store")
    symbols, client = store.SymbolStore(spark, f"file://{home}/symbols").ensure(), semantic.StubClient()
    first = index.index_directory(spark, repo, symbols, graph.ImportGraph.empty(spark), client)
    total = first.summary()
    assert (total["indexed"], total["skipped"], total["failed"], total["edges"], total["symbols"], total["described"]) == (11, 0, 1, 7, 4, 4)
    rows = {r.id: r for r in symbols.read().collect()}
    assert len(rows) == 15 and all(r.mutation_count == 0 and r.repo_id == "o/r" and len(r.description_vector) == 256 for r in rows.values())
    assert rows["app/core.py::__module__"].git_author == "Ann" and rows["app/repo.py::load"].git_author == "unknown" and rows["app/repo.py::Repo.get"].description == "The method Repo.get."
    assert not any(rows["app/core.py::__module__"].signature_vector)
    again = index.index_directory(spark, repo, symbols, first.graph, client)
    assert again.summary()["skipped"] == 11 and again.summary()["edges"] == 7
    (repo / "app/repo.py").write_text(SOURCE + "\ndef added(): ...\n")
    third = index.index_directory(spark, repo, symbols, again.graph, client, "app")
    assert {r.file_path: r.status for r in third.files.collect()}["app/repo.py"] == "indexed" and third.summary()["edges"] == 7
    assert {r.id: r.mutation_count for r in symbols.get_by_file("app/repo.py").collect()} == {f"app/repo.py::{n}": 1 for n in ("load", "Repo", "Repo.get", "Repo.size", "added", "__module__")}
    g = third.graph
    assert {r.file_path for r in g.ancestors("app/core.py").collect()} == {"app/models.py", "tools/run.py"}
    assert {r.file_path for r in g.descendants("tools/run.py").collect()} == {"app/core.py", "app/models.py", "app/util.py", "app/__init__.py", "packages/foo/foo/x.py"}
    assert [r.members for r in g.cycles().collect()] == [["app/core.py", "app/models.py"]]
    with pytest.raises(graph.CycleError):
        g.topo_sort()
    (repo / "tools/helpers.py").write_text("import late\n")
    (repo / "late.py").write_text("")
    fourth = index.index_directory(spark, repo, symbols, g, client)
    assert ("tools/helpers.py", "late.py") in {tuple(r) for r in fourth.graph.edges.collect()}
    (repo / "late.py").unlink()
    pruned = index.index_directory(spark, repo, symbols, fourth.graph, client, prune=True)
    assert symbols.get_by_file("late.py").count() == 0 and ("tools/helpers.py", "late.py") not in {tuple(r) for r in pruned.graph.edges.collect()}
    with pytest.raises(ValueError, match="isn't inside"):
        index.index_directory(spark, repo, symbols, g, client, "../elsewhere")

    with edit.edit(repo, "app/repo.py", symbols, pruned.graph, client) as context:
        with pytest.raises(edit.EditBusyError), edit.edit(repo, "app/repo.py", symbols, g, client):
            pass
        assert context.get("Repo.get") == ("    async def get(self, k):\n        return k", "The method Repo.get.", "async def get(self, k):")
        change = context.put("Repo.get", "async def get(self, k):\n    return [k]", "Return the key in a list.")
        assert change.old_comment == "The method Repo.get." and not change.prudence_skipped
        with pytest.raises(ValueError, match="doesn't parse"):
            context.put("load", "def (", "x")
        with pytest.raises(ValueError, match="not found"):
            context.put("nobody", "def a(): ...", "x")
        with pytest.raises(edit.FidelityError):
            context.put("load", "def load(): ...", "")
        report = context.flush()
        assert report.commit and report.symbols == 5
        with pytest.raises(RuntimeError):
            context.flush()
    assert "    async def get(self, k):\n        return [k]\n    @property" in (repo / "app/repo.py").read_text()
    log = subprocess.run(["git", "-C", str(repo), "log", "-1", "--format=%B", "--name-only"], capture_output=True, text=True).stdout
    assert log.startswith("codeloom: Repo.get @ app/repo.py") and log.strip().endswith("app/repo.py")
    document = (repo / "app" / render.DOCUMENT).read_text()
    assert '<method name="get" args="self, k" />' in document and '<fn name="load" args="path: str, n=1" returns="dict" />' in document
    got = api.get(repo / "app/repo.py", "load", symbols, repo)
    assert (got.kind, got.start_line, got.description) == ("function", 3, "The function load.") and api.get(repo / "app/repo.py", "load").description is None
    with pytest.raises(ValueError, match="not found"):
        api.get(repo / "app/repo.py", "nobody")
    top = api.search("the method Repo.get", symbols, client, 2).collect()
    assert top[0].id == "app/repo.py::Repo.get" and top[0].match_field == "description" and top[0].name == "Repo.get"
    assert [a.texts[0][:4] for a in api.generate_batch(client, "p", ["x", "y"])] == ["TRUE", "TRUE"]
    with edit.edit(repo, "app/repo.py", symbols, g, client) as context:
        assert context.flush() is None
    with edit.edit(repo, "app/repo.py", symbols, g, client) as context:
        context.dump()
    assert "# codeloom: unverified dump @" in (repo / "app/repo.py").read_text()


def whole_edges(spark, texts):
    """Edges as a full run makes them."""
    rows = spark.createDataFrame(list(texts.items()), "path string, content string")
    paths = rows.select("path")
    modules = extract.absolute_imports(extract.extract_imports(rows), extract.packages_of_files(paths))
    return {tuple(r) for r in extract.import_edges(extract.resolve_imports(modules, paths, extract.package_roots(paths))).collect()}


def test_edits_give_the_edges_of_a_full_run(spark, tmp_path):
    texts = {p: t for p, t in MINI.items() if not p.startswith(".venv")}
    kept = imports.ImportIndex(spark, f"file://{tmp_path}/imports", buckets=4)

    def take(*changed, gone=()):
        for p in gone:
            del texts[p]
        rows = [(p, texts[p], str(hash(texts[p]))) for p in changed]
        touched = kept.update(spark.createDataFrame(rows, "path string, content string, source_hash string"), spark.createDataFrame([(p,) for p in gone], "path string"))
        assert {tuple(r) for r in kept.edges().collect()} == whole_edges(spark, texts) and kept.unfinished() == []
        return {r.file_path for r in touched.collect()}

    take(*texts)
    texts["app/util.py"] = "import app.models, late.y, json\nfrom . import core\n"
    assert take("app/util.py") == {"app/util.py"}
    texts["late/y.py"] = "def ("
    assert take("late/y.py") == {"late/y.py", "app/util.py"}  # who waited for it is resolved again, nobody else
    texts |= {"late/__init__.py": "", "packages/bar/foo/__init__.py": "", "packages/bar/foo/x.py": ""}
    assert "tools/run.py" in take("late/__init__.py", "packages/bar/foo/__init__.py", "packages/bar/foo/x.py")
    assert {"app/core.py", "app/util.py"} <= take(gone=["app/__init__.py", "late/y.py"])  # no package, so relative imports mean nothing
    texts["app/__init__.py"] = "from .core import x"
    take("app/__init__.py", gone=[p for p in texts if p.startswith("packages/bar")])


def test_an_update_that_stops_is_taken_up(spark, tmp_path, monkeypatch):
    kept = imports.ImportIndex(spark, f"file://{tmp_path}/imports", buckets=2)
    rows = lambda **texts: spark.createDataFrame([(f"{p}.py", t, t) for p, t in texts.items()], "path string, content string, source_hash string")
    kept.update(rows(a="import b", b="", c="import d"))
    for table in ("users", "files"):
        with monkeypatch.context() as m, pytest.raises(OSError, match="stop"):
            m.setattr(getattr(kept, table), "_add", lambda _: (_ for _ in ()).throw(OSError("stop")))
            kept.update(rows(a="import c, e", e=""))
        assert kept.unfinished() == ["a.py", "e.py"]
        assert {r.path for r in kept.differing(rows(a="import c, e", e="", b="")).collect()} == {"a.py", "e.py"}
        kept.update(rows(a="import c, e", e=""))
        assert {tuple(r) for r in kept.edges().collect()} == {("a.py", "c.py"), ("a.py", "e.py")} and kept.unfinished() == []
        if table == "users":
            kept.update(rows(a="import b"), spark.createDataFrame([("e.py",)], "path string"))
            assert {tuple(r) for r in kept.edges().collect()} == {("a.py", "b.py")}


def test_one_file_is_indexed_at_the_cost_of_one(spark, repo, tmp_path_factory):
    home = tmp_path_factory.mktemp("store")
    symbols, client = store.SymbolStore(spark, f"file://{home}/symbols").ensure(), semantic.StubClient()
    first = index.index_file(spark, repo, "app/core.py", symbols, graph.ImportGraph.empty(spark), client)  # no tables yet: all imports are read
    assert {tuple(r) for r in first.graph.edges.collect()} == {("app/core.py", "app/models.py"), ("app/core.py", "app/util.py")}
    everything = index.index_directory(spark, repo, symbols, first.graph, client)
    (repo / "app/models.py").write_text("import tools.run\n")  # not indexed, so it must not be read
    (repo / "app/util.py").write_text("import foo.x\n")
    one = index.index_file(spark, repo, "app/util.py", symbols, everything.graph, client)
    before, after = ({tuple(r) for r in g.edges.collect()} for g in (everything.graph, one.graph))
    assert after == before - {("app/util.py", "app/__init__.py")} | {("app/util.py", "packages/foo/foo/x.py")}
    assert [(r.file_path, r.status) for r in one.files.collect()] == [("app/util.py", "indexed")]
    assert {r.mutation_count for r in symbols.get_by_file("app/util.py").collect()} == {1} and {r.mutation_count for r in symbols.get_by_file("app/models.py").collect()} == {0}
    assert index.index_file(spark, repo, "app/none.py", symbols, one.graph, client).files.count() == 0


@pytest.mark.parametrize("step", ["atomic_write", "index_file"])
def test_a_flush_that_stops_is_finished(spark, repo, tmp_path_factory, monkeypatch, step):
    home, client = tmp_path_factory.mktemp("store"), semantic.StubClient()
    symbols = store.SymbolStore(spark, f"file://{home}/symbols", buckets=2).ensure()
    (repo / "app/repo.py").write_text("def load(): ...\n")
    old = (repo / "app/repo.py").read_text()
    with edit.edit(repo, "app/repo.py", symbols, graph.ImportGraph.empty(spark), client) as context:
        context.put("load", "def load():\n    import app.core", "Load the core.")
        with monkeypatch.context() as m, pytest.raises(SystemExit):
            m.setattr(edit, step, lambda *_, **__: (_ for _ in ()).throw(SystemExit))
            context.flush()
    report = edit.recover(repo, symbols, graph.ImportGraph.empty(spark), client)
    if step == "atomic_write":
        assert report is None and (repo / "app/repo.py").read_text() == old and symbols.read().count() == 0
    else:
        assert (report.file_path, report.symbols, report.graph_edges) == ("app/repo.py", 1, 1) and report.commit and report.document_warning is None and report.documents == [repo / "app" / render.DOCUMENT]
        assert {r.id for r in symbols.get_by_file("app/repo.py").collect()} == {"app/repo.py::load", "app/repo.py::__module__"}
        assert subprocess.run(["git", "-C", str(repo), "status", "--porcelain", "app/repo.py"], capture_output=True, text=True).stdout == ""
    assert edit.recover(repo, symbols, graph.ImportGraph.empty(spark), client) is None


@pytest.mark.parametrize(
    ("old", "want"),
    [(None, "{s}\nB"), ("intro\n{s}\nold", "intro\n{s}\nB"), ("x<index>old</index>y", "x{s}\nBy"), ("intro", "intro\n{s}\nB")],
)
def test_merge_document(old, want):
    assert render.merge_document(None if old is None else old.format(s=render.SENTINEL), "B") == want.format(s=render.SENTINEL)


def test_render_orders_and_orphans(spark):
    rows = [
        ("a/m.py::__module__", "a/m.py", "module", 'Say "hi"', ""), ("a/m.py::C.z", "a/m.py", "method", None, "def z(self) -> int:"), ("a/m.py::C", "a/m.py", "class", None, "class C:"), ("a/m.py::D", "a/m.py", "class", None, "class D:"),
        ("a/m.py::f", "a/m.py", "function", None, "def f():"), ("a/m.py::Gone.x", "a/m.py", "method", None, "def x(self):"), ("b.py::__module__", "b.py", "module", None, ""),
    ]
    found = {r.directory: r.block for r in render.render_directories(spark.createDataFrame(rows, "id string, file_path string, kind string, description string, signature string")).collect()}
    assert found["a"] == (
        '<index>\n  <file path="m.py" doc="Say &quot;hi&quot;">\n    <fn name="f" args="" />\n    <cls name="C">\n      <method name="z" args="self" returns="int" />\n    </cls>\n    <cls name="D" />\n  </file>\n</index>'
    )
    assert found["."] == '<index>\n  <file path="b.py">\n  </file>\n</index>'


def test_command_line(spark, repo, monkeypatch, capsys):
    monkeypatch.chdir(repo)
    monkeypatch.setenv("OPENAI_API_KEY", "")
    assert cli.main(["search", "--query", "x"], spark=spark) == 1 and "OPENAI_API_KEY" in capsys.readouterr().err
    assert cli.main(["--stub", "assert", "--claim", "c", "--a", "x", "--b", "y"], spark=spark) == 0 and "made by rule" in capsys.readouterr().err
    monkeypatch.setenv("CODELOOM_CLIENT", "stub")
    call = lambda *a: cli.main(a, spark=spark)
    assert call("nothing") == 2 and call("index", "--target", "nowhere") == 1
    assert call("index", "--target", ".") == 1  # one file doesn't parse
    assert call("search", "--query", "module of symbols", "-n", "3") == 0
    assert len(capsys.readouterr().out.splitlines()) == 3
    assert call("graph", "--target", "app/core.py", "--json") == 0
    assert json.loads(capsys.readouterr().out)["result"] == ["app/models.py", "tools/run.py"]
    assert call("graph", "--target", "tools/run.py", "--mode", "depends") == 0 and "app/util.py" in capsys.readouterr().out
    assert call("graph", "--target", "x", "--mode", "cycles") == 0 and capsys.readouterr().out.strip() == "app/core.py -> app/models.py"
    assert call("egg", "--target", ".") == 0 and (repo / "app" / render.DOCUMENT).exists() and call("egg", "--target", "app/core.py") == 1
    (repo / "app/new.py").write_text("def f():\n    return 1\n")
    capsys.readouterr()
    assert call("get", "--file", "app/new.py", "--name", "f") == 0 and capsys.readouterr().out == "def f():\n    return 1\n"
    assert call("get", "--file", "app/new.py", "--name", "g") == 1 and call("get", "--file", "no.py", "--name", "g") == 1
    assert call("put", "--file", "app/new.py", "--name", "f", "--new-source", "def f():\n    return 2", "--new-comment", "Two.") == 0
    assert (repo / "app/new.py").read_text() == "def f():\n    return 2\n"
    capsys.readouterr()
    assert call("get", "--file", "app/new.py", "--name", "f") == 0 and capsys.readouterr().out == "# The function f.\ndef f():\n    return 2\n"
    assert call("put", "--file", "app/new.py", "--name", "f", "--new-source", "def f(): ...", "--new-comment", "") == 2
    assert call("assert", "--claim", "c", "--a", "x", "--b", "y") == 0 and call("score", "--quality", "q", "--target", "app") == 0
    assert call("rank", "--criteria", "c", "--options", "x") == 1 and call("rank", "--criteria", "c", "--options", "x", "longer") == 0
    assert "1. OPTION 2" in capsys.readouterr().out


def test_references(repo, monkeypatch):
    monkeypatch.chdir(repo)
    assert files.resolve("app/util.py") == "--- app/util.py ---\nfrom app import core\n"
    assert files.resolve("app/util.py::f") == "--- app/util.py::f ---\nfrom app import core\n\n[Symbol: f]"
    assert files.resolve("app").startswith("--- app/__init__.py ---\n\n--- app/core.py ---") and files.resolve("just words") == "just words"
    (repo / "void").mkdir()
    assert files.resolve("void") == "[empty directory: void]" and files.resolve("HEAD").startswith("--- git ")
    (repo / ".env").write_text("export SOME_KEY='abc'\n")
    assert files.api_key("SOME_KEY", repo) == "abc"
    with pytest.raises(RuntimeError):
        files.api_key("NO_SUCH_KEY", repo)


def test_store_versions(spark, tmp_path):
    s = store.SymbolStore(spark, f"file://{tmp_path}/s").ensure()
    row = lambda i, path, d="x": (i, path, "function", d, [0.0] * 256, "", [0.0] * 256, "h", "t", "a", 0, "r")
    make = lambda *rows: spark.createDataFrame(list(rows), s.schema)
    s.upsert(make(row("a::f", "a"), row("my_pkg/b::g", "my_pkg/b"), row("myXpkg/b::g", "myXpkg/b")))
    s.upsert(make(row("a::f", "a", "new")))
    s.upsert(make())
    assert s.read().count() == 3 and s.get_by_id("a::f").first().description == "new" and s.get_by_directory("my_pkg").count() == 1 and s.get_by_directory(".").count() == 3
    s.replace_files(make(row("a::h", "a")))
    s.delete_by_file("my_pkg/b")
    assert {r.id for r in s.read().collect()} == {"a::h", "myXpkg/b::g"}
    live = set(json.loads(sorted((tmp_path / "s").glob("CURRENT-*"))[-1].read_text())["versions"].values())
    assert live <= {p.name for p in (tmp_path / "s" / "versions").iterdir()} and len(live) == 2  # each bucket has its own
    found = s.get_by_file("a")
    assert "EqualTo(file_path,a)" in found._jdf.queryExecution().toString() and all(f"/bucket={s.bucket_of('a')}/" in f for f in found.inputFiles())
    with pytest.raises(Exception, match="not 256 numbers"):
        s.upsert(spark.createDataFrame([("z", "z", "function", None, [1.0], "", [0.0] * 256, "h", "t", "a", 0, "r")], s.schema))
    assert s.read().count() == 2


def symbol(i, path, d="x", vector=None):
    return (i, path, "function", d, vector or [0.0] * 256, "", [0.0] * 256, "h", "t", "a", 0, "r")


def test_store_survives_a_stop_at_any_point(spark, tmp_path, monkeypatch):
    home = tmp_path / "s"
    s = store.SymbolStore(spark, f"file://{home}").ensure()
    make = lambda *rows: spark.createDataFrame(list(rows), s.schema)
    rows = [symbol(f"{k}::f", str(k)) for k in range(50)]
    s.upsert(make(*rows))
    old, new = {r[0] for r in rows}, {r[0] for r in rows} | {"n::f"}
    ids = lambda: {r.id for r in store.SymbolStore(spark, f"file://{home}").read().collect()}

    class Stop(Exception):
        pass

    def stop(*_):
        raise Stop

    with monkeypatch.context() as m, pytest.raises(Stop):  # files of the version are there, no pointer
        m.setattr(store.SymbolStore, "_add", stop)
        s.upsert(make(symbol("n::f", "n")))
    assert ids() == old
    for garbage in ("", '{"buckets": 64, "vers'):  # the pointer is begun, not finished
        last = int(max(p.name for p in home.glob("CURRENT-*"))[-12:])
        (home / f"CURRENT-{last + 1:012d}").write_text(garbage)
        assert ids() == old
    s.upsert(make(symbol("n::f", "n")))
    assert ids() == new
    for pointer in sorted(home.glob("CURRENT-*"))[-1:]:  # the last pointer is lost: the table before it
        text = pointer.read_text()
        pointer.unlink()
        assert ids() == old
        pointer.write_text(text)
    for k in range(4):
        s.upsert(make(symbol(f"{k}::g", str(k))))
    assert len(ids()) == 55 and len(list(home.glob("CURRENT-*"))) <= 3
    before = len(list((home / "versions").iterdir()))
    s.vacuum(0)
    assert len(list((home / "versions").iterdir())) < before and len(ids()) == 55
    opened = s.read()
    s.delete_by_file("7")
    assert opened.count() == 55 and len(ids()) == 54
    with pytest.raises(Exception, match="exist"):  # another writer took the number
        last = s._numbers()[0]
        monkeypatch.setattr(store.SymbolStore, "_numbers", lambda self: [last - 1])
        s._add({"buckets": 64, "versions": {}})


def test_store_buckets_grow(spark, tmp_path):
    rnd = random.Random(1)
    s = store.SymbolStore(spark, f"file://{tmp_path}/s", buckets=2, grow=60_000).ensure()
    for k in range(4):
        s.upsert(spark.createDataFrame([symbol(f"{i}::f", str(i), vector=[rnd.random() for _ in range(256)]) for i in range(100 * k, 100 * k + 100)], s.schema))
    again = store.SymbolStore(spark, f"file://{tmp_path}/s")
    assert {r.id for r in again.read().collect()} == {f"{i}::f" for i in range(400)} and again.buckets > 4
    assert [r.id for r in again.get_by_id("333::f").collect()] == ["333::f"] and len(again.get_by_file("333").inputFiles()) == 1


def test_the_last_definition_wins(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("a", 2), ("b", 1)], "id string, v int").coalesce(1)
    assert {r.id: r.v for r in store.last_definition(rows).collect()} == {"a": 2, "b": 1}
    assert {r.id: r.v for r in store.last_definition(rows, order="v").collect()} == {"a": 3, "b": 2}
    assert {r.id: r.v for r in store.last_definition(rows.withColumnRenamed("v", "start_line")).withColumnRenamed("start_line", "v").collect()} == {"a": 3, "b": 2}


def test_stream_maintains_store(spark, tmp_path):
    from codeloom.streaming import incremental

    s = store.SymbolStore(spark, f"file://{tmp_path}/s").ensure()
    data = spark.createDataFrame([("a.py", "def f(): ...", 1), ("b.py", "def g(): ...", 1), ("a.py", "def h(): ...", 2)], "file_path string, content string, ts long")
    data.coalesce(1).write.parquet(f"{tmp_path}/in")

    def rows_of(batch):
        symbols = extract.extract_symbols(batch.select(F.col("file_path").alias("path"), "content"))
        zeros = F.array_repeat(F.lit(0.0).cast("float"), 256)
        return symbols.select(
            F.concat("file_path", F.lit("::"), "name").alias("id"), "file_path", "kind", F.lit(None).cast("string").alias("description"), zeros.alias("description_vector"), "signature", zeros.alias("signature_vector"),
            F.lit("h").alias("source_hash"), F.lit("t").alias("last_modified"), F.lit("a").alias("git_author"), F.lit(0).cast("bigint").alias("mutation_count"), F.lit("r").alias("repo_id"),
        )

    query = incremental.maintain(incremental.read_stream(spark, f"{tmp_path}/in", data), s, rows_of, f"{tmp_path}/c")
    query.awaitTermination(120)
    assert {r.id for r in s.read().collect()} == {"a.py::h", "b.py::g"}


def test_search_ties_and_zero_vectors(spark):
    from codeloom.operators import vector

    rows = spark.createDataFrame([("a", [1.0, 0.0], [0.0, 1.0]), ("b", [0.0, 1.0], [3.0, 4.0]), ("c", [3.0, 4.0], [3.0, 4.0]), ("m", [0.0, 0.0], [0.0, 0.0]), ("n", [0.0, 0.0], [-1.0, 0.0])], "id string, description_vector array<double>, signature_vector array<double>")
    found = vector.search_vectors(rows, [1.0, 0.0]).collect()
    assert [(r.id, round(r.similarity, 6), r.match_field) for r in found] == [("a", 1.0, "description"), ("b", 0.6, "signature"), ("c", 0.6, "description"), ("n", -1.0, "signature")]
    both = vector.search_vectors(rows, [1.0, 0.0])
    assert vector.at_least(both, 0.0).count() == 4 and vector.at_least(both, 0.1).count() == 3
    assert [r.id for r in vector.knn(rows, [1.0, 0.0], "description_vector", 2).collect()] == ["a", "c"]


@pytest.mark.parametrize("block", [1, 3, 100])
def test_many_queries_at_once(spark, block, monkeypatch):
    monkeypatch.setattr(vector, "STEP", 7)
    rnd = random.Random(4)
    rows = [(f"k{i:02d}", [rnd.choice([0.0, 1.0, -1.0]) for _ in range(4)]) for i in range(40)] + [("null", None), ("hole", [1.0, None, 0.0, 0.0]), ("zero", [0.0] * 4), ("copy", [1.0, 0.0, 0.0, 0.0]), ("also", [2.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id string, v array<float>").repartition(3)
    found = vector.knn_many(df, df, "v", 5, block=block).collect()

    def similar(a, b):
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)), 9)

    usable = [(k, x) for k, x in rows if x and None not in x and any(x)]
    want = {(k, other, s) for k, x in usable for s, other in sorted((-similar(x, y), o) for o, y in usable)[:5]}
    assert {(r.query, r.id, -r.similarity) for r in found} == want and len(found) == len(want)
    assert vector.knn_many(df, df.limit(0), "v").collect() == [] and vector.knn_many(df.limit(0), df, "v").collect() == []
    mixed = spark.createDataFrame([*rows, ("long", [1.0] * 9), ("nan", [math.nan] * 4), (None, [1.0] * 4)], "id string, v array<float>")
    two = mixed.withColumn("w", F.reverse("v"))
    pairs = vector.search_many(two, mixed, ["w", "v"], "v", 3, block=block, salts=4).collect()
    best = {}
    for k, x in usable:
        scored = sorted((-max(similar(x, y[::-1]), similar(x, y)), o, int(similar(x, y) > similar(x, y[::-1]))) for o, y in usable)
        best |= {(k, o, -s, c) for s, o, c in scored[:3]} and dict.fromkeys((k, o, -s, c) for s, o, c in scored[:3])
    assert {(r.query, r.id, r.similarity, r.column) for r in pairs} == {*best, ("long", "long", 1.0, 0)}


def test_models(spark):
    client = semantic.StubClient()
    rows = spark.createDataFrame([("x", ["aa", "b", "cccc"])], "t string, o array<string>")
    ranked = semantic.sem_rank(rows, F.lit("long"), F.col("o"), client).first()
    assert ranked.ranking == [3, 1, 2] and ranked.spread == "moderate"
    assert semantic.calls_of(semantic.generate(rows, F.col("t"), client, "p")).first().input_tokens == 1
    with pytest.raises(ValueError, match="unknown model"):
        semantic.generate(rows, F.col("t"), client, "p", "other-1")
    tries, waits = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("Rate limit reached")
        return "ok"

    assert semantic.with_retries(flaky, sleep=waits.append) == "ok" and waits == [1.0, 2.0]
    with pytest.raises(KeyError):
        semantic.with_retries(lambda: {}["x"], sleep=waits.append)
    assert semantic.token_limit_key("gpt-4.1") == "max_tokens" and semantic.token_limit_key("gpt-5.4") == "max_completion_tokens"
    assert "temperature" in semantic.Request("p", "c", "gpt-4.1").options() and "temperature" not in semantic.Request("p", "c", "gpt-5.4", effort="low").options()


class Service(BaseHTTPRequestHandler):
    """Speaks the public forms: echoes prompts, counts words; fails as the test says."""

    failures: list[int] = []
    asked: list[tuple] = []

    def log_message(self, *_):
        pass

    def do_POST(self):  # noqa: N802
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Service.asked.append((self.path, self.headers["Authorization"], body))
        if Service.failures:
            status, out = Service.failures.pop(0), {"error": {"message": "slow down"}}
        elif self.path.endswith("embeddings"):
            rows = [{"index": i, "embedding": [float(len(t))] * body["dimensions"]} for i, t in enumerate(body["input"])]
            status, out = 200, {"data": rows[::-1], "usage": {"total_tokens": len(rows)}}
        else:
            text = body["messages"][0]["content"] + "/" + body["messages"][1]["content"]
            choices = [{"index": i, "message": {"content": f"{text} {i}"}} for i in range(body["n"])]
            status, out = 200, {"choices": choices[::-1], "usage": {"prompt_tokens": 7, "completion_tokens": 3, "prompt_tokens_details": {"cached_tokens": 5}}}
        data = json.dumps(out).encode()
        self.send_response(status)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)


@pytest.fixture
def service(monkeypatch):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Service.failures, Service.asked = [], []
    monkeypatch.setattr(semantic.time, "sleep", lambda _: None)
    monkeypatch.setattr(semantic, "_CACHE", {})
    yield provider.HttpClient("secret", f"http://127.0.0.1:{server.server_port}/v1")
    server.shutdown()


def test_a_service_is_asked_in_its_form(service):
    got = semantic.ask_once(service, "p", "c", "gpt-4.1", n=2, form={"type": "object"})
    assert got.texts == ["p/c 0", "p/c 1"] and got.usage == {"input_tokens": 7, "output_tokens": 3, "cache_read": 5, "cache_creation": 0}
    path, key, body = Service.asked[0]
    assert path == "/v1/chat/completions" and key == "Bearer secret" and body["max_tokens"] == semantic.MAX_TOKENS and body["response_format"]["type"] == "json_schema" and body["temperature"] == 0.8
    assert service.embed(["a", "bbb"], 4, semantic.EMBED_MODEL) == ([[1.0] * 4, [3.0] * 4], 2)
    Service.failures = [429, 500]
    assert semantic.ask_once(service, "p", "other", "gpt-4.1").texts == ["p/other 0"]
    Service.failures = [400]
    with pytest.raises(provider.ServiceError, match="400: slow down"):
        semantic.ask_once(service, "p", "third", "gpt-4.1")
    Service.failures = [503] * 3
    with pytest.raises(provider.ServiceError, match="503"):
        semantic.ask_once(service, "p", "fourth", "gpt-4.1")


def test_tables_are_sent_to_a_service(spark, service):
    rows = spark.createDataFrame([("x",), ("y",)], "t string")
    assert sorted(r.answer.text for r in semantic.generate(rows, F.col("t"), service, "q").collect()) == ["q/x 0", "q/y 0"]
    assert {r.t: list(r.v) for r in rows.withColumn("v", semantic.embed(F.col("t"), service, 3)).collect()} == {"x": [1.0] * 3, "y": [1.0] * 3}
    gone = provider.HttpClient("k", "http://127.0.0.1:9")
    row = semantic.generate(rows, F.col("t"), provider.HttpClient("k", service.base_url + "x"), "q").first()
    assert row.answer.text is not None
    found = rows.select(semantic.embed_checked(F.col("t"), without_embeddings(), 3).alias("v")).collect()
    assert all(list(r.v.vector) == [0.0] * 3 and "no vectors today" in r.v.error for r in found) and gone.key == "k"


def without_embeddings():
    class Broken(semantic.StubClient):  # of a function, so that it travels to the workers
        def embed(self, texts, size, model):
            raise ValueError("no vectors today")

    return Broken()


def test_totals_run_on_and_start_again(spark):
    meter = semantic.Meter(spark)
    client = meter.client(semantic.StubClient())
    rows = spark.createDataFrame([(f"text {i}",) for i in range(6)], "t string")
    semantic.generate(rows, F.col("t"), client, "totals", "gpt-4.1").select("answer.text").collect()
    client.embed(["a b"], 4, semantic.EMBED_MODEL)
    first = meter.read()
    assert first["gpt-4.1"]["calls"] == 6 and first["gpt-4.1"]["input_tokens"] == 12 and first[semantic.EMBED_MODEL]["embedding_tokens"] == 2
    assert first["total"]["calls"] == 7 and first["total"]["dollars"] == pytest.approx(first["gpt-4.1"]["dollars"] + 2 * 0.02 / 1e6) and first["total"]["cache_hit_rate"] == 0
    meter.reset()
    assert meter.read()["total"]["calls"] == 0
    client.generate(semantic.Request("p", "c", "gpt-4.1"))
    assert meter.read()["gpt-4.1"]["calls"] == 1


def test_files_without_vectors_are_asked_again(spark, tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    (root / "m.py").write_text("def f():\n    return 1\n")
    symbols = store.SymbolStore(spark, f"file://{tmp_path}/s")
    run = lambda client: index.index_directory(spark, root, symbols, graph.ImportGraph.empty(spark), client)
    broken = run(without_embeddings()).files.first()
    assert broken.status == "indexed" and "no vectors today" in broken.error and symbols.read().count() == 2
    assert run(semantic.StubClient()).files.first().error is None and run(semantic.StubClient()).files.first().status == "skipped"
    assert any(any(r.signature_vector) for r in symbols.read().collect())


def random_edges(seed, nodes=30, n=45):
    import random

    rnd = random.Random(seed)
    return sorted({(f"n{rnd.randrange(nodes):02d}", f"n{rnd.randrange(nodes):02d}") for _ in range(n)})


def test_graph_ways_agree(spark, tmp_path):
    edges = random_edges(4)
    df = spark.createDataFrame(edges, "src string, dst string")
    for f in (lambda small: graph.descendants(df, edges[0][0], small), lambda small: graph.ancestors(df, edges[0][1], small), lambda small: graph.strong_components(df, small)):
        assert sorted(map(tuple, f(10_000).collect())) == sorted(map(tuple, f(1).collect()))
    acyclic = df.where("src < dst")
    layers = {r.file_path: r.layer for r in graph.topological_layers(acyclic).collect()}
    assert layers == {r.file_path: r.layer for r in graph.topological_layers(acyclic, small=1).collect()} and all(layers[r.src] < layers[r.dst] for r in acyclic.collect())
    closed = graph.closure(df)
    assert set(map(tuple, graph.closure(closed).collect())) == set(map(tuple, closed.collect()))
    g = graph.ImportGraph.of(spark.createDataFrame([("alone",)], "file_path string"), df)
    g.save(f"file://{tmp_path}/g.json")
    back = graph.ImportGraph.load(spark, f"file://{tmp_path}/g.json")
    assert set(map(tuple, back.edges.collect())) == set(edges) and "alone" in {r.file_path for r in back.files().collect()}
    assert graph.ImportGraph.load(spark, f"file://{tmp_path}/none.json").edge_count() == 0
    less = g.remove_file(edges[0][0])
    assert edges[0][0] not in {x for r in less.edges.collect() for x in r}
    assert {r.dst for r in g.update_file("alone", ["n01", "n02"]).edges.where("src = 'alone'").collect()} == {"n01", "n02"}
    assert [r.position for r in graph.node_positions(g.nodes).orderBy("file_path").collect()] == list(range(g.nodes.count()))


def test_large_graphs_are_saved_as_tables(spark, tmp_path):
    path = f"file://{tmp_path}/imports.json"
    edges = [(f"f{i}", f"f{i + 1}") for i in range(60)] + [("f60", "f0"), ("a", "f3")]
    make = lambda e: graph.ImportGraph.of(spark.createDataFrame([("lonely",)], "file_path string"), spark.createDataFrame(e, "src string, dst string"))
    for k in range(4):  # as a document, then as tables, and back
        make(edges[k:]).save(path, 10 if k % 3 else 1000)
        again = graph.ImportGraph.load(spark, path)
        assert {tuple(r) for r in again.edges.collect()} == set(edges[k:]) and "lonely" in {r.file_path for r in again.nodes.collect()}
        assert ("tables" in json.loads((tmp_path / "imports.json").read_text())) == bool(k % 3)
    again.update_file("a", []).save(path, 10)
    assert ("a", "f3") not in {tuple(r) for r in graph.ImportGraph.load(spark, path).edges.collect()}


def test_ways_of_large_graphs_on_chains_and_cycles(spark):
    edges = [(f"c{i}", f"c{i + 1}") for i in range(14)] + [("x", "y"), ("y", "z"), ("z", "x"), ("c3", "x"), ("z", "c9"), ("s", "s"), ("p", "q"), ("q", "p")]
    df = spark.createDataFrame(edges, "src string, dst string")
    want = {r.node: r.component for r in graph.strong_components(df).collect()}
    assert {r.node: r.component for r in graph.strong_components(df, small=0).collect()} == want and len(want) == len({x for e in edges for x in e})
    reach = {(a, b) for a in {x for e in edges for x in e} for b in graph._small.reached(edges, a)}
    assert {tuple(r) for r in graph.closure(df).collect()} == reach


@pytest.mark.parametrize("seed", [1])
def test_contracted_graphs_agree(spark, seed):
    rnd = random.Random(seed)
    edges, n = set(), 0
    for _ in range(25):  # chains between a few hubs, some of which close rings
        a, b, length = f"h{rnd.randrange(9)}", f"h{rnd.randrange(9)}", rnd.randrange(7)
        nodes = [a, *[f"n{n + k:03}" for k in range(length)], b]
        n += length
        edges |= {e for e in zip(nodes, nodes[1:], strict=False)}
    edges |= {(f"r{k}", f"r{(k + 1) % 5}") for k in range(5)} | {("a0", "a1"), ("a1", "a0"), ("t0", "t1"), ("t1", "t2")}
    df = spark.createDataFrame(sorted(edges), "src string, dst string")
    assert {tuple(r) for r in graph.strong_components(df, small=0).collect()} == set(graph._small.strong_components(sorted(edges)).items())
    order = {x: rnd.random() for e in edges for x in e}
    forward = sorted({(a, b) if order[a] < order[b] else (b, a) for a, b in edges if a != b})
    layers = graph.topological_layers(spark.createDataFrame(forward, "src string, dst string"), small=0)
    assert {tuple(r) for r in layers.collect()} == set(graph._small.layers(forward).items())
    with pytest.raises(graph.CycleError):
        graph.topological_layers(df, small=0)


def test_rounds_follow_the_logarithm_of_a_chain(spark, monkeypatch):
    n, rounds, kept = 3000, [], graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: rounds.append(1) or kept(df))
    chain = spark.range(n).select(F.format_string("n%05d", F.col("id")).alias("src"), F.format_string("n%05d", F.col("id") + 1).alias("dst"))
    layers = graph.topological_layers(chain, small=0)
    assert layers.where("int(substring(file_path, 2)) <> layer").count() == 0 and layers.count() == n + 1 and len(rounds) < 40
    rounds.clear()
    ring = chain.unionByName(spark.createDataFrame([(f"n{n:05}", "n00000")], "src string, dst string"))
    assert [tuple(r) for r in graph.cycles(ring, small=0).select("component", "size").collect()] == [("n00000", n + 1)] and len(rounds) < 40
