"""Scalar functions against worked examples."""

import pytest
from pyspark.sql import functions as F

from codeloom import functions as fn
from codeloom.operators import cost, edit, semantic


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("signature", "args", "returns"),
    [
        ("def foo(x: int, y: str) -> bool:", "x: int, y: str", "bool"), ("def bar():", "", None), ("class Foo(Base):", None, None), ("def h(x=()) -> int:", None, None),
        ("async def é(a,\n   b):", "a, b", None), ("def f(a) -> dict[str, int] :", "a", "dict[str, int]"), ("", None, None),
        ("def f g():", None, None), ("def f()->int:", "", "int"), ("def f() x:", None, None), ("def f():\n", None, None), ("async  def\tf( a )  -> x\n -> y:", "a", "x -> y"), ("def ():", None, None), ("def f(", None, None), ("def f)(:", None, None),
    ],
)
def test_signatures(spark, signature, args, returns):
    assert (one(spark, fn.signature_args(F.lit(signature))), one(spark, fn.signature_returns(F.lit(signature)))) == (args, returns)


@pytest.mark.parametrize(("symbol", "name"), [("p/f.py::C.m", "C.m"), ("p/f.py::__module__", "__module__"), ("plain", "plain"), ("a::b::c", "b::c")])
def test_name_from_id(spark, symbol, name):
    assert one(spark, fn.name_from_id(F.lit(symbol))) == name


@pytest.mark.parametrize(("url", "repo"), [("https://github.com/o/r.git", "o/r"), ("git@github.com:o/r.git", "o/r"), ("https://h/o/r/", "o/r"), ("ssh://git@h/o/r", "o/r")])
def test_repo_ids(spark, url, repo):
    assert one(spark, fn.repo_id_from_url(F.lit(url))) == repo


@pytest.mark.parametrize(("text", "holds"), [("\n true because", True), ("FALSE\nTRUE", False), ("", False), ("TRUEISH", True), ("**TRUE**", False), (None, False), ("  \r\n\tTrue", True)])
def test_verdicts(spark, text, holds):
    assert one(spark, fn.verdict(F.lit(text).cast("string"))) is holds
    assert semantic.is_true(text or "") is holds


@pytest.mark.parametrize(
    ("text", "first", "last", "new", "want"),
    [("a\nb\nc\n", 2, 2, "x\ny", "a\nx\ny\nc\n"), ("a\nb", 1, 2, "z", "z"), ("a\r\nb\r\n", 2, 2, "c", "a\nc\n"), ("a\nb\n\n", 1, 1, "q", "q\nb\n\n"), ("a\nb\nc", 3, 3, "c", "a\nb\nc")],
)
def test_splice(spark, text, first, last, new, want):
    assert one(spark, fn.splice_lines(F.lit(text), F.lit(first), F.lit(last), F.lit(new))) == want
    assert edit.splice(text, first, last, new) == want


def test_lines(spark):
    assert one(spark, fn.slice_lines(F.lit("a\nb\nc"), F.lit(2), F.lit(9))) == "b\nc"
    assert one(spark, fn.slice_lines(F.lit("a\nb\nc"), F.lit(0), F.lit(1))) == "a"
    assert one(spark, fn.diff_stat(F.lit("a\n"), F.lit("a\nb\n"))) == edit.diff_stat("a\n", "a\nb\n") == "diff: 1 -> 2 lines (+1)"
    assert one(spark, fn.diff_stat(F.lit("a\nb\n"), F.lit("a\n"))) == "diff: 2 -> 1 lines (-1)"


def test_paths(spark):
    assert [one(spark, fn.directory_of(F.lit(p))) for p in ("a/b/c.py", "c.py")] == ["a/b", "."]
    assert [one(spark, fn.in_excluded_directory(F.lit(p))) for p in ("a/.venv/c.py", ".venv", ".claude/.venv/x.py", ".claude/x.py")] == [True, False, True, False]
    assert one(spark, fn.repo_relative(F.lit("/r/a.py"), "/r")) == "a.py" and one(spark, fn.repo_relative(F.lit("a.py"), "/r")) == "a.py"
    assert one(spark, fn.escape_attribute(F.lit('a "b" & c'))) == "a &quot;b&quot; & c"


def test_cosine(spark):
    v = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, fn.cosine(v(1.0, 0.0), v(3.0, 4.0))) == pytest.approx(0.6)
    assert one(spark, fn.cosine(v(0.0, 0.0), v(3.0, 4.0))) is None


def test_costs(spark):
    calls = spark.createDataFrame([("gpt-5.4-mini", 1_000_000, 100_000, 400_000, 0, 0), ("text-embedding-3-small", 0, 0, 0, 0, 500_000), ("nobody", 5, 5, 0, 0, None)], "model string, input_tokens long, output_tokens long, cache_read long, cache_creation long, embedding_tokens long")
    found = {r.model: r for r in cost.totals(cost.priced(calls, cost.rates(spark))).collect()}
    assert found["gpt-5.4-mini"].dollars == pytest.approx(0.93) and found["gpt-5.4-mini"].cache_hit_rate == pytest.approx(0.4)
    assert found["text-embedding-3-small"].dollars == pytest.approx(0.01) and found["text-embedding-3-small"].cache_hit_rate == 0
    assert found["nobody"].dollars == 0 and found[None].dollars == pytest.approx(0.94) and found[None].calls == 3


def test_commit_messages(spark):
    changes = [edit.Change("f", None, "new f", "TRUE", True), edit.Change("g", "old g", "new g", "TRUE", True), edit.Change("h", "old h", "new h", "TRUE", False, "TRUE")]
    text = edit.commit_message("a.py", changes, "a\n", "a\nb\n")
    rows = spark.createDataFrame([([tuple(vars(c).values()) for c in changes],)], "c array<struct<name:string,old_comment:string,new_comment:string,fidelity_evidence:string,prudence_skipped:boolean,prudence_evidence:string>>")
    assert rows.select(fn.commit_message(F.lit("a.py"), F.col("c"), F.lit("diff: 1 -> 2 lines (+1)")).alias("m")).first().m == text
    assert text.startswith("codeloom: f @ a.py\n\nold: (none)\nnew: new f\n\nfidelity: TRUE\nprudence: skipped (no old comment)\n\n---\n\n") and text.endswith("prudence: TRUE\n\ndiff: 1 -> 2 lines (+1)") and "prudence: force" in text


def test_skill_costs():
    said = []
    text = semantic.run_skill("score", "QUALITY\na b\nTARGET\na b c", semantic.StubClient(), "gpt-4.1", semantic.PROMPTS["score"], n=2, log=said.append)
    assert text.count("SCORE: ") == 2 and "\n---\n" in text and said[0].startswith("score: gpt-4.1, $0.0")
    assert cost.call_dollars("gpt-5.4-mini", {"input_tokens": 1_000_000, "output_tokens": 100_000, "cache_read": 400_000}) == pytest.approx(0.93)
    assert cost.call_dollars("text-embedding-3-small", {"embedding_tokens": 500_000}) == pytest.approx(0.01) and cost.call_dollars("nobody", {"input_tokens": 9}) == 0


def test_cosine_to_a_vector_is_the_cosine(spark):
    rows = spark.createDataFrame([([1.0, 2.0, 3.0],), ([0.0, 0.0, 0.0],), (None,), ([-3.0, 0.5, 1.0],), ([1.0, 2.0],)], "v array<float>")
    for q in ([2.0, -1.0, 0.5], [0.0, 0.0, 0.0]):
        found = rows.select(fn.cosine("v", F.array(*map(F.lit, q))).alias("a"), fn.cosine_to(F.col("v"), q).alias("b")).collect()
        assert all((r.a is None) == (r.b is None) and (r.a is None or abs(r.a - r.b) < 1e-12) for r in found)
