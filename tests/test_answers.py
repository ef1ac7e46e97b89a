"""Requests to model services: packing, refusals, answers that last, pace, and rankings of many options."""

import os
import random
import sys
import time
import uuid
from dataclasses import dataclass

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from codeloom.operators import answers, semantic, tournament
from codeloom.plans.services import CountingService
from codeloom.sources.provider import ServiceError

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't see this folder


@dataclass
class Noted:
    """A service that leaves a file for each call, and may fail or end its process."""

    folder: str
    refuse: str = "-"
    die_at: int = 0
    status: int = 400

    def calls(self) -> list[str]:
        return [open(f"{self.folder}/{x}").read() for x in sorted(os.listdir(self.folder)) if x.startswith("call-")]

    def _note(self, what: str) -> None:
        with open(f"{self.folder}/call-{time.time_ns()}-{uuid.uuid4().hex}", "w") as file:
            file.write(what)

    def generate(self, request):
        self._note(request.content)
        if self.die_at and len(self.calls()) > self.die_at and not os.path.exists(f"{self.folder}/died"):
            open(f"{self.folder}/died", "w").close()
            os._exit(1)
        if self.refuse in request.content:
            raise ServiceError(self.status, "no")
        return semantic.Answer([f"about {request.content}"], {"input_tokens": 1, "output_tokens": 2})

    def embed(self, texts, size, model):
        self._note(str(len(texts)))
        if any(self.refuse in t for t in texts):
            raise ServiceError(self.status, "no")
        return CountingService(items=100).embed(texts, size, model)


def test_requests_are_packed():
    assert semantic.packed([]) == [] and semantic.packed(["a"] * 5, 2) == [["a", "a"], ["a", "a"], ["a"]]
    assert semantic.packed(["a" * 30, "b" * 30, "c" * 300, "d"], tokens=25) == [["a" * 30, "b" * 30], ["c" * 300], ["d"]]
    rnd = random.Random(1)
    texts = ["é" * rnd.randrange(50) for _ in range(500)]
    found = semantic.packed(texts, 7, 40)
    assert [t for r in found for t in r] == texts and all(len(r) <= 7 and (len(r) == 1 or sum(1 + len(t.encode()) // semantic.TOKEN_BYTES for t in r) <= 40) for r in found)


def test_a_large_batch_gets_all_its_vectors(spark):
    rows = spark.range(10_000).select(F.concat(F.lit("text "), F.col("id").cast("string")).alias("t")).coalesce(1)
    found = rows.select("t", semantic.embed_checked(F.col("t"), CountingService(), 4).alias("e")).collect()  # 10,000 rows are one Arrow batch, and 2,048 inputs a request
    assert all(r.e.error is None and list(r.e.vector) == [len(r.t), 1, 1, 1] for r in found) and len(found) == 10_000


@pytest.mark.parametrize(("status", "errors"), [(400, {"bad 7", "bad 70"}), (401, None)])
def test_failures_stay_where_they_are(tmp_path, status, errors):
    texts = [f"{'bad' if k % 63 == 7 else 'fine'} {k}" for k in range(120)] * 2
    client = Noted(str(tmp_path), "bad", status=status)
    found = semantic.embed_texts(client, texts, 2, "m", items=64)
    assert set(found) == set(texts) and all((v is None) != (e is None) for v, e in found.values())
    wrong = {t for t, (_, e) in found.items() if e}
    assert wrong == errors if errors else wrong == set(texts)  # a wrong key isn't mended by smaller requests
    assert len(client.calls()) == 2 if errors is None else len(client.calls()) < 40


def test_requests_above_a_service_s_limit_are_halved(tmp_path):
    client = Noted(str(tmp_path))
    found = semantic.embed_texts(client, [f"t{k}" for k in range(300)], 2, "m")
    assert all(v[0] == len(t) for t, (v, _) in found.items()) and sorted(map(int, client.calls())) == [75, 75, 75, 75, 150, 150, 300]


def asked(spark, kept, client, texts, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    return {r.k: (r.answer.text, r.answer.error) for r in answers.generate(rows, F.col("t"), client, "p", kept, concurrency=4, **options).collect()}


def test_answers_last(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    client, kept = Noted(str(tmp_path / "calls"), "bad"), answers.AnswerStore(spark, f"file://{tmp_path}/store", 2)
    texts = ["a", "b", "a", None, "bad", "a"]
    want = {0: "about a", 1: "about b", 2: "about a", 3: "about ", 5: "about a"}
    found = asked(spark, kept, client, texts)
    assert {k: v for k, (v, e) in found.items() if e is None} == want and found[4][0] is None and "no" in found[4][1]
    assert sorted(client.calls()) == ["", "a", "b", "bad"]
    again = asked(spark, answers.AnswerStore(spark, kept.path, 2), client, texts)
    assert again == found and sorted(client.calls()) == ["", "a", "b", "bad", "bad"]  # what failed is asked again, nothing else
    assert asked(spark, kept, client, [])  == {}
    asked(spark, kept, client, ["a"], temperature=0.1)
    assert client.calls().count("a") == 2  # another request
    with pytest.raises(ValueError, match="unknown model"):
        asked(spark, kept, client, ["a"], model="other")


def test_a_lost_task_asks_its_open_requests_again(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    client, kept = Noted(str(tmp_path / "calls"), die_at=30), answers.AnswerStore(spark, f"file://{tmp_path}/store", 2)
    texts = [f"t{k}" for k in range(60)]
    with pytest.raises(Exception):  # noqa: B017, PT011  on one machine a task isn't made again, and the call fails
        asked(spark, kept, client, texts, tasks=1)
    assert kept.table.read().count() == 0
    found = asked(spark, kept, client, texts, tasks=1)
    assert {v for v, _ in found.values()} == {f"about t{k}" for k in range(60)} and 60 <= len(client.calls()) <= 64


def test_a_task_made_again_reads_its_journal(spark, tmp_path, monkeypatch):
    (tmp_path / "calls").mkdir()
    client, kept = Noted(str(tmp_path / "calls")), answers.AnswerStore(spark, f"file://{tmp_path}/store", 2)
    monkeypatch.setattr(kept, "recover", lambda: 0)
    monkeypatch.setattr(answers.uuid, "uuid4", lambda: uuid.UUID(int=7))
    request = spark.range(1).select(answers.requests_of(F.lit("a"), "p", semantic.SCORE_MODEL, {})).first()[0]
    journal = answers.Journal(kept.journals, uuid.UUID(int=7).hex)
    journal.write(0, [{"request": request, "text": "had", "model": "m"}])
    (tmp_path / "store/journals" / uuid.UUID(int=7).hex / "0-x.open").write_text("{half")
    assert journal.read(0)[request]["text"] == "had" and journal.read(1) == {}
    assert asked(spark, kept, client, ["a", "b"], tasks=1) == {0: ("had", None), 1: ("about b", None)} and client.calls() == ["b"]


def test_pace():
    slept, at = [], [0.0]
    pace = answers.Pace(60, lambda: at[0], slept.append)
    for want in (0.0, 1.0, 2.0):
        assert pace.turn() == want
    pace.wait(2.0)
    at[0] = 10.0
    assert pace.turn() == 10.0 and slept == [2.0] and answers.Pace(None, lambda: 5.0).turn() == 5.0


@dataclass(frozen=True)
class Judge(CountingService):
    """Ranks by the number an option begins with; may leave the last option out, or refuse a prompt that holds a word."""

    forget: bool = False
    refuse: str = "-"
    most: int = 20

    def generate(self, request):
        if self.refuse in request.content:
            raise ServiceError(400, "no")
        assert request.content.count("OPTION ") <= self.most
        got = super().generate(request)
        if self.forget:
            lines = got.texts[0].splitlines()
            got.texts[0] = "\n".join([*lines[:-2], lines[0], "9. OPTION 99", lines[-1]])
        return got


def ranked(spark, rows, client, most=20):
    found = tournament.rank_many(spark.createDataFrame(rows, "ranking string, criteria string, id string, text string"), client, most).collect()
    out = {}
    for r in sorted(found, key=lambda r: (r.ranking, r.rank)):
        out.setdefault(r.ranking, []).append(r.id)
        assert r.rank == len(out[r.ranking])
    return out, {r.ranking: r.failed for r in found}


@pytest.mark.parametrize(("most", "n"), [(4, 30), (20, 1500)])
def test_many_options_are_ranked_a_few_at_a_time(spark, most, n):
    rnd = random.Random(n)
    rows = [("big", "c", f"o{k}", f"{v} text") for k, v in enumerate(rnd.sample(range(10**6), n))] + [(f"r{g}", None, f"o{k}", f"{g * 100 + (k * 7) % 11} t") for g in range(4) for k in range(1 + g * 3)] + [("", "c", "one", "5")]
    found, failed = ranked(spark, rows, Judge(most=most), most)
    want = {}
    for r in sorted(rows, key=lambda r: -int(r[3].split()[0])):
        want.setdefault(r[0], []).append(r[2])
    assert found == want and set(failed.values()) == {0}


def test_rankings_of_bad_answers_are_whole(spark):
    rows = [("a", "c", f"o{k:02}", f"{k} text") for k in range(40)] + [("b", "c", f"o{k:02}", f"{k} bad") for k in range(20)]
    found, failed = ranked(spark, rows, Judge(forget=True), 8)
    assert sorted(found["a"]) == [f"o{k:02}" for k in range(40)] and sorted(found["b"]) == [f"o{k:02}" for k in range(20)]
    found, failed = ranked(spark, rows, Judge(refuse="bad"), 8)
    assert found["a"] == [f"o{k:02}" for k in reversed(range(40))] and failed["a"] == 0 < failed["b"] and sorted(found["b"]) == [f"o{k:02}" for k in range(20)]
    assert ranked(spark, [], Judge())[0] == {}
    with pytest.raises(ValueError, match="four"):
        ranked(spark, rows, Judge(), 3)


class Emptied(dict):
    """A cache that another thread empties as soon as something is in it, and before it is read."""

    def __setitem__(self, key, value):
        super().__setitem__(key, value)
        self.clear()

    def __contains__(self, key):
        return super().__contains__(key) or bool(self.clear())


def test_answers_outlive_an_emptied_cache(monkeypatch):
    monkeypatch.setattr(semantic, "_CACHE", Emptied())
    request = semantic.Request("p", "abcd", "gpt-4.1")
    assert [semantic.answer(CountingService(), request).texts for _ in range(2)] == [["SCORE: 4/10 - counted"]] * 2


def test_orders_of_answers():
    assert tournament.order_of("1. OPTION 2 - x\n2. OPTION 1\n3. OPTION 2\nSPREAD: wide", 3) == [1, 0, 2] and tournament.order_of(None, 2) == [0, 1] and tournament.order_of("1. OPTION 7", 1) == [0]
