"""Operators that ask a language model: map, extract, filter, score, rank, embed.

A ``ModelClient`` answers; the engine brings the rows to it in Arrow batches, a bounded number of calls at a time, and returns usage as columns. Tasks may run twice: answers are
cached in a worker by (client, model, prompt, content), and results should be written before they are used twice. ``StubClient`` needs no network and answers
by rule.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import struct
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import score_value, verdict
from codeloom.operators.cost import call_dollars
from codeloom.schema import DESCRIPTION, EMBED_SIZE, VECTOR_SIZE

ATTEMPTS, CONCURRENCY, MAX_TOKENS = 3, 10, 4096
DESCRIBE_MODEL, ASSERT_MODEL, SCORE_MODEL, RANK_MODEL, EMBED_MODEL = "gpt-5.4-mini", "gpt-4.1", "gpt-4.1-mini", "gpt-4.1", "text-embedding-3-small"
RESULT = "text string, structured string, texts array<string>, error string, model string, input_tokens bigint, output_tokens bigint, cache_read bigint, cache_creation bigint, embedding_tokens bigint"
_RESULT_NAMES = [x.split()[0] for x in RESULT.split(", ")]

PROMPTS = {
    "describe": "Describe a Python module for readers who know the language. Give one sentence for the module, and one for each function, class and method listed. Say what it does and for whom, not how. Answer in the given JSON form.",
    "assert": "You judge one claim about two artifacts; A is the reference, B is what is judged. Split the claim into parts and test each against the text. Answer TRUE on the first line only if every part holds, otherwise FALSE; then the evidence, briefly.",
    "score": "You rate how well a target shows one quality, from 0 (absent) to 10 (nothing to deduct). Answer `SCORE: n/10 - reason`, then a list of deductions that add up to what is missing from ten.",
    "rank": "You order the options by the criteria, best first. Answer a numbered list `n. OPTION k - reason`, then a line `SPREAD: tight`, `SPREAD: moderate` or `SPREAD: wide`.",
    "fidelity": "A says what a piece of code is meant to do; B is the code. Judge the claim.",
    "prudence": "A is the old comment of a piece of code, B the new one. Judge the claim.",
}
DESCRIPTION_FORM = {
    "type": "object", "additionalProperties": False, "required": ["module_description", "symbols"],
    "properties": {
        "module_description": {"type": "string"},
        "symbols": {"type": "array", "items": {"type": "object", "additionalProperties": False, "required": ["name", "kind", "parent", "description"],
                    "properties": {"name": {"type": "string"}, "kind": {"type": "string"}, "parent": {"type": ["string", "null"]}, "description": {"type": "string"}}}},
    },
}


@dataclass
class Request:
    prompt: str
    content: str
    model: str
    temperature: float | None = 0.8
    max_tokens: int = MAX_TOKENS
    form: dict | None = None
    n: int = 1
    effort: str | None = None

    def options(self) -> dict[str, Any]:
        """Keyword arguments in the form of the public chat API."""
        out: dict[str, Any] = {"model": self.model, "n": self.n, token_limit_key(self.model): self.max_tokens}
        if self.model.startswith("gpt-5"):
            out |= {"reasoning_effort": self.effort} if self.effort else {}
        elif self.temperature is not None:
            out["temperature"] = self.temperature
        if self.form is not None:
            out["response_format"] = {"type": "json_schema", "json_schema": {"name": "answer", "strict": True, "schema": self.form}}
        return out


@dataclass
class Answer:
    texts: list[str]
    usage: dict[str, int] = field(default_factory=dict)


class ModelClient(Protocol):
    def generate(self, request: Request) -> Answer: ...

    def embed(self, texts: list[str], size: int, model: str) -> tuple[list[list[float]], int]: ...


def token_limit_key(model: str) -> str:
    return "max_tokens" if model.startswith(("gpt-3.5", "gpt-4-", "gpt-4.")) else "max_completion_tokens"


def is_retryable(error: BaseException) -> bool:
    status = getattr(error, "status_code", None) or getattr(error, "status", None)
    return status == 429 or isinstance(status, int) and 500 <= status < 600 or any(x in str(error).lower() for x in ("rate limit", "overloaded"))


def with_retries(call: Callable[[], Any], attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> Any:
    """The call's result; failures worth a retry wait 1 s, then 2 s."""
    for k in range(attempts):
        try:
            return call()
        except Exception as e:
            if k + 1 == attempts or not is_retryable(e):
                raise
            sleep(2.0**k)
    raise AssertionError


class StubClient:
    """Answers by rule, without a network: embeddings are hashed words, descriptions are templates, verdicts compare words."""

    def generate(self, request: Request) -> Answer:
        text = self._answer(request)
        return Answer([text] * request.n, {"input_tokens": len((request.prompt + request.content).split()), "output_tokens": len(text.split()) * request.n})

    @staticmethod
    def _answer(request: Request) -> str:
        prompt, content = request.prompt, request.content
        if request.form is DESCRIPTION_FORM or request.form == DESCRIPTION_FORM:
            names = re.findall(r"^- (\w+) (\S+)$", content, re.MULTILINE)
            symbols = [{"name": n.rpartition(".")[2], "kind": k, "parent": n.rpartition(".")[0] or None, "description": f"The {k} {n}."} for k, n in names]
            return json.dumps({"module_description": f"Module of {len(symbols)} symbols.", "symbols": symbols})
        words = [set(re.findall(r"\w+", part.lower())) for part in re.split(r"^ARTIFACT [AB]:?$|^QUALITY:?$|^TARGET:?$", content, flags=re.MULTILINE)]
        if prompt == PROMPTS["score"]:
            shared = len(words[-1] & words[-2]) if len(words) > 1 else 0
            n = min(10, shared)
            return f"SCORE: {n}/10 - {shared} words are shared\n- missing words: {10 - n}"
        if prompt == PROMPTS["rank"]:
            options = re.findall(r"^OPTION (\d+):\n(.*?)(?=^OPTION |\Z)", content, re.MULTILINE | re.DOTALL)
            order = sorted(options, key=lambda o: (-len(o[1].strip()), int(o[0])))
            return "\n".join(f"{i}. OPTION {k} - {len(o.strip())} characters" for i, (k, o) in enumerate(order, 1)) + "\nSPREAD: moderate"
        return "FALSE\nan artifact is empty" if len(words) > 2 and not all(words[1:]) else "TRUE\nboth artifacts are there"

    def embed(self, texts: list[str], size: int, model: str) -> tuple[list[list[float]], int]:
        out = []
        for text in texts:
            vector = [0.0] * size
            for word in re.findall(r"\w+", text.lower()):
                at, sign = struct.unpack("<IB", hashlib.sha256(word.encode()).digest()[:5])
                vector[at % size] += 1.0 if sign & 1 else -1.0
            length = math.sqrt(sum(x * x for x in vector)) or 1.0
            out.append([x / length for x in vector])
        return out, sum(len(t.split()) for t in texts)


_COUNTS = ("calls", "input_tokens", "output_tokens", "cache_read", "cache_creation", "embedding_tokens")


class _Sums(AccumulatorParam):
    """Counters by model and name."""

    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, a: dict, b: dict) -> dict:  # noqa: N802  the name that Spark calls
        for key, n in b.items():
            a[key] = a.get(key, 0) + n
        return a


@dataclass
class MeteredClient:
    """A client whose calls are counted where a Meter reads them, from the driver and from the workers."""

    inner: ModelClient
    sums: Any

    def generate(self, request: Request) -> Answer:
        got = self.inner.generate(request)
        self.sums.add({(request.model, "calls"): 1} | {(request.model, k): v or 0 for k, v in got.usage.items() if k in _COUNTS})
        return got

    def embed(self, texts: list[str], size: int, model: str) -> tuple[list[list[float]], int]:
        vectors, tokens = self.inner.embed(texts, size, model)
        self.sums.add({(model, "calls"): 1, (model, "embedding_tokens"): tokens})
        return vectors, tokens


class Meter:
    """Running totals of all calls through ``client``: read at any time, set to zero by ``reset``. Calls of a task that runs twice count twice, as they cost twice; cached answers cost nothing."""

    def __init__(self, spark: SparkSession) -> None:
        self._sums = spark.sparkContext.accumulator({}, _Sums())
        self._before: dict = {}

    def client(self, inner: ModelClient) -> MeteredClient:
        return MeteredClient(inner, self._sums)

    def read(self) -> dict[str, dict[str, float]]:
        """Counts, dollars and cache_hit_rate by model, and over all models as ``total``."""
        now = {k: n - self._before.get(k, 0) for k, n in self._sums.value.items()}
        out: dict[str, dict[str, float]] = {}
        for model in sorted({m for m, _ in now}):
            own = {c: now.get((model, c), 0) for c in _COUNTS}
            if any(own.values()):
                out[model] = own | {"dollars": call_dollars(model, own)}
        out["total"] = {c: sum(m[c] for m in out.values()) for c in (*_COUNTS, "dollars")}
        for sums in out.values():
            asked = sums["input_tokens"] + sums["cache_creation"]
            sums["cache_hit_rate"] = sums["cache_read"] / asked if asked else 0.0
        return out

    def reset(self) -> None:
        self._before = dict(self._sums.value)


_CACHE: dict[tuple, Answer] = {}


def answer(client: ModelClient, request: Request) -> Answer:
    """A client's answer with retries, cached in this process by client and request. Only models named gpt-... are known."""
    if not request.model.startswith("gpt-"):
        raise ValueError(f"unknown model: {request.model}")
    key = (request.model, hashlib.sha256(f"{getattr(client, 'inner', client)!r}\0{request.prompt}\0{request.content}\0{request.n}\0{request.effort}\0{request.form is not None}".encode()).digest())
    found = _CACHE.get(key)
    if found is None:
        found = with_retries(lambda: client.generate(request))
        if len(_CACHE) > 10_000:
            _CACHE.clear()  # at any time, by any thread of the process: what is in the cache is only read by get
        _CACHE[key] = found
    return found


def _structured(text: str, form: dict | None) -> str | None:
    if form is None:
        return None
    try:
        return json.dumps(json.loads(text))
    except ValueError:
        return None


def generate(rows: DataFrame, content: Column, client: ModelClient, prompt: str, model: str = SCORE_MODEL, concurrency: int = CONCURRENCY, **options: Any) -> DataFrame:
    """``rows`` with the struct ``answer`` (RESULT) for each; a failed call has an error and no text. Results keep the rows' order within a batch."""
    if not model.startswith("gpt-"):
        raise ValueError(f"unknown model: {model}")

    def one(text: str | None) -> dict:
        request = Request(prompt, text or "", model, **options)
        empty = dict.fromkeys(_RESULT_NAMES) | {"model": model}
        try:
            got = answer(client, request)
        except Exception as e:
            return empty | {"error": f"{type(e).__name__}: {e}"}
        return empty | {"text": got.texts[0], "structured": _structured(got.texts[0], request.form), "texts": got.texts, **got.usage}

    @F.pandas_udf(RESULT)
    def ask(texts: pd.Series) -> pd.DataFrame:
        with ThreadPoolExecutor(concurrency) as pool:
            found = pd.DataFrame(list(pool.map(one, texts)), columns=_RESULT_NAMES)
        return found.astype({c: "Int64" if k >= 5 else object for k, c in enumerate(_RESULT_NAMES)})

    return rows.withColumn("answer", ask.asNondeterministic()(content))


#: What public embedding services take in one request.
EMBED_ITEMS, EMBED_TOKENS = 2048, 300_000
#: Bytes for a token, at least, that requests are packed by; a denser text makes a request too large, which is then split.
TOKEN_BYTES = 3


def is_refused(error: BaseException) -> bool:
    """Whether a service has refused what it was given, so that a part of it may pass: too many inputs, or one that it doesn't take."""
    return (getattr(error, "status_code", None) or getattr(error, "status", None)) in (400, 413, 422)


def packed(texts: list[str], items: int = EMBED_ITEMS, tokens: int = EMBED_TOKENS) -> list[list[str]]:
    """The texts in order, in requests of at most so many inputs and tokens by estimate; a text above that stands alone."""
    out, room = [], 0
    for text in texts:
        size = 1 + len(text.encode(errors="replace")) // TOKEN_BYTES
        if not out or len(out[-1]) == items or size > room:
            out.append([])
            room = tokens
        out[-1].append(text)
        room -= size
    return out


def embed_texts(client: ModelClient, texts: list[str], size: int, model: str, concurrency: int = CONCURRENCY, items: int = EMBED_ITEMS, tokens: int = EMBED_TOKENS) -> dict[str, tuple[list[float] | None, str | None]]:
    """For each distinct text its vector, or the error of its own request. A refused request is halved until what is refused stands alone; other failures, after their retries, stay with that request."""

    def ask(request: list[str]) -> list[tuple[list[float] | None, str | None]]:
        try:
            return [(v, None) for v in with_retries(lambda: client.embed(request, size, model))[0]]
        except Exception as e:
            if len(request) > 1 and is_refused(e):
                half = len(request) // 2
                return ask(request[:half]) + ask(request[half:])
            return [(None, f"{type(e).__name__}: {e}")] * len(request)

    distinct = list(dict.fromkeys(texts))
    requests = packed(distinct, items, tokens)
    if len(requests) < 2:
        found = [ask(r) for r in requests]
    else:
        with ThreadPoolExecutor(concurrency) as pool:
            found = list(pool.map(ask, requests))
    return dict(zip(distinct, [x for part in found for x in part], strict=True))


def embed_checked(text: Column, client: ModelClient, size: int = EMBED_SIZE, model: str = EMBED_MODEL, items: int = EMBED_ITEMS, tokens: int = EMBED_TOKENS) -> Column:
    """A struct of vector and error for a text column: zeros for null and empty texts, and zeros with an error where the request fails. An Arrow batch goes in as many requests as the service's limits ask for, equal texts once."""

    @F.pandas_udf("vector array<float>, error string")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = embed_texts(client, [t for t in texts if t], size, model, items=items, tokens=tokens)
        rows = [found[t] if t else (None, None) for t in texts]
        return pd.DataFrame({"vector": [[0.0] * size if v is None else v for v, _ in rows], "error": [e for _, e in rows]})

    return run(text)


def embed(text: Column, client: ModelClient, size: int = EMBED_SIZE, model: str = EMBED_MODEL) -> Column:
    """Vectors of a text column; zeros for null and empty texts, and where the request fails."""
    return embed_checked(text, client, size, model)["vector"]


def embed_for_store(text: Column, client: ModelClient) -> Column:
    return embed(text, client, VECTOR_SIZE)


def embed_query(text: str, client: ModelClient, size: int = VECTOR_SIZE) -> list[float]:
    return with_retries(lambda: client.embed([text], size, EMBED_MODEL))[0][0]


def calls_of(answered: DataFrame) -> DataFrame:
    """The call facts of ``generate``'s rows."""
    counts = [F.coalesce(F.col(f"answer.{c}"), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "cache_read", "cache_creation", "embedding_tokens")]
    return answered.select("answer.model", *counts)


def describe_modules(files: DataFrame, symbols: DataFrame, client: ModelClient, model: str = DESCRIBE_MODEL, effort: str | None = "medium") -> DataFrame:
    """file_path, description (struct) and error of each file (path, content), asked with the list of its symbols."""
    listed = symbols.where(F.col("name").isNotNull()).groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("start_line", F.concat(F.lit("- "), "kind", F.lit(" "), "name").alias("line")))).alias("s"))
    joined = files.join(listed.hint("merge"), files.path == listed.file_path, "left").select(files.path.alias("file_path"), "content", F.array_join(F.transform("s", lambda x: x.line), "\n").alias("lines"))
    asked = generate(joined, F.concat(F.lit("SYMBOLS\n"), F.coalesce("lines", F.lit("")), F.lit("\nSOURCE\n"), F.col("content")), client, PROMPTS["describe"], model, form=DESCRIPTION_FORM, effort=effort)
    parsed = F.from_json("answer.structured", f"struct<{DESCRIPTION.replace(' string,', ':string,').replace('symbols array', 'symbols:array')}>")
    return asked.select("file_path", parsed.alias("description"), F.when(parsed.isNull(), F.lit("LLM returned no structured output")).alias("error"), "answer")


def match_descriptions(symbols: DataFrame, described: DataFrame) -> DataFrame:
    """Symbols (file_path, name, parent, ...) with their description: same file, bare name and parent, where no parent equals no parent; of several the last counts."""
    each = described.select("file_path", F.posexplode("description.symbols").alias("pos", "s")).select("file_path", "pos", F.col("s.name").alias("bare"), F.nullif("s.parent", F.lit("")).alias("owner"), F.col("s.description").alias("found"))
    last = each.where(F.length("found") > 0).groupBy("file_path", "bare", "owner").agg(F.max_by("found", "pos").alias("description"))
    s, d = symbols.alias("s"), last.alias("d").hint("merge")
    same = (F.col("s.file_path") == F.col("d.file_path")) & (F.substring_index("s.name", ".", -1) == F.col("d.bare")) & F.col("s.parent").eqNullSafe(F.col("d.owner"))
    return s.join(d, same, "left").select("s.*", "d.description")


def _ask_pair(first: str, a: Column, second: str, b: Column) -> Column:
    return F.concat(F.lit(f"{first}\n"), a, F.lit(f"\n{second}\n"), b)


def sem_assert(rows: DataFrame, claim: Column, a: Column, b: Column, client: ModelClient, model: str = ASSERT_MODEL, prompt: str = PROMPTS["assert"]) -> DataFrame:
    """``rows`` with holds (boolean) and evidence."""
    content = F.concat(F.lit("CLAIM\n"), claim, F.lit("\n"), _ask_pair("ARTIFACT A", a, "ARTIFACT B", b))
    asked = generate(rows, content, client, prompt, model)
    return asked.select(*rows.columns, verdict(F.coalesce("answer.text", F.lit(""))).alias("holds"), F.col("answer.text").alias("evidence"))


def sem_filter(rows: DataFrame, claim: Column, a: Column, b: Column, client: ModelClient, model: str = ASSERT_MODEL) -> DataFrame:
    """The rows for which the claim holds."""
    return sem_assert(rows, claim, a, b, client, model).where("holds").select(*rows.columns)


def sem_score(rows: DataFrame, quality: Column, target: Column, client: ModelClient, model: str = SCORE_MODEL) -> DataFrame:
    """``rows`` with the answer as score_text, and its number as score."""
    asked = generate(rows, _ask_pair("QUALITY", quality, "TARGET", target), client, PROMPTS["score"], model)
    return asked.select(*rows.columns, F.col("answer.text").alias("score_text"), score_value(F.col("answer.text")).alias("score"))


def sem_rank(rows: DataFrame, criteria: Column, options: Column, client: ModelClient, model: str = RANK_MODEL) -> DataFrame:
    """``rows`` with rank_text, ranking (option numbers, best first) and spread, for an array of options."""
    listed = F.array_join(F.transform(options, lambda o, i: F.concat(F.lit("OPTION "), (i + 1).cast("string"), F.lit(":\n"), o)), "\n")
    asked = generate(rows, F.concat(F.lit("CRITERIA\n"), criteria, F.lit("\n"), listed), client, PROMPTS["rank"], model)
    text = F.col("answer.text")
    ranking = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^\s*\d+\.\s*OPTION (\d+)"), 1), lambda x: x.cast("int"))
    return asked.select(*rows.columns, text.alias("rank_text"), ranking.alias("ranking"), F.nullif(F.regexp_extract(text, r"SPREAD:\s*(\w+)", 1), F.lit("")).alias("spread"))


def ask_once(client: ModelClient, prompt: str, content: str, model: str, **options: Any) -> Answer:
    """One question from the driver."""
    return answer(client, Request(prompt, content, model, **options))


def is_true(text: str) -> bool:
    """The verdict of an answer, as ``verdict`` has it for columns."""
    return next((x.strip() for x in text.splitlines() if x.strip()), "").upper().startswith("TRUE")


Log = Callable[[str], None] | None


def run_assert(claim: str, a: str, b: str, client: ModelClient, model: str = ASSERT_MODEL, prompt: str = PROMPTS["assert"], log: Log = None) -> tuple[bool, str]:
    text = run_skill("assert", f"CLAIM\n{claim}\nARTIFACT A\n{a}\nARTIFACT B\n{b}", client, model, prompt, log=log)
    return is_true(text), text


def score(quality: str, target: str, client: ModelClient, model: str = SCORE_MODEL, log: Log = None) -> str:
    return run_skill("score", f"QUALITY\n{quality}\nTARGET\n{target}", client, model, PROMPTS["score"], log=log)


def rank(criteria: str, options: list[str], client: ModelClient, model: str = RANK_MODEL, log: Log = None) -> str:
    listed = "\n".join(f"OPTION {i}:\n{o}" for i, o in enumerate(options, 1))
    return run_skill("rank", f"CRITERIA\n{criteria}\n{listed}", client, model, PROMPTS["rank"], log=log)




def run_skill(name: str, message: str, client: ModelClient, model: str, prompt: str, n: int = 1, log: Callable[[str], None] | None = None, **options: Any) -> str:
    """One question as a verb asks it: the cost goes to the log, several answers are parted by a line of dashes."""
    got = ask_once(client, prompt, message, model, n=n, **options)
    if log:
        log(f"{name}: {model}, ${call_dollars(model, got.usage):.4f}")
    return "\n---\n".join(got.texts)
