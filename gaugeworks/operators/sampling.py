"""Samplers: what turns prompts into responses. The built-in ones are seeded, so a plan may be run again."""

from __future__ import annotations

import asyncio
import inspect
import os
import time
import warnings
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, replace
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from gaugeworks.functions.hashing import hash_number
from gaugeworks.operators import providers

#: Alphabet and longest length of random responses; workers unless told otherwise, and their bounds.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
LONGEST_RANDOM = 80
DEFAULT_WORKERS, LEAST_WORKERS, MOST_WORKERS = 25, 1, 2000
PROVIDERS = ("cloudflare_ai_gateway", "openai", "anthropic", "gemini")


def random_text(prompt: Column, seed: str = "") -> Column:
    """1 to 80 letters and digits, the same for the same prompt and seed."""
    key = F.concat_ws("|", F.lit(seed), prompt)
    length = (F.pmod(hash_number(key), F.lit(LONGEST_RANDOM)) + 1).cast("int")
    one = lambda i: F.substring(F.lit(ALPHABET), (F.pmod(hash_number(F.concat_ws("|", key, i.cast("string"))), F.lit(len(ALPHABET))) + 1).cast("int"), F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), length), one), "")


def random_label(prompt: Column, labels: Column, seed: str = "") -> Column:
    """One of the labels, uniformly by hash; `maybe` if there is none."""
    at = F.pmod(hash_number(F.concat_ws("|", F.lit(seed), prompt)), F.greatest(F.size(labels), F.lit(1))).cast("int")
    return F.coalesce(F.get(labels, at), F.lit("maybe"))


@dataclass(frozen=True)
class ModelSpec:
    """random, random_label, or a provider's model."""

    provider: str
    model: str | None = None
    settings: tuple[tuple[str, str], ...] = ()

    @property
    def display(self) -> str:
        return "demo-builtin" if self.model is None else f"{self.provider}:{self.model}"


#: What a model's table may say beside its type.
SETTINGS = ("account_id", "gateway_id", "base_url")


def model_spec(spec: str | dict | None) -> ModelSpec:
    """`random`, `random_label` or `provider:model`, as text or as a table's `type`; a table may also name the model as `model_id`."""
    if spec is None:
        return ModelSpec("random")
    if isinstance(spec, dict):
        kind = spec.get("type") or ""
        told = model_spec(f"{kind}:{spec['model_id']}" if "model_id" in spec and ":" not in kind else kind)
        return replace(told, settings=tuple((k, str(spec[k])) for k in SETTINGS if spec.get(k))) if told.model else told
    if spec in ("random", "random_label"):
        return ModelSpec(spec)
    provider, colon, model = spec.partition(":")
    if not colon:
        raise ValueError(f"{spec!r}: a model is random, random_label or provider:model")
    if not model:
        raise ValueError("the model's name is empty")
    if provider not in PROVIDERS:
        raise ValueError(f"unknown provider {provider!r}; known: {', '.join(PROVIDERS)}")
    return ModelSpec(provider, model)


def model_of_input(text: Column) -> Column:
    """The model named in a run's input, if it is a string."""
    v = F.try_variant_get(F.try_parse_json(text), "$.model", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


#: A plug-in: prompts of an Arrow batch in, responses out. One that is registered for a provider replaces calls over HTTP.
Sampler = Callable[[list[str]], list[str]]
REGISTERED: dict[str, Callable[[str], Sampler]] = {}


def register(provider: str, make: Callable[[str], Sampler]) -> None:
    REGISTERED[provider] = make


def worker_count(value: int | None = None, variable: str = "GAUGEWORKS_MAX_WORKERS") -> int:
    """Given, else from the environment, else 25; pulled into 1..2000 with a warning; unreadable text is the default."""
    if value is None:
        try:
            value = int(os.environ.get(variable, DEFAULT_WORKERS))
        except ValueError:
            value = DEFAULT_WORKERS
    held = min(MOST_WORKERS, max(LEAST_WORKERS, value))
    if held != value:
        warnings.warn(f"{value} workers pulled to {held}", stacklevel=2)
    return held


def windowed(items: Iterable, call: Callable, workers: int, order: str = "completion", ahead: int | None = None) -> Iterator[tuple[int, object]]:
    """(position, result) of call(item) for all items, at most `workers` calls in flight.

    Items are taken as calls end, so a window slides over them without waiting for a batch. order: `completion` tells
    results as they come; `input` holds those that are early, `ahead` at most, for the ones before them. The first error
    is raised at once: no call starts after it, coroutines in flight are cancelled, and threads in flight are waited for.
    `call` is a function, which runs in threads, or a coroutine function.
    """
    if order not in ("input", "completion"):
        raise ValueError("order is 'input' or 'completion'")
    ahead = max(4 * workers, 1000) if ahead is None else ahead
    flight = _Tasks() if inspect.iscoroutinefunction(call) else _Threads(workers)
    source, flying, early, told, more = enumerate(items), {}, {}, 0, True
    try:
        while True:
            while more and len(flying) < workers and (order == "completion" or len(early) + len(flying) < ahead):
                at, item = next(source, (None, None))
                if at is None:
                    more = False
                else:
                    flying[flight.start(call, item)] = at
            if not flying:
                return
            for ended in flight.first(flying):
                at, result = flying.pop(ended), ended.result()
                if order == "completion":
                    yield at, result
                else:
                    early[at] = result
            while told in early:
                yield told, early.pop(told)
                told += 1
    finally:
        flight.stop(flying)


class _Threads:
    def __init__(self, workers: int):
        self.pool = ThreadPoolExecutor(workers)

    def start(self, call, item):
        return self.pool.submit(call, item)

    def first(self, flying):
        return wait(flying, return_when=FIRST_COMPLETED).done

    def stop(self, flying):
        self.pool.shutdown(wait=True, cancel_futures=True)


class _Tasks:
    def __init__(self):
        self.loop = asyncio.new_event_loop()

    def start(self, call, item):
        return self.loop.create_task(call(item))

    def first(self, flying):
        return self.loop.run_until_complete(asyncio.wait(flying, return_when=asyncio.FIRST_COMPLETED))[0]

    def stop(self, flying):
        for task in flying:
            task.cancel()
        if flying:
            self.loop.run_until_complete(asyncio.gather(*flying, return_exceptions=True))
        self.loop.close()


def _picked(rows: list[tuple[pa.RecordBatch, int]]) -> pa.Table:
    """Rows of several batches, in the given order."""
    runs = [(batch, [i for _, i in own]) for _, own in groupby(rows, key=lambda r: id(r[0])) for own in [list(own)] for batch in [own[0][0]]]
    return pa.Table.from_batches([batch.take(pa.array(at)) for batch, at in runs])


#: Results that a task hands on together.
HANDED = 500


def external(rows: DataFrame, prompt: str, sample: Callable[[str], str], workers: int | None = None, order: str = "completion") -> DataFrame:
    """rows with response and latency_ms from a function or coroutine function, `workers` calls at a time in each task.

    The first error fails the task, and no further call starts in it. order: `input` keeps the order of a task's rows.
    """
    n = worker_count(workers)
    if order not in ("input", "completion"):
        raise ValueError("order is 'input' or 'completion'")

    if inspect.iscoroutinefunction(sample):

        async def one(row):
            began = time.perf_counter()
            return row, await sample(row[2]), (time.perf_counter() - began) * 1000

    else:

        def one(row):
            began = time.perf_counter()
            return row, sample(row[2]), (time.perf_counter() - began) * 1000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = ((batch, i, p) for batch in batches for i, p in enumerate(batch[prompt].to_pylist()))
        results = (told for _, told in windowed(given, one, n, order))
        while some := list(islice(results, HANDED)):
            told = _picked([row[:2] for row, _, _ in some])
            told = told.append_column("response", pa.array([t for _, t, _ in some], pa.string())).append_column("latency_ms", pa.array([ms for _, _, ms in some], pa.float64()))
            yield from told.combine_chunks().to_batches()

    schema = rows.select("*", F.lit("").alias("response"), F.lit(0.0).alias("latency_ms")).schema
    return rows.mapInArrow(run, schema)


def sampled(rows: DataFrame, prompt: str, spec: ModelSpec, labels: str | Sequence[str] | None = None, seed: str = "", workers: int | None = None) -> DataFrame:
    """rows with response and latency_ms. Rows with labels are answered with one of them by the random samplers."""
    if spec.model is None:
        began = F.lit(0.0)
        if labels is not None:
            own = F.col(labels) if isinstance(labels, str) else F.array(*[F.lit(x) for x in labels])
            return rows.withColumns({"response": random_label(F.col(prompt), own, seed), "latency_ms": began})
        if spec.provider == "random_label":
            return rows.withColumns({"response": random_label(F.col(prompt), F.array().cast("array<string>"), seed), "latency_ms": began})
        return rows.withColumns({"response": random_text(F.col(prompt), seed), "latency_ms": began})
    if spec.provider not in REGISTERED:
        return external(rows, prompt, providers.sampler(spec.provider, spec.model, dict(spec.settings)), workers)
    answer = REGISTERED[spec.provider](spec.model)
    return external(rows, prompt, lambda p: answer([p])[0], workers)


def map_rows(rows: DataFrame, function: Callable, schema: str, workers: int | None = None, max_items: int | None = None, order: str = "input", index: str | None = None) -> DataFrame:
    """A function or coroutine function over rows (as dicts), results that are None dropped, `workers` calls at a time in each task.

    order: `input` keeps the order of a task's rows and, by the index column if it is named, of all rows.
    """
    rows = rows.limit(max_items) if max_items is not None else rows
    n, shape = worker_count(workers) if workers else MOST_WORKERS, to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        given = (row for batch in batches for row in batch.to_pylist())
        results = (told for _, told in windowed(given, function, n, order) if told is not None)
        while some := list(islice(results, HANDED)):
            yield pa.RecordBatch.from_pylist(some, shape)

    out = rows.mapInArrow(run, schema)
    return out.orderBy(index) if order == "input" and index else out


def chat(rows: DataFrame, messages: str, spec: ModelSpec, call: Callable[[str, str | None, list[dict]], dict] | None = None, workers: int | None = None) -> DataFrame:
    """rows with `reply` (content, tokens) of a conversation column (array of role and content).

    The random sampler answers the last message and counts its words. Others are asked by `call(provider, model,
    messages)`, which returns {"content", "tokens"}; without one, the provider is called over HTTP.
    """
    if call is None and spec.model is not None:
        call = providers.converser(spec.provider, spec.model, dict(spec.settings))
    last = F.element_at(F.col(messages), -1)["content"]
    if call is None:
        return rows.withColumn("_t", random_text(last)).withColumn("reply", F.struct(F.col("_t").alias("content"), F.size(F.split("_t", " ")).cast("long").alias("tokens"))).drop("_t")
    import json

    def one(text: str) -> str:
        return json.dumps(call(spec.provider, spec.model, json.loads(text)))

    told = external(rows.withColumn("_m", F.to_json(messages)), "_m", one, workers)
    return told.withColumn("reply", F.from_json("response", "content string, tokens long")).drop("_m", "response", "latency_ms")
