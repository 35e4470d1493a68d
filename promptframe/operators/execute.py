"""Calling a model for the prompts that have no answer yet.

A call costs money and is not repeatable, so its output is written by the same task
that made it (no shuffle after the call) and every later step reads the stored table.
A task that is lost before it commits is called again: delivery is at least once, and
calls go in waves so that little can be lost at a time. Switch speculation off
(``spark.speculation=false``) for these jobs: a second copy of a task calls again.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator, Mapping
from decimal import Decimal
from typing import Any, Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from promptframe.functions.images import images, without_images
from promptframe.operators import usage as money
from promptframe.operators.grid import distinct_work, work
from promptframe.operators.lookup import KEYS
from promptframe.operators.runs import RunKey, public_args
from promptframe.operators.store import ResultStore, spread
from promptframe.session import shared_dir

ANSWER_SCHEMA = "response string, cost_value double, elapsed_time double, error string"
CALLS_PER_TASK = 10_000
DEFAULT_STUB = "Stub response from the dummy model."


class Provider(Protocol):
    """User code behind a module: one instance per partition."""

    def open(self) -> None: ...

    def call(self, batch: pd.DataFrame) -> pd.DataFrame:
        """``prompt`` and ``args_json`` in; ``response`` (JSON text) and optionally
        ``cost_value``, ``error`` out, same length and order."""

    def close(self) -> None: ...


# --- requests -------------------------------------------------------------------


# Fixed value: where a search model is told to search from.
SEARCH_OPTIONS = {"user_location": {"type": "approximate", "approximate": {"country": "BR"}}}


def request_args(args: Mapping[str, Any]) -> dict[str, Any]:
    """Extra arguments of a request after the model's own rules."""
    model, extra = args.get("gpt_model", ""), dict(args.get("gpt_args") or {})
    if args.get("gpt_json"):
        extra["response_format"] = {"type": "json_object"}
    if "-search" in model:
        extra["web_search_options"] = SEARCH_OPTIONS
        for name in ("temperature", "n", "response_format"):
            extra.pop(name, None)
    return extra


def uses_responses_shape(args: Mapping[str, Any]) -> bool:
    """Whether a run asks for the web search tool (another request shape)."""
    return bool(args.get("web_search")) and "-search" not in args.get("gpt_model", "")


def _messages(prompt: Column, responses_shape: bool) -> Column:
    """One user message: the text, then its images."""
    def quoted(c: Column) -> Column:
        # a JSON string literal: drop the brackets of a one-element JSON array
        array = F.to_json(F.array(c))
        return F.substring(array, F.lit(2), F.length(array) - 2)

    if responses_shape:
        text = F.concat(F.lit('{"type":"input_text","text":'), quoted(without_images(prompt)), F.lit("}"))
        parts = F.transform(images(prompt), lambda u: F.concat(
            F.lit('{"type":"input_image","image_url":'), quoted(u), F.lit("}")))
    else:
        text = F.concat(F.lit('{"type":"text","text":'), quoted(without_images(prompt)), F.lit("}"))
        parts = F.transform(images(prompt), lambda u: F.concat(
            F.lit('{"type":"image_url","image_url":{"url":'), quoted(u), F.lit("}}")))
    content = F.array_join(F.concat(F.array(text), parts), ",")
    return F.concat(F.lit('[{"role":"user","content":['), content, F.lit("]}]"))


def request_body(prompt: Column, args: Mapping[str, Any]) -> Column:
    """Request JSON text of a prompt for one run."""
    extra = request_args(args)
    responses_shape = uses_responses_shape(args)
    if responses_shape and not args.get("batch_mode"):
        fields = {
            "text": {"format": {"type": "json_object"}} if args.get("gpt_json") else {},
            "temperature": (args.get("gpt_args") or {}).get("temperature"),
            "tools": [{"type": "web_search"}],
        }
        name = "input"
    else:
        fields, name = extra, "messages"
    rest = json.dumps(fields, ensure_ascii=False, separators=(",", ":"))[1:-1]
    head = json.dumps(args.get("gpt_model", ""), ensure_ascii=False)
    return F.concat(
        F.lit(f'{{"model":{head},"{name}":'), _messages(prompt, responses_shape),
        F.lit(f",{rest}" if rest else ""), F.lit("}"))


# --- providers ------------------------------------------------------------------


def stub_response(text: str = DEFAULT_STUB) -> str:
    """Response of the stub module: valid JSON is pretty-printed, other text is quoted."""
    try:
        content = json.dumps(json.loads(text), indent=2)
    except ValueError:
        content = f'"{text}"'
    return json.dumps({"choices": [{"message": {"content": content}}]}, ensure_ascii=False,
                      separators=(",", ":"))


def stub_answers(missing: DataFrame, text: str = DEFAULT_STUB, cost: float = 0.0) -> DataFrame:
    """The stub as plain columns: no Python worker."""
    return missing.withColumns({
        "response": F.lit(stub_response(text)), "cost_value": F.lit(float(cost)),
        "elapsed_time": F.lit(0.0), "error": F.lit(None).cast("string")})


def call_provider(missing: DataFrame, provider: Provider, args_json: str | None = None) -> DataFrame:
    """Rows of ``missing`` plus the provider's answer; opened once per partition with rows.

    Only prompt and arguments are turned into pandas, other columns pass by as Arrow. The
    arguments given here, which may hold secrets, reach the provider in place of the column's.
    """
    added = T.StructType.fromDDL(ANSWER_SCHEMA)
    kinds = {"response": pa.string(), "cost_value": pa.float64(), "elapsed_time": pa.float64(),
             "error": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = False
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if not opened:
                    provider.open()
                    opened = True
                started = time.time()
                asked = batch.select(["prompt", "args_json"]).to_pandas()
                if args_json is not None:
                    asked["args_json"] = args_json
                answers = provider.call(asked)
                took = (time.time() - started) / batch.num_rows
                if len(answers) != batch.num_rows:
                    raise ValueError("a provider must answer every prompt of its batch")
                values = {n: answers[n].tolist() if n in answers else [None] * batch.num_rows for n in kinds}
                if "elapsed_time" not in answers:
                    values["elapsed_time"] = [took] * batch.num_rows
                columns = [pa.array(values[n], kind, from_pandas=True) for n, kind in kinds.items()]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *columns], names=[*batch.schema.names, *kinds])
        finally:
            if opened:
                provider.close()

    return missing.mapInArrow(run, T.StructType(missing.schema.fields + added.fields))


def assemble(answers: DataFrame, discount: float = 0.0, prices: DataFrame | None = None) -> DataFrame:
    """Result records from answered work: secrets stripped, usage filled in.

    A provider's own cost counts as the cost of the input; without one the tokens are priced.
    """
    tokens = money.token_usage(F.col("response"))
    size = money.byte_usage(F.col("prompt"), F.col("response"))
    cost_in, cost_out = F.coalesce("cost_value", F.lit(0.0)), F.lit(0.0)
    if prices is not None:
        answers = money.price_join(answers.withColumn("model", money.model_name(F.col("response"))), prices)
        cost_in = F.coalesce("cost_value", money.cost(tokens["tokens_in"], F.col("price_in")))
        cost_out = F.when(F.col("cost_value").isNull(), money.cost(tokens["tokens_out"], F.col("price_out"))).otherwise(0.0)
    usage = F.struct(
        tokens["tokens_in"].alias("tokens_in"), tokens["tokens_out"].alias("tokens_out"),
        size["bytes_in"].alias("bytes_in"), size["bytes_out"].alias("bytes_out"),
        cost_in.alias("cost_in"), cost_out.alias("cost_out"), F.lit(discount).alias("discount"),
        money.discounted(cost_in, cost_out, F.lit(discount)).alias("cost"))
    return answers.select(
        "hash_prefix", "prompt_hash", "run_hash", "prompt", "response", usage.alias("usage"),
        F.date_format(F.current_timestamp(), "yyyyMMddHHmmss").alias("timestamp"), "elapsed_time",
        "module_name", "module_version", public_args(F.col("args_json")).alias("module_args_json"),
        F.col("masked").alias("params"), "error")


# --- runs -----------------------------------------------------------------------


def execute(grid: DataFrame, run: RunKey, store: ResultStore, provider: Provider | None = None,
            max_parallel: int | None = None, max_cost: float = 0.0, wave: int | None = None,
            total: int | None = None, timeout: float | None = None, stub: str | None = None,
            calls_per_task: int = CALLS_PER_TASK, prices: DataFrame | None = None) -> DataFrame:
    """Answer every combination of one run and return its work with a final status.

    Each distinct missing prompt is called once, in ``max_parallel`` tasks at a time (as many as
    the cluster runs, if not given), and a task makes about ``calls_per_task`` calls before they
    are stored; the stub, which costs nothing to repeat, answers all at once. ``prices`` gives
    answers without a cost of their own the price of their tokens. With a budget
    the combinations go in waves of ``wave`` numbers, and no wave starts once
    ``max_cost`` is spent, so at most one wave is overspent; answers that were already stored
    count too, and an answer counts for every combination it serves. Work is written once by
    wave, so a wave reads its own rows only, and what its answers cost, now and in later waves,
    is added to the store's ledger from its own answers. Returns one row
    per combination with ``status`` executed, cached, pending or missing (not reached).
    """
    max_parallel = max_parallel or store.spark.sparkContext.defaultParallelism
    args_json = json.dumps(dict(run.args), ensure_ascii=False)
    asked = distinct_work(grid, [run])
    # secrets are not written: the provider gets them by closure
    todo = _frozen(store, asked.withColumn("args_json", public_args(F.col("args_json"))), "work")
    store.write_prompts(todo)
    # statuses change with the store, so they are written down before any call
    state = _frozen(store, store.lookup(work(grid, [run]).select(
        "combo_id", "prompt_hash", "hash_prefix", "run_hash", "run_name"), timeout=timeout,
        run_hash=run.run_hash), "status")
    missing = _frozen(store, store.misses(todo, timeout=timeout, run_hash=run.run_hash), "missing")
    if max_cost:
        top = total if total is not None else state.count()
        size = wave or max(1, -(-top // 100))
        _call_within(missing, state, store, run, size, -(-top // size), max_cost, lambda rows: _call_wave(
            rows, store, provider, max_parallel, stub, prices, args_json))
    elif provider is None and wave is None:
        _call_wave(missing, store, None, None, stub, prices, args_json)
    else:
        waves = -(-missing.count() // (wave or max_parallel * calls_per_task))
        # digests fall evenly into waves; these digits are not those that place a row in a file
        number = F.shiftright(F.conv(F.substring("prompt_hash", 7, 6), 16, 10).cast("long") * F.lit(waves), 24)
        placed = _by_wave(store, missing, number) if waves > 1 else missing.withColumn("wave", F.lit(0))
        for i in range(waves):
            _call_wave(placed.filter(F.col("wave") == i).drop("wave"), store, provider, max_parallel, stub, prices,
                       args_json)
    return final_status(state, store, run.run_hash, timeout)


def _frozen(store: ResultStore, df: DataFrame, purpose: str) -> DataFrame:
    path = shared_dir(store.spark, purpose)
    df.write.parquet(path)
    return store.spark.read.parquet(path)


def _by_wave(store: ResultStore, rows: DataFrame, number: Column) -> DataFrame:
    """``rows`` written once in a folder per wave, of which a reader of one wave opens only that."""
    path = shared_dir(store.spark, "waves")
    parts = int(store.spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.withColumn("wave", number.cast("int"))
    placed.repartitionByRange(parts, "wave", "prompt_hash").write.partitionBy("wave").parquet(path)
    return store.spark.read.schema(placed.schema).parquet(path)


def _call_within(missing: DataFrame, state: DataFrame, store: ResultStore, run: RunKey, size: int, waves: int,
                 max_cost: float, call: Callable[[DataFrame], str]) -> None:
    """Call wave after wave while money is left.

    What is known of a wave's money is one row of the ledger for every wave in which answers of an
    earlier one (or stored ones, of wave -1) are served: as many numbers as waves reach the driver.
    """
    of_combo = F.floor(F.col("combo_id") / size)
    served = state.groupBy(*KEYS, of_combo.cast("int").alias("wave")).agg(F.count(F.lit(1)).alias("_n"))
    called = missing.select(*KEYS, of_combo.cast("int").alias("_called"))
    served = served.join(called, KEYS, "left").select(
        *KEYS, F.col("wave").alias("_served"), "_n", F.coalesce("_called", F.lit(-1)).alias("_called"))
    served = _by_wave(store, served, F.col("_called")).drop("_called")
    placed = _by_wave(store, missing, of_combo)
    full = {r["wave"] for r in placed.groupBy("wave").count().collect()}
    spent = [Decimal(0)] * waves

    def enter(wave: int, answers: DataFrame) -> None:
        known = served.filter(F.col("wave") == wave).join(answers, KEYS)
        sums = known.groupBy(F.col("_served").alias("served")).agg(
            F.sum(F.col("cost").cast(money.MONEY) * F.col("_n")).cast(money.MONEY).alias("cost"))
        entries = sums.select(F.lit(run.run_hash).alias("run_hash"), F.lit(run_id).alias("run_id"),
                              F.lit(wave).alias("wave"), "served", "cost")
        for r in store.batch("ledger", store.append_ledger(entries)).collect():
            if 0 <= r["served"] < waves:
                spent[r["served"]] += r["cost"] or 0

    run_id = uuid.uuid4().hex
    stored = store.latest(run.run_hash, [F.col("usage.cost").alias("cost")]).select(*KEYS, "cost")
    enter(-1, stored)
    limit, before = Decimal(repr(float(max_cost))), Decimal(0)
    for wave in range(waves):
        if before >= limit:
            break
        if wave in full:
            batch = call(placed.filter(F.col("wave") == wave).drop("wave"))
            enter(wave, store.batch("results", batch).select(*KEYS, F.col("usage.cost").alias("cost")))
        before += spent[wave]


def _call_wave(missing: DataFrame, store: ResultStore, provider: Provider | None, tasks: int | None,
               stub: str | None, prices: DataFrame | None, args_json: str) -> str:
    placed = spread(missing, tasks)
    answers = (stub_answers(placed, stub or DEFAULT_STUB) if provider is None
               else call_provider(placed, provider, args_json))
    return store.append(assemble(answers, prices=prices))


def final_status(state: DataFrame, store: ResultStore, run_hash: str, timeout: float | None = None) -> DataFrame:
    """Status after the run: the first combination of a new answer was executed, the
    others that share it were served from the store.

    Statuses are decided on keys alone; the answers' texts come in one last join per key, and
    combinations meet them in another.
    """
    per_key = state.groupBy(*KEYS).agg(
        F.min(F.when(F.col("status") == "missing", F.col("combo_id"))).alias("_first"))
    answered = store.latest(run_hash).select(*KEYS, "prompt", "response", "usage", "timestamp", "elapsed_time")
    known = store.lookup(per_key, timeout=timeout, run_hash=run_hash).join(answered, KEYS, "left")
    new = (F.col("_before") == "missing") & (F.col("status") == "cached") & (F.col("combo_id") == F.col("_first"))
    return (
        state.withColumnRenamed("status", "_before").join(known, KEYS, "left")
        .withColumn("status", F.when(new, "executed").otherwise(F.col("status")))
        .drop("_before", "_first"))
