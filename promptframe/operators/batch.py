"""The delayed life cycle: queue requests, submit them as a file, take answers later."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from promptframe.operators import lookup
from promptframe.operators.execute import request_body
from promptframe.operators.lookup import KEYS
from promptframe.operators.runs import RunKey, public_args
from promptframe.operators.store import ResultStore, spread
from promptframe.operators.usage import with_usage
from promptframe.session import shared_dir

BATCH_DISCOUNT = 0.5
# Fixed values of a request line.
METHOD = "POST"
URL = "/v1/chat/completions"


def queue(missing: DataFrame, run: RunKey) -> DataFrame:
    """Missing work of one run as queued requests."""
    return missing.select(
        *KEYS, F.lit("queued").alias("state"), request_body(F.col("prompt"), run.args).alias("body"),
        F.lit(None).cast("string").alias("batch_id"), "prompt", F.col("masked").alias("params"),
        "module_name", "module_version", public_args(F.col("args_json")).alias("module_args_json"),
        F.date_format(F.current_timestamp(), "yyyyMMddHHmmss").alias("timestamp"))


def waiting(pending: DataFrame) -> DataFrame:
    """Newest state row of every request that is not done."""
    return lookup.latest(pending).filter(F.col("state") != "done")


def batch_requests(queued: DataFrame) -> DataFrame:
    """Request file lines: ``custom_id`` and ``line``."""
    head = F.to_json(F.struct(F.col("prompt_hash").alias("custom_id"), F.lit(METHOD).alias("method"),
                              F.lit(URL).alias("url")))
    line = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"body":'), F.col("body"), F.lit("}"))
    return queued.select(F.col("prompt_hash").alias("custom_id"), line.alias("line"))


def write_requests(queued: DataFrame, path: str) -> None:
    batch_requests(queued).select("line").write.text(path)


def submit(pending: DataFrame, batch_id: str, run_hash: str | None = None) -> DataFrame:
    """State rows of the queued requests (of a run), now part of a batch. Others keep their state."""
    queued = waiting(pending).filter(F.col("state") == "queued")
    if run_hash is not None:
        queued = queued.filter(F.col("run_hash") == run_hash)
    return queued.withColumns({"state": F.lit("submitted"), "batch_id": F.lit(batch_id)})


def read_batch_lines(spark: SparkSession, path: str, batch_id: str | None = None) -> DataFrame:
    """Lines of answer files: ``batch_id``, ``line``, ``at``.

    Files are named ``<batch id>.jsonl``, or all belong to the batch that is given.
    """
    lines = spark.read.text(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)
    return lines.select(
        (F.lit(batch_id) if batch_id else name).alias("batch_id"), F.col("value").alias("line"),
        F.struct(F.col("_metadata.file_name").alias("file"),
                 F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("row")).alias("at"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """``custom_id`` and response body of each answer or error line."""
    kept = [c for c in lines.columns if c != "line"]
    return lines.filter(F.trim("line") != "").select(
        *kept, F.get_json_object("line", "$.custom_id").alias("custom_id"),
        F.get_json_object("line", "$.response.body").alias("response"))


def _first_lines(parsed: DataFrame, elapsed: DataFrame) -> DataFrame:
    """The first answer of each batch carries the elapsed time of the whole batch: one row per
    batch of the caller's list."""
    first = parsed.groupBy("batch_id").agg(F.min_by("custom_id", "at").alias("custom_id"))
    return first.join(elapsed.select("batch_id", F.col("elapsed").cast("double").alias("elapsed_time")), "batch_id")


def ingest_batch(lines: DataFrame, prices: DataFrame, errors: DataFrame | None = None,
                 elapsed: DataFrame | None = None) -> DataFrame:
    """Finished requests from answer and error lines.

    ``batch_id, custom_id, response, error, elapsed_time``; ``elapsed`` has one row
    ``batch_id, elapsed`` per batch and is given to the first answer only.
    """
    answers = parse_lines(lines)
    out = answers.withColumn("error", F.lit(None).cast("string"))
    if elapsed is not None:
        out = out.join(_first_lines(answers, elapsed), ["batch_id", "custom_id"], "left")
    else:
        out = out.withColumn("elapsed_time", F.lit(None).cast("double"))
    out = out.select("batch_id", "custom_id", "response", "error", "elapsed_time", F.lit(False).alias("failed"))
    if errors is not None:
        failed = parse_lines(errors)
        out = out.unionByName(failed.select(
            "batch_id", "custom_id", "response",
            F.get_json_object("response", "$.error.type").alias("error"),
            F.lit(None).cast("double").alias("elapsed_time"), F.lit(True).alias("failed")))
    priced = with_usage(out.withColumn("prompt", F.lit("")), prices, BATCH_DISCOUNT).drop("prompt")
    return priced.withColumn("usage", F.when(~F.col("failed"), F.col("usage"))).drop("failed")


def resolve(pending: DataFrame, finished: DataFrame) -> DataFrame:
    """Waiting requests joined with what has finished: ``state`` done or still waiting.

    Stored fields of the request stay, those of the answer are added.
    """
    open_rows = waiting(pending)
    fields = ["response", "usage", "elapsed_time", "error"]
    answers = finished.select(
        F.col("custom_id").alias("prompt_hash"), "batch_id", *fields, F.lit(True).alias("_done"))
    joined = open_rows.join(answers, ["prompt_hash", "batch_id"], "left")
    return joined.withColumn("state", F.when(F.col("_done"), "done").otherwise(F.col("state"))).drop("_done")


def settle(store: ResultStore, finished: DataFrame) -> None:
    """Move finished requests into the results.

    Only the state rows of finished requests are read in full; one that was settled
    before is not waiting any more, so a second delivery changes nothing.
    """
    path = shared_dir(store.spark, "resolved")
    log = store.pending()
    named = finished.select(F.col("custom_id").alias("prompt_hash")).distinct()
    resolved = resolve(log.join(named, "prompt_hash", "left_semi"), finished)
    spread(resolved.filter(F.col("state") == "done")).write.parquet(path)
    done = store.spark.read.parquet(path)
    store.append(done)
    store.append_pending(done)


def still_waiting(store: ResultStore) -> int:
    """Number of requests without an answer."""
    return lookup.pending_keys(store.pending()).count()


def submit_queued(store: ResultStore, path: str, batch_id: str, run_hash: str | None = None) -> None:
    """Write the request file of what a run has queued and mark it submitted.

    A request is known by its prompt alone inside a batch, so a batch belongs to one run: which
    one must be named if several have queued, and a batch id is not used for two.
    """
    log = store.pending()
    if run_hash is None:
        queued = waiting(log).filter(F.col("state") == "queued").select("run_hash").distinct().limit(2).collect()
        if len(queued) > 1:
            raise ValueError("several runs have queued requests: name the one that the batch is for")
        run_hash = queued[0][0] if queued else ""
    taken = log.filter((F.col("batch_id") == batch_id) & (F.col("run_hash") != run_hash))
    if not taken.isEmpty():
        raise ValueError(f"batch {batch_id!r} belongs to another run")
    frozen = shared_dir(store.spark, "submitted")
    submit(log, batch_id, run_hash).write.parquet(frozen)
    rows = store.spark.read.parquet(frozen)
    write_requests(rows, path)
    store.append_pending(spread(rows))


def prices_table(spark: SparkSession, prices: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """Price table from a mapping pattern → {input, output} per million tokens, in order."""
    rows = [(p, i, float(v.get("input", 0.0)), float(v.get("output", 0.0)))
            for i, (p, v) in enumerate(prices.items())]
    return spark.createDataFrame(rows, "pattern string, ord int, input double, output double")


def provider_prices(spark: SparkSession, lists: Mapping[str | None, Mapping[str, Mapping[str, float]]]) -> DataFrame:
    """Price table of several providers (None: of all others), each with its own list."""
    made = [prices_table(spark, prices).withColumn("provider", F.lit(name).cast("string"))
            for name, prices in lists.items()]
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out
