"""Answers that keep arriving: ingest, spend per time window, repeated keys."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from promptframe.operators.batch import BATCH_DISCOUNT, ingest_batch, parse_lines, settle
from promptframe.operators.store import ResultStore, spread
from promptframe.operators.usage import MONEY, with_usage
from promptframe.session import glob_paths, shared_dir


def answer_lines(spark: SparkSession, path: str, batch_id: str | None = None) -> DataFrame:
    """Stream of answer lines: files are named ``<batch id>.jsonl``, or all belong to the
    batch that is given."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)
    return spark.readStream.text(path).select(
        (F.lit(batch_id) if batch_id else name).alias("batch_id"), F.col("value").alias("line"))


def ingest_answers(lines: DataFrame, store: ResultStore, prices: DataFrame, checkpoint: str,
                   failed: bool = False, available_now: bool = True) -> StreamingQuery:
    """Settle each micro-batch of answer lines, or of error lines, in the store.

    A replayed micro-batch finds its requests done and changes nothing.
    """
    def settle_batch(batch: DataFrame, batch_number: int) -> None:
        answers, errors = (batch.limit(0), batch) if failed else (batch, None)
        settle(store, ingest_batch(answers, prices, errors))

    writer = lines.writeStream.foreachBatch(settle_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()


def timed_lines(spark: SparkSession, path: str, batch_id: str | None = None, failed: bool = False) -> DataFrame:
    """:func:`answer_lines` with the time they ``arrived`` (that of their file), and whether they are
    error lines."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)
    return spark.readStream.text(path).select(
        (F.lit(batch_id) if batch_id else name).alias("batch_id"), F.col("value").alias("line"),
        F.col("_metadata.file_modification_time").alias("arrived"), F.lit(failed).alias("failed"))


def settle_answers(lines: DataFrame, store: ResultStore, prices: DataFrame, checkpoint: str,
                   elapsed: DataFrame | None = None, late: str = "30 days",
                   available_now: bool = True) -> StreamingQuery:
    """Settle lines (:func:`timed_lines`, answers and errors in one stream) as they meet their requests.

    Requests are a stream too: those that wait are the state of a join by batch and request, so no
    micro-batch reads the log of requests. Either side may come first, and lines that come again, in
    any file, change nothing. State older than ``late`` is dropped: an answer that comes later than
    that after its request is left to :func:`promptframe.operators.batch.settle`. ``elapsed``
    (``batch_id, elapsed``) goes to one answer of each batch: a stream does not know the order of
    lines, so it is the smallest id of the first micro-batch that has any. A micro-batch that runs
    again writes nothing twice. A large store should keep its state in RocksDB
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    requests = store.submitted_stream().withWatermark("written_at", late).dropDuplicatesWithinWatermark(
        ["batch_id", "prompt_hash"])
    error = F.when(F.col("failed"), F.get_json_object("response", "$.error.type"))
    answers = (parse_lines(lines).filter(F.col("custom_id").isNotNull()).withColumn("error", error)
               .withColumnRenamed("batch_id", "_batch").withWatermark("arrived", late)
               .dropDuplicatesWithinWatermark(["_batch", "custom_id"]))
    # clocks of the two sides may differ, so an answer may seem older than its request
    met = requests.join(answers, F.expr(f"""
        batch_id = _batch AND prompt_hash = custom_id AND arrived >= written_at - INTERVAL {late}
        AND arrived <= written_at + INTERVAL {late}""")).drop("_batch", "custom_id", "arrived")
    timed = f"{store.root}/timed/{hashlib.md5(checkpoint.encode()).hexdigest()}"

    def settle_met(batch: DataFrame, number: int) -> None:
        spark = store.spark
        path = shared_dir(spark, "met")
        spread(batch).write.parquet(path)
        rows = store.not_expired(spark.read.parquet(path))
        priced = with_usage(rows.withColumnRenamed("prompt", "_prompt").withColumn("prompt", F.lit("")), prices,
                            BATCH_DISCOUNT).drop("prompt").withColumnRenamed("_prompt", "prompt")
        done = priced.withColumns({"usage": F.when(~F.col("failed"), F.col("usage")), "state": F.lit("done")})
        if elapsed is not None:
            done = done.join(_first_of_batches(rows, number), ["batch_id", "prompt_hash"], "left")
        once = f"{checkpoint}/{number}"
        store.append(done, once=once)
        store.append_pending(done, once=once)

    def _first_of_batches(rows: DataFrame, number: int) -> DataFrame:
        """The answer of each batch that gets the batch's time, unless an earlier micro-batch has given it.

        The batches that have theirs are one row each, in a folder per micro-batch.
        """
        spark = store.spark
        first = rows.filter(~F.col("failed")).groupBy("batch_id").agg(F.min("prompt_hash").alias("prompt_hash"))
        first = first.join(elapsed.select("batch_id", F.col("elapsed").cast("double").alias("elapsed_time")), "batch_id")
        earlier = [n for p in glob_paths(spark, f"{timed}/*/_SUCCESS") if (n := int(p.rsplit("/", 2)[1])) < number]
        names = first.select("batch_id")
        if earlier:
            known = spark.read.schema("batch_id string").parquet(f"{timed}/{max(earlier):012d}")
            first = first.join(known, "batch_id", "left_anti")
            names = known.union(first.select("batch_id"))
        names.coalesce(1).write.mode("overwrite").parquet(f"{timed}/{number:012d}")
        return first

    writer = met.writeStream.foreachBatch(settle_met).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()


def spend_per_window(log: DataFrame, window: str = "1 hour", late: str = "1 hour",
                     at: str = "written_at", money: str = "cost") -> DataFrame:
    """Answers and money per time window of a result log (stream or table)."""
    source = log.withWatermark(at, late) if log.isStreaming else log
    return source.groupBy(F.window(at, window).alias("w")).agg(
        F.count(F.lit(1)).alias("answers"),
        F.sum(F.col(money).cast(MONEY)).cast("double").alias("cost")
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "answers", "cost")


def first_requests(work: DataFrame, late: str = "1 hour", at: str = "requested_at") -> DataFrame:
    """Stream of work without repeats of a key within the watermark."""
    return work.withWatermark(at, late).dropDuplicatesWithinWatermark(["prompt_hash", "run_hash"])
