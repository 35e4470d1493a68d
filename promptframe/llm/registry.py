"""Named queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptframe.session import configure, shared_dir

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

#: What the contracts call white space, as characters and as a class of Java, Python and RE2.
BLANKS = " \t\n\x0b\x0c\r"
NOT_BLANK = r"[^\x20\x09-\x0D]"


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the library's settings, and Arrow batches that stay small with long texts."""
    configure(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def query(sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a function under its name, with its SQL when there is one."""
    def add(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepared(spark), sf_dir.rstrip("/"))

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once to the shared work folder and read back: what follows may use it
    several times, and a lost executor costs no more than a new read."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str):
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
