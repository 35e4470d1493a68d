"""Named queries over the given tables, each with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from promptframe.operators.runs import Module, RunKey
from promptframe.session import configure, widen
from promptframe.sources.ordinals import read_parquet_group

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

STUB = Module("stub", "Stub", "stub", "1.0.0", "Fixed answer")
CHAT = Module("chat", "Chat", "chat", "2.0.0", "Chat answers")
RUN_A = RunKey("first", STUB, {"stub_response": "ok"})
RUN_B = RunKey("second", CHAT, {"gpt_model": "m-large", "_key": "secret"})


def query(sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a function under its name, with its SQL when there is one."""
    def add(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir.rstrip("/"))

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return run

    return add


def group(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A given table as a group in file order, with the columns that are needed."""
    return read_parquet_group(spark, f"{sf_dir}/{name}.parquet").select("_ord", *columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; one that is a single small file is spread over the cores."""
    return widen(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
