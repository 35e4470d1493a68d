"""Run configurations: their keys and the arguments that are sent and stored."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from promptframe.functions.keys import run_hash
from promptframe.sources.project import Run

RUN_SCHEMA = (
    "run_ord int, run_name string, module_id string, module_name string, args_json string, "
    "run_hash string, module_version string, module_description string"
)


@dataclass(frozen=True)
class Module:
    """What is known about a model module."""

    id: str
    name: str
    cache_prefix: str
    version: str = ""
    description: str = "Unknown"
    currency: str = "USD"


@dataclass(frozen=True)
class RunKey:
    """A run of a known module, with its key."""

    name: str
    module: Module
    args: Mapping[str, Any] = field(default_factory=dict)

    @property
    def run_hash(self) -> str:
        return run_hash(self.module.cache_prefix, dict(self.args))


def run_keys(runs: Mapping[str, Run], modules: Mapping[str, Module]) -> list[RunKey]:
    """Keys of all runs; a run of an unknown module is an error."""
    unknown = sorted({r.module_id for r in runs.values()} - set(modules))
    if unknown:
        raise ValueError(f"unknown modules: {unknown}")
    return [RunKey(name, modules[r.module_id], dict(r.args)) for name, r in runs.items()]


def _row(i: int, run: RunKey) -> tuple:
    return (i, run.name, run.module.id, run.module.name, json.dumps(dict(run.args), ensure_ascii=False),
            run.run_hash, run.module.version, run.module.description)


def run_table(spark: SparkSession, runs: Sequence[RunKey]) -> DataFrame:
    """Runs as a table."""
    return spark.createDataFrame([_row(i, r) for i, r in enumerate(runs)], RUN_SCHEMA)


def with_runs(df: DataFrame, runs: Sequence[RunKey]) -> DataFrame:
    """Every row with every run. Runs are a handful of constants, so no join is needed."""
    names = ["run_ord", "run_name", "module_id", "module_name", "args_json", "run_hash",
             "module_version"]
    structs = [
        F.struct(*[F.lit(v).alias(n) for n, v in zip(names, _row(i, r))]) for i, r in enumerate(runs)]
    if not structs:
        return df.filter(F.lit(False)).select(
            "*", *[F.lit(None).cast("int" if n == "run_ord" else "string").alias(n) for n in names])
    return df.select("*", F.inline(F.array(*structs)))


def public_args(args_json: Column) -> Column:
    """Arguments as stored with a result: names with a leading ``_`` are secret."""
    args = F.from_json(args_json, "map<string,variant>")
    return F.to_json(F.map_filter(args, lambda k, v: ~k.startswith("_")))


def public_dict(args: Mapping[str, Any]) -> dict[str, Any]:
    return {k: v for k, v in args.items() if not k.startswith("_")}
