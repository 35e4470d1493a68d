"""A project: prompt templates, ordered groups, runs and retrieval settings."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from promptframe.functions.templates import migrate_template
from promptframe.sources.files import group_from_rows, read_group
from promptframe.sources.ordinals import ORD

# Fixed value: newest project file version that can be read.
FILE_VERSION = (2, 0)


@dataclass(frozen=True)
class Run:
    """A named model configuration."""

    name: str
    module_id: str
    module_name: str
    args: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Project:
    """Config-sized parts as Python values, parameter tables as DataFrames."""

    spark: SparkSession
    prompts: Mapping[str, str] = field(default_factory=dict)
    groups: Mapping[str, DataFrame] = field(default_factory=dict)
    runs: Mapping[str, Run] = field(default_factory=dict)
    rag: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    disabled: frozenset[str] = frozenset()

    @staticmethod
    def load(spark: SparkSession, path: str) -> Project:
        """Project file (JSON); older files are migrated, newer ones refused."""
        rows = spark.read.text(path, wholetext=True).limit(2).collect()
        if len(rows) != 1:
            raise ValueError(f"{path} is not one project file")
        return Project.from_dict(spark, json.loads(rows[0][0]))

    @staticmethod
    def from_dict(spark: SparkSession, data: Mapping[str, Any]) -> Project:
        version = file_version(data)
        groups, prompts = data.get("parameters") or {}, data.get("prompts") or {}
        if version < (1, 0):
            if isinstance(groups, list):
                groups = {f"Parameter {i}": g for i, g in enumerate(groups)}
            if isinstance(prompts, list):
                prompts = {f"Prompt {i}": p for i, p in enumerate(prompts)}
        if version < (2, 0) and prompts:
            table = migrate_templates(prompt_table(spark, prompts))
            prompts = {r["prompt_name"]: r["template"] for r in table.orderBy(ORD).collect()}
        return Project(
            spark=spark,
            prompts=dict(prompts),
            groups={name: group_from_rows(spark, rows) for name, rows in groups.items()},
            runs={
                name: Run(name, r["module_id"], r.get("module_name", ""), r.get("module_args") or {})
                for name, r in (data.get("runs") or {}).items()},
            rag=data.get("rag") or {},
            disabled=frozenset(data.get("disabled_prompts") or ()))

    @property
    def enabled_prompts(self) -> dict[str, str]:
        return {n: t for n, t in self.prompts.items() if n not in self.disabled}

    def with_group(self, name: str, source: DataFrame | str, **options) -> Project:
        """Add or replace a group from a DataFrame (with ``_ord``) or a file or folder."""
        if isinstance(source, str):
            source = read_group(self.spark, source, variable=name, **options)
        if ORD not in source.columns:
            raise ValueError("a group needs ordinals: see with_ordinals")
        return replace(self, groups={**self.groups, name: source})

    def rename_prompt(self, old: str, new: str) -> Project:
        """Rename in place; a disabled prompt stays disabled."""
        prompts = {new if n == old else n: t for n, t in self.prompts.items()}
        disabled = frozenset(new if n == old else n for n in self.disabled)
        return replace(self, prompts=prompts, disabled=disabled)

    def validate_runs(self, module_ids: set[str]) -> None:
        unknown = sorted({r.module_id for r in self.runs.values()} - set(module_ids))
        if unknown:
            raise ValueError(f"unknown modules: {unknown}")


def file_version(data: Mapping[str, Any]) -> tuple[int, ...]:
    """Version of a project; one without metadata counts as current."""
    if "metadata" not in data:
        return FILE_VERSION
    text = data["metadata"].get("file_format_version", "0.0")
    version = tuple(int(v) for v in text.split("."))
    if version > FILE_VERSION:
        raise ValueError(f"project file version {text} is newer than this library")
    return version


def prompt_table(spark: SparkSession, prompts: Mapping[str, str],
                 disabled: frozenset[str] = frozenset()) -> DataFrame:
    """Prompts as a table: ``_ord``, ``prompt_name``, ``template``, ``enabled``."""
    rows = [(i, n, t, n not in disabled) for i, (n, t) in enumerate(prompts.items())]
    return spark.createDataFrame(
        rows, "_ord bigint, prompt_name string, template string, enabled boolean")


def enabled(prompts: DataFrame) -> DataFrame:
    """Prompts that take part in the grid."""
    return prompts.filter("enabled")


def migrate_templates(prompts: DataFrame, version: tuple[int, ...] = (0, 0)) -> DataFrame:
    """Templates of an older file version in today's syntax."""
    if version >= (2, 0):
        return prompts
    return prompts.withColumn("template", migrate_template(F.col("template")))


def validate_runs(runs: DataFrame, modules: DataFrame) -> DataFrame:
    """Runs whose module is not known."""
    return runs.join(modules.select("module_id"), "module_id", "left_anti")
