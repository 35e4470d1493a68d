"""Comparison tables over runs, written and read as one package."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from promptframe.operators.runs import RunKey, public_dict
from promptframe.sources.project import Project


def order_report_columns(df: DataFrame) -> DataFrame:
    """Columns with a leading ``_``, then ``input_...``, then the rest as they come."""
    inputs = [c for c in df.columns if c.startswith("input_")]
    marked = [c for c in df.columns if c.startswith("_")]
    rest = [c for c in df.columns if c not in inputs and c not in marked]
    return df.select(*[F.col(f"`{c}`") for c in marked + inputs + rest])


def union_runs(tables: Mapping[str, DataFrame], modules: Mapping[str, str]) -> DataFrame:
    """One analysis over all runs, with ``Run Name`` and ``Module Name`` first; a column
    some run lacks is NULL there."""
    out: DataFrame | None = None
    for run, df in tables.items():
        named = df.select(F.lit(run).alias("Run Name"), F.lit(modules[run]).alias("Module Name"), "*")
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    if out is None:
        raise ValueError("no run to report")
    return out


def report_prompts(prompts: DataFrame) -> DataFrame:
    """Enabled prompts of a prompt table."""
    return prompts.filter("enabled").select(
        F.col("prompt_name").alias("Prompt Name"), F.col("template").alias("Template"))


def report_runs(spark: SparkSession, runs: Sequence[RunKey]) -> DataFrame:
    """Runs with their module, key and arguments, of which secret ones are left out."""
    rows = [(r.name, r.module.name, r.module.id, r.run_hash, r.module.description,
             r.module.version or "Unknown", json.dumps(public_dict(r.args), indent=4)) for r in runs]
    names = ["Run Name", "Module Name", "Module ID", "Run Hash", "Module Description",
             "Module Version", "Arguments"]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))


def write_report(tables: Mapping[str, DataFrame], path: str, fmt: str = "parquet",
                 project: str | None = None, groups: Mapping[str, DataFrame] | None = None) -> None:
    """One folder per table, one per parameter group, and a manifest that lists them;
    written last, it makes the package complete."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        writer = order_report_columns(df).write.format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True).option("escape", '"')
        writer.save(f"{path}/{name}")
    for place, df in enumerate((groups or {}).values()):
        df.write.parquet(f"{path}/groups/{place}")
    manifest = json.dumps({"format": fmt, "tables": list(tables), "project": project, "groups": list(groups or {})})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{path}/manifest")


def read_report(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a package by name."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    reader = spark.read.format(manifest["format"])
    if manifest["format"] == "csv":
        reader = reader.option("header", True).option("escape", '"').option("multiLine", True)
    return {name: reader.load(f"{path}/{name}") for name in manifest["tables"]}


def read_report_project(spark: SparkSession, path: str) -> Project:
    """The project of a package with its groups; secret arguments of its runs are not there."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    project = Project.from_dict(spark, json.loads(manifest["project"]) | {"parameters": {}})
    for place, name in enumerate(manifest["groups"]):
        # a group brings its ordinals as a column
        project = project.with_group(name, spark.read.parquet(f"{path}/groups/{place}"))
    return project


def project_json(project: Project) -> str:
    """Prompts, runs and retrieval settings of a project (groups are tables)."""
    return json.dumps({
        "prompts": dict(project.prompts), "disabled_prompts": sorted(project.disabled),
        "runs": {n: {"module_id": r.module_id, "module_name": r.module_name, "module_args": public_dict(r.args)}
                 for n, r in project.runs.items()},
        "rag": {n: dict(c) for n, c in project.rag.items()},
        "groups": list(project.groups)}, ensure_ascii=False)
