"""A project from its tables to its report, and the two-step life of batch runs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from promptframe.operators import batch
from promptframe.operators.analysis import ANALYSES, analyse, answered
from promptframe.operators.execute import Provider, execute, final_status
from promptframe.operators.grid import distinct_work, expand, group_sizes, work
from promptframe.operators.rag import passage_functions
from promptframe.operators.report import project_json, report_prompts, report_runs, union_runs, write_report
from promptframe.operators.runs import Module, RunKey, run_keys
from promptframe.operators.store import ResultStore
from promptframe.operators.usage import run_info, stats, total_stats
from promptframe.session import shared_dir
from promptframe.sources.project import Project, prompt_table


def build_grid(project: Project) -> DataFrame:
    """The grid, written once: every later stage reads the rendered prompts from it."""
    sizes = group_sizes(project.groups)
    grid = expand(project, functions=passage_functions(dict(project.rag)), sizes=sizes)
    path = shared_dir(project.spark, "grid")
    grid.write.parquet(path)
    return project.spark.read.parquet(path)


def run_project(project: Project, modules: Mapping[str, Module], store: ResultStore,
                providers: Mapping[str, Provider] | None = None, analyses: list[str] | None = None,
                report: str | None = None, max_cost: float = 0.0, **options) -> dict[str, DataFrame]:
    """Execute all runs and return the report tables (``stats`` included).

    A run in batch mode is not called: what it misses is queued and reported as pending.
    """
    runs = run_keys(project.runs, modules)
    grid = build_grid(project)
    names = analyses or list(ANALYSES)
    by_analysis: dict[str, dict[str, DataFrame]] = {n: {} for n in [*names, "info"]}
    status: DataFrame | None = None
    for place, run in enumerate(runs):
        if run.args.get("batch_mode"):
            done = queue_run(grid, run, store)
        else:
            done = execute(grid, run, store, (providers or {}).get(run.module.id), max_cost=max_cost, **options)
        done = done.withColumn("run_ord", F.lit(place))
        path = shared_dir(project.spark, "status")
        done.write.parquet(path)
        done = project.spark.read.parquet(path)
        status = done if status is None else status.unionByName(done)
        records = answered(
            work(grid, [run]).select("combo_id", "masked", "run_name", "hash_prefix", "prompt_hash", "run_hash"),
            store.latest(run.run_hash))
        for name in names:
            by_analysis[name][run.name] = analyse(records, name)
        by_analysis["info"][run.name] = run_info(records)
    module_names = {r.name: r.module.name for r in runs}
    tables = {n: union_runs(t, module_names) for n, t in by_analysis.items() if t}
    tables["prompts"] = report_prompts(prompt_table(project.spark, project.prompts, project.disabled))
    tables["runs"] = report_runs(project.spark, runs)
    if report is not None:
        write_report(tables, report, project=project_json(project), groups=project.groups)
        store.export(grid, work(grid, runs), f"{report}/cache")
    if status is not None:
        tables["stats"] = stats(status, max_cost, {r.name: r.module.currency for r in runs})
        tables["total_stats"] = total_stats(tables["stats"])
    return tables


def queue_batch(project: Project, modules: Mapping[str, Module], store: ResultStore) -> None:
    """Queue the missing work of every run that asks for batch mode."""
    grid = build_grid(project)
    for run in run_keys(project.runs, modules):
        if run.args.get("batch_mode"):
            queue_run(grid, run, store)


def queue_run(grid: DataFrame, run: RunKey, store: ResultStore) -> DataFrame:
    """Queue what a run misses; its work with the status after that."""
    todo = distinct_work(grid, [run])
    store.write_prompts(todo)
    store.append_pending(batch.queue(store.misses(todo, run_hash=run.run_hash), run))
    named = work(grid, [run]).select("combo_id", "prompt_hash", "hash_prefix", "run_hash", "run_name")
    return final_status(store.lookup(named, run_hash=run.run_hash), store, run.run_hash)


def take_batch(store: ResultStore, answers: str, prices: DataFrame, errors: str | None = None,
               elapsed: Mapping[str, float] | None = None) -> int:
    """Read answer files and settle their requests; returns how many still wait."""
    spark = store.spark
    lines = batch.read_batch_lines(spark, answers)
    failed = batch.read_batch_lines(spark, errors) if errors else None
    times = None if not elapsed else spark.createDataFrame(
        list(elapsed.items()), "batch_id string, elapsed double")
    batch.settle(store, batch.ingest_batch(lines, prices, failed, times))
    return batch.still_waiting(store)


def answer_table(store: ResultStore, work_rows: DataFrame) -> DataFrame:
    """Answers of all runs next to each other, per combination."""
    return store.results_for(work_rows).select(
        "combo_id", "run_ord", "run_name", F.col("content").alias("answer"))
