import json

from promptframe.operators import report
from promptframe.operators.runs import Module, RunKey
from promptframe.operators.store import ResultStore
from promptframe.plans.lifecycle import answer_table, build_grid, queue_batch, run_project, take_batch
from promptframe.operators.grid import work
from promptframe.operators.batch import prices_table, submit_queued
from promptframe.sources.files import group_from_rows
from promptframe.sources.project import Project, Run, prompt_table

MODULE = Module("m", "M", "mod", "1.0", "Test module")


def test_column_order(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], ["out", "input_b", "_x", "answer", "input_a"])
    assert report.order_report_columns(df).columns == ["_x", "input_b", "input_a", "out", "answer"]


def test_union(spark):
    a = spark.createDataFrame([("x", 1)], "k string, n int")
    b = spark.createDataFrame([("y", True)], "k string, flag boolean")
    got = report.union_runs({"r1": a, "r2": b}, {"r1": "M1", "r2": "M2"})
    assert got.columns == ["Run Name", "Module Name", "k", "n", "flag"]
    assert [tuple(r) for r in got.collect()] == [("r1", "M1", "x", 1, None), ("r2", "M2", "y", None, True)]


def test_prompt_and_run_tables(spark):
    prompts = report.report_prompts(prompt_table(spark, {"a": "A", "b": "B"}, frozenset({"b"})))
    assert [tuple(r) for r in prompts.collect()] == [("a", "A")]
    runs = [RunKey("run1", MODULE, {"temperature": 0.7, "max_tokens": 150}), RunKey("run2", MODULE, {"temperature": 0.9})]
    rows = report.report_runs(spark, runs).collect()
    assert rows[0]["Run Hash"] == runs[0].run_hash and json.loads(rows[0]["Arguments"]) == runs[0].args
    assert rows[1]["Module Description"] == "Test module"


def test_package(spark, tmp_path):
    df = spark.createDataFrame([('a "q"\nline', 1.5, None)], "_t string, n double, z string")
    for fmt in ("parquet", "json", "csv"):
        path = str(tmp_path / fmt)
        report.write_report({"one": df, "two": df.select("n")}, path, fmt)
        back = report.read_report(spark, path)
        assert list(back) == ["one", "two"]
        assert back["one"].first()["_t"] == 'a "q"\nline' and float(back["two"].first()["n"]) == 1.5


def project_of(spark, runs):
    return Project(
        spark, {"p1": "Say {{name}}", "p2": "Greet {{name}}", "off": "{{nothing}}"},
        {"names": group_from_rows(spark, [{"name": "Ann", "_id": "1"}, {"name": "Bob", "_id": "2"}])},
        runs, disabled=frozenset({"off"}))


def test_whole_run(spark, tmp_path):
    project = project_of(spark, {"a": Run("a", "m", "M", {"x": 1}), "b": Run("b", "m", "M", {"x": 2})})
    store = ResultStore(spark, str(tmp_path / "store"))
    out = str(tmp_path / "out")
    tables = run_project(project, {"m": MODULE}, store, stub='{"result": [{"v": 1}, {"v": 2}]}', report=out)
    answers = tables["gpt_json"]
    assert answers.columns[:2] == ["Run Name", "Module Name"] and answers.count() == 16
    assert {r["input_name"] for r in answers.collect()} == {"1", "2"}
    stats = {r["run_name"]: (r["executed"], r["cached"]) for r in tables["stats"].collect()}
    assert stats == {"a": (4, 0), "b": (4, 0)} and tables["total_stats"].first()["executed"] == 8
    back = report.read_report(spark, out)
    assert set(back) >= {"gpt_json", "cost", "info", "prompts", "runs"}
    assert back["gpt_json"].count() == 16 and back["prompts"].count() == 2 and back["runs"].count() == 2
    package = ResultStore(spark, f"{out}/cache")
    assert package.prompts().count() == 4 and package.latest().count() == 8
    # everything is stored now
    again = run_project(project, {"m": MODULE}, store, stub="other")
    assert {(r["executed"], r["cached"]) for r in again["stats"].collect()} == {(0, 4)}
    grid = build_grid(project)
    both = answer_table(store, work(grid, [RunKey("a", MODULE, {"x": 1}), RunKey("b", MODULE, {"x": 2})]))
    assert both.count() == 8


def test_batch_plan(spark, tmp_path):
    project = project_of(spark, {"a": Run("a", "m", "M", {"gpt_model": "g", "batch_mode": True})})
    store = ResultStore(spark, str(tmp_path / "store"))
    queue_batch(project, {"m": MODULE}, store)
    submit_queued(store, str(tmp_path / "sent"), "b9")
    lines = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "sent")).collect()]
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "b9.jsonl").write_text("".join(json.dumps({"custom_id": x["custom_id"], "response": {"body": {
        "model": "g", "usage": {"input_tokens": 10, "output_tokens": 0}}}}) + "\n" for x in lines[:3]))
    left = take_batch(store, str(inbox), prices_table(spark, {"g*": {"input": 1e6}}), elapsed={"b9": 5.0})
    assert left == 1 and {r["usage"]["cost"] for r in store.latest().collect()} == {5.0}


def test_secrets_are_not_in_reports(spark):
    from promptframe.operators.report import report_runs
    from promptframe.operators.runs import Module, RunKey

    run = RunKey("r", Module("m", "M", "m"), {"model": "x", "_key": "hidden"})
    assert "hidden" not in str(report_runs(spark, [run]).collect())


def test_batch_runs_are_queued_not_called(spark, tmp_path):
    from promptframe.operators.runs import Module
    from promptframe.operators.store import ResultStore
    from promptframe.plans.lifecycle import run_project
    from promptframe.sources.files import group_from_rows
    from promptframe.sources.project import Project, Run

    project = Project(spark, {"p": "say {{w}}"}, {"g": group_from_rows(spark, [{"w": "a"}, {"w": "b"}])},
                      {"late": Run("late", "m", "M", {"batch_mode": True, "_key": "hidden"})})
    store = ResultStore(spark, str(tmp_path / "store"))
    tables = run_project(project, {"m": Module("m", "M", "m")}, store, analyses=["cost"])
    assert [(r.executed, r.cached, r.pending) for r in tables["stats"].collect()] == [(0, 0, 2)]
    waiting = store.pending().collect()
    assert sorted(r.prompt for r in waiting) == ["say a", "say b"] and "hidden" not in str(waiting)
