import hashlib
import itertools
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from promptframe.functions import templates
from promptframe.functions.keys import run_hash
from promptframe.functions.text import double_text, strip
from promptframe.operators import grid as g
from promptframe.operators.runs import Module, RunKey, run_keys, run_table
from promptframe.sources.files import group_from_rows
from promptframe.sources.project import Project, Run, prompt_table


@pytest.fixture
def numbers(spark):
    return Project(spark, {"test_prompt": "Enter a number: {{param1}}+{{param2}}"}, {
        "a": group_from_rows(spark, [{"param1": i} for i in (1, 2, 3)]),
        "b": group_from_rows(spark, [{"param2": i} for i in (4, 5)])})


def prompts_of(grid):
    return [r["prompt"] for r in grid.orderBy("combo_id").collect()]


def test_order_and_keys(numbers):
    rows = g.expand(numbers).orderBy("combo_id").collect()
    want = [f"Enter a number: {x}" for x in ("1+4", "1+5", "2+4", "2+5", "3+4", "3+5")]
    assert [r["prompt"] for r in rows] == want
    assert [r["combo_id"] for r in rows] == list(range(6))
    assert [r["prompt_hash"] for r in rows] == [hashlib.sha1(w.encode()).hexdigest() for w in want]
    assert all(r["hash_prefix"] == r["prompt_hash"][:2] for r in rows)


def test_large_groups_take_the_shuffled_join(numbers):
    unknown = {n: g.Size(s.rows) for n, s in g.group_sizes(numbers.groups).items()}
    grid = g.expand(numbers, sizes=unknown)
    assert prompts_of(grid) == prompts_of(g.expand(numbers))
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_index_beyond_one_block(spark, monkeypatch):
    monkeypatch.setattr(g, "INDEX_BLOCK", 4)
    project = Project(spark, {"q": "{{a}}-{{b}}-{{c}}"}, {
        n: group_from_rows(spark, [{n: i} for i in range(3)]) for n in "abc"})
    want = [f"{a}-{b}-{c}" for a in range(3) for b in range(3) for c in range(3)]
    assert prompts_of(g.expand(project)) == want


def test_counts(spark, numbers):
    assert g.num_combinations(numbers) == 6
    two = Project(spark, {"p": "x", "q": "y"}, numbers.groups)
    assert g.num_combinations(two) == 12
    empty = Project(spark, {"p": "{{x}}"}, {"e": group_from_rows(spark, [{"x": 1}]).filter("x > 1")})
    assert g.num_combinations(empty) == 0
    assert g.expand(empty).count() == 0


def test_no_groups(spark):
    assert prompts_of(g.expand(Project(spark, {"a": "one", "b": "two"}))) == ["one", "two"]
    assert g.expand(Project(spark)).count() == 0


def test_disabled_prompt_is_left_out(spark):
    project = Project(spark, {"a": "one", "b": "two"}, disabled=frozenset({"a"}))
    assert prompts_of(g.expand(project)) == ["two"]
    assert project.rename_prompt("a", "z").enabled_prompts == {"b": "two"}


def test_missing_variable(spark):
    project = Project(spark, {"t": "Enter a number: {{param1}}+{{missing_param}}"}, {
        "a": group_from_rows(spark, [{"param1": 1}])})
    with pytest.raises(ValueError, match='Prompt contains argument "missing_param"'):
        g.expand(project)
    marked = g.expand(project, missing="marker").first()
    assert marked["prompt"] == "Enter a number: 1+[!! Missing Variable: missing_param !!]"


def test_placeholder_offsets(spark):
    table = prompt_table(spark, {"t": "Enter a number: {{param1}}+{{missing_param}}"}).withColumn(
        "args", F.create_map(F.lit("param1"), F.lit("1")))
    found = g.placeholders(table, "args").orderBy("pos").collect()
    assert [(r["start"], r["end"]) for r in found] == [(16, 26), (27, 44)]
    assert [r["value"] for r in found] == ["1", "[!! Missing Variable: missing_param !!]"]
    shown = g.highlights(table, "args").orderBy("pos").collect()
    assert [(r["start"], r["end"]) for r in shown] == [(16, 17), (18, 57)]
    plain = g.highlights(table, "args", rendered=False).orderBy("pos").collect()
    assert [(r["start"], r["end"]) for r in plain] == [(16, 26), (27, 44)]


def test_later_group_wins_and_hidden_variables(spark):
    project = Project(spark, {"q": "{{name}} {{n}}"}, {
        "a": group_from_rows(spark, [{"_id": "row", "name": "A", "n": 7, "gone": None}]),
        "b": group_from_rows(spark, [{"name": "B"}])})
    row = g.expand(project).first()
    assert row["prompt"] == "B 7"
    assert row["args"] == {"prompt": "{{name}} {{n}}", "name": "B", "n": "7", "gone": None}
    # the string of the first group is hidden behind its id, the second has none
    assert row["masked"] == {"prompt": "q", "name": "B", "n": "7", "gone": None}


def test_masked_strings(spark):
    project = Project(spark, {"q": "{{t}}"}, {
        "a": group_from_rows(spark, [{"_id": "doc1", "t": "long text", "size": 9}, {"_id": "", "t": "x", "size": 1}])})
    masked = [r["masked"] for r in g.expand(project).orderBy("combo_id").collect()]
    assert masked == [{"prompt": "q", "t": "doc1", "size": "9"}, {"prompt": "q", "t": "x", "size": "1"}]


def test_values_as_text(spark):
    values = {"none": None, "nan": float("nan"), "empty": "", "count": 42, "ratio": 3.14, "big": 1e16,
              "flag": True, "list": [1, "é"]}
    project = Project(spark, {"q": "|".join(f"{{{{{n}}}}}" for n in values)}, {"v": group_from_rows(spark, [values])})
    assert g.expand(project).first()["prompt"] == '|||42|3.14|1e+16|True|[1, "é"]'


def test_timestamps(spark):
    df = spark.createDataFrame([(0, datetime(2024, 1, 15)), (1, datetime(2024, 1, 15, 8, 30, 0, 500))], "_ord bigint, d timestamp")
    assert prompts_of(g.expand(Project(spark, {"q": "{{d}}"}, {"d": df}))) == [
        "2024-01-15 00:00:00", "2024-01-15 08:30:00.000500"]


def test_values_are_not_filled_again(spark):
    project = Project(spark, {"q": "{{a}}{{a}} {{ b }}{{}}"}, {
        "v": group_from_rows(spark, [{"a": "{{b}}", " b ": "x", "": "e"}])})
    assert prompts_of(g.expand(project)) == ["{{b}}{{b}} xe"]


def test_prompt_is_a_variable(spark):
    assert prompts_of(g.expand(Project(spark, {"q": "a {{prompt}}"}))) == ["a a {{prompt}}"]


def test_template_table_agrees(spark, numbers):
    table = prompt_table(spark, {"a": "{{param1}} and {{param2}}", "b": "{{param2}}{{zz}}"})
    got = prompts_of(g.expand_templates(table, numbers.groups))
    want = [f"{a} and {b}" for a in (1, 2, 3) for b in (4, 5)]
    want += [f"{b}[!! Missing Variable: zz !!]" for _ in range(3) for b in (4, 5)]
    assert got == want


def test_current_combo(spark):
    project = Project(spark, {"hi": "Hello {{name}}! Today is {{day}}."}, {
        "n": group_from_rows(spark, [{"name": "World"}, {"name": "Universe"}]),
        "d": group_from_rows(spark, [{"day": "Monday"}, {"day": "Tuesday"}])})
    assert prompts_of(g.current_combo(project, "hi", {"n": 1, "d": 1})) == ["Hello Universe! Today is Tuesday."]


class Pair:
    def variables(self, params):
        return list(params)

    def apply(self, calls, texts, params):
        a, b = params
        left = texts[a].select(F.col("key").alias(a), F.col("text").alias("ta"))
        right = texts[b].select(F.col("key").alias(b), F.col("text").alias("tb"))
        return calls.join(left, a).join(right, b).select(a, b, F.concat("ta", F.lit("/"), "tb").alias("value"))


def test_function_placeholder(spark, numbers):
    project = Project(spark, {"q": "{{pair(param1,  param2)}} {{param1}}"}, numbers.groups)
    assert prompts_of(g.expand(project, functions={"pair": Pair()})) == [
        f"{a}/{b} {a}" for a in (1, 2, 3) for b in (4, 5)]
    with pytest.raises(ValueError, match="needs variable"):
        g.expand(Project(spark, {"q": "{{pair(x, param2)}}"}, numbers.groups), functions={"pair": Pair()})


def test_gaps_are_refused(spark):
    gap = group_from_rows(spark, [{"a": 1}, {"a": 2}, {"a": 3}]).filter("a <> 2")
    with pytest.raises(ValueError, match="gaps"):
        g.expand(Project(spark, {"q": "{{a}}"}, {"g": gap}))


RUN = RunKey("r", Module("m", "M", "mod"), {"b": 1, "a": "é"})


def test_distinct_work(spark):
    project = Project(spark, {"q": "{{w}}"}, {"w": group_from_rows(spark, [{"w": "dup"}] * 20 + [{"w": "unique"}])})
    rows = g.distinct_work(g.expand(project), [RUN]).orderBy("combo_id").collect()
    assert [(r["combo_id"], r["prompt"], r["combos"]) for r in rows] == [(0, "dup", 20), (20, "unique", 1)]
    assert g.work(g.expand(project), [RUN, RUN]).count() == 42
    assert g.work(g.expand(project), []).count() == 0


def test_run_keys(spark):
    want = hashlib.md5(b'{"a": "\\u00e9", "b": 1}').hexdigest()
    assert run_hash("mod", {"b": 1, "a": "é"}) == f"mod_{want}" == RUN.run_hash
    assert run_table(spark, [RUN]).first()["run_hash"] == RUN.run_hash
    with pytest.raises(ValueError, match="unknown modules"):
        run_keys({"r": Run("r", "nope", "N")}, {"m": RUN.module})
    assert run_keys({"r": Run("r", "m", "M", {"b": 1, "a": "é"})}, {"m": RUN.module}) == [RUN]


def test_double_text(spark):
    values = [0.0001, 1e7, 1e16, 1e15, 123456789.25, 1e-5, 0.00012345, 1e23, 8.41e21, 2e-3, 18.0, -0.0, -1e7,
              float("inf"), 0.1 + 0.2, 5.84048e16, 1 / 3, 1.7976931348623157e308]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(double_text(F.col("v"))).collect()] == [repr(v) for v in values]


def test_strip(spark):
    texts = [" a ", "　b\x1c\n", "", " \t "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(strip(F.col("t"))).collect()] == [t.strip() for t in texts]


def test_output_fields(spark):
    text = 'Give {\n\t"result": [\n\t{\n\t\t"name": "<the name>",\n\t\t"age": <years>,\n\t\t"x": "plain"\n\t}\n\t]\n}'
    df = spark.createDataFrame([(text,), ("none",)], "t string")
    got = [r[0] for r in df.select(templates.output_fields(F.col("t"))).collect()]
    assert got[1] is None and got[0]["multiple"] is True
    assert [tuple(f) for f in got[0]["fields"]] == [
        ("name", "string", "the name"), ("age", "numeric/logical", "years"), ("x", "string", "plain")]
    assert templates.field_names(text) == ["name", "age", "x"] and templates.field_names("none") == []


def test_large_groups_meet_by_tiles(spark, rows, monkeypatch):
    monkeypatch.setattr(g, "TILE_ROWS", 3)
    groups = {n: spark.createDataFrame([(k, f"{n}{k}") for k in range(size)], f"_ord long, {n} string")
              for n, size in (("a", 7), ("b", 10), ("c", 2), ("d", 4))}
    sizes = {n: g.Size(df.count(), 0 if n == "c" else None) for n, df in groups.items()}
    grid = g.expand(Project(spark, {"p": "{{a}}{{b}}{{c}}{{d}}", "q": "{{d}}"}, groups), sizes=sizes)
    made = [(f"a{i}b{j}c{k}d{m}", f"d{m}") for i, j, k, m in itertools.product(range(7), range(10), range(2), range(4))]
    want = [m[0] for m in made] + [m[1] for m in made]
    assert rows(grid.select("combo_id", "prompt")) == rows(spark.createDataFrame(list(enumerate(want)), "i long, p string"))


def test_small_groups_are_not_shuffled(spark):
    groups = {"a": spark.createDataFrame([(k, f"a{k}") for k in range(50)], "_ord long, a string"),
              "b": spark.createDataFrame([(k, f"b{k}") for k in range(20)], "_ord long, b string")}
    plan = g.expand(Project(spark, {"p": "{{a}}{{b}}"}, groups))._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert "Exchange hashpartitioning" not in physical and "RoundRobin" not in physical


def test_sizes_of_all_groups_at_once(spark):
    a = spark.createDataFrame([(0, "x"), (1, None)], "_ord long, a string")
    assert g.group_sizes({"a": a, "none": a.limit(0)}) == {"a": g.Size(2, g.group_size(a).bytes), "none": g.Size(0, 0)}
    with pytest.raises(ValueError, match="gaps"):
        g.group_sizes({"a": a, "b": a.filter("_ord = 1")})


def test_tiles_get_tasks_of_their_own(spark, monkeypatch):
    """Copies of rows are few bytes, but their combinations are not one task's work."""
    monkeypatch.setattr(g, "TILE_ROWS", 2)
    groups = [group_from_rows(spark, [{n: i} for i in range(count)]) for n, count in (("a", 6), ("b", 5))]
    grid = g.product(spark, groups, [g.Size(6), g.Size(5)])
    assert sorted(r["combo_id"] for r in grid.collect()) == list(range(30))
    assert grid.rdd.getNumPartitions() == 9


def test_tiled_combinations_are_never_sorted(spark):
    """The first aggregate over the combinations hashes: their keys are no text to be compared in it."""
    from promptframe.plans.catalog import QUERIES

    plan = QUERIES["grid_tiles"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    below = plan[:plan.index("map_from_arrays") if "map_from_arrays" in plan else plan.index("concat(Give order")]
    assert "partial_min(prompt_hash" not in below and "SortAggregate" not in below[below.index("HashAggregate"):]


def test_a_task_of_a_large_group_makes_a_bounded_number_of_combinations(spark, monkeypatch):
    """Also where the scan has as many splits as there are cores: later steps sort what a task holds."""
    monkeypatch.setattr(g, "COMBOS_PER_TASK", 10)
    rows = spark.range(0, 100, 1, 16).select(F.col("id").alias("_ord"), F.col("id").alias("a"))
    grid = g.product(spark, [None, rows], [g.Size(3), g.Size(100)])
    assert sorted(r["combo_id"] for r in grid.collect()) == list(range(300))
    assert grid.rdd.getNumPartitions() == 30


def test_a_step_that_reads_one_value_makes_no_map(spark):
    """Neither where the prompt is read beside it, nor in the query whose combinations are hashed in tiles."""
    from promptframe.plans.catalog import QUERIES

    groups = {n: group_from_rows(spark, [{n: f"{n}{i}"} for i in range(3)]) for n in ("a", "b")}
    grid = g.expand(Project(spark, {"p": "{{a}} and {{b}}"}, groups))
    each = grid.select(F.col("args")["a"].alias("a"), F.length("prompt").alias("chars"), F.col("prompt_hash").alias("key"))
    for df in (each, QUERIES["grid_tiles"](spark, "/root/testdata/sf0.001")):
        assert "map(" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.a, r.chars) for r in each.collect()} == {(f"a{i}", 9) for i in range(3)}
    assert {r.args["b"] for r in grid.collect()} == {"b0", "b1", "b2"}


@pytest.mark.parametrize("tiled", [False, True])
def test_characters_of_prompts(spark, monkeypatch, tiled):
    """Counted by values, they are those of the prompt, with characters of several bytes in any place."""
    monkeypatch.setattr(g, "TILE_ROWS", 2)
    texts = ["", "x", "\u00e9t\u00e9", "\u4e2d\u6587", "a\U0001f600b", None]
    groups = {n: group_from_rows(spark, [{n: t, "n": i} for i, t in enumerate(texts)]) for n in ("a", "b")}
    prompts = {"p": "\u00fc {{a}}{{b}} {{a}}", "q": "{{n}} {{prompt}} {{none}} \U0001f600", "r": "", "s": "{{b}}"}
    sizes = {n: g.Size(len(texts)) if tiled else g.Size(len(texts), 1) for n in groups}
    grid = g.expand(Project(spark, prompts, groups), "marker", sizes=sizes, chars=True)
    got = grid.select("chars", F.length("prompt").alias("n"), "prompt").collect()
    assert len(got) == 4 * 36 and all(r.chars == r.n == len(r.prompt) for r in got)
    assert grid.columns[:-1] == g.expand(Project(spark, prompts, groups), "marker", sizes=sizes).columns
