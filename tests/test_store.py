import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from promptframe.operators import lookup
from promptframe.operators.grid import expand, work
from promptframe.operators.runs import Module, RunKey
from promptframe.operators.store import ResultStore, import_cache_dir, spread
from promptframe.sources.files import group_from_rows
from promptframe.sources.project import Project

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
RUN = RunKey("r", Module("m", "M", "mod"), {})


def answer(text):
    return json.dumps({"choices": [{"message": {"content": text}}]})


@pytest.fixture
def grid(spark):
    return expand(Project(spark, {"q": "{{w}}"}, {"w": group_from_rows(spark, [{"w": x} for x in "abcd"])}))


@pytest.fixture
def store(spark, tmp_path):
    return ResultStore(spark, str(tmp_path / "store"))


def records(spark, pairs, run=RUN.run_hash):
    df = spark.createDataFrame(pairs, "prompt string, response string")
    key = F.sha1("prompt")
    return df.withColumns({"prompt_hash": key, "hash_prefix": F.substring(key, 1, 2), "run_hash": F.lit(run),
                           "timestamp": F.lit("20240101000000")})


def statuses(store, grid, **kw):
    rows = store.lookup(work(grid, [RUN]), **kw).orderBy("combo_id").collect()
    return [r["status"] for r in rows]


def test_empty_store(store, grid):
    assert statuses(store, grid) == ["missing"] * 4
    assert store.latest().count() == 0 and store.scan().count() == 0


def test_lookup_age_and_pending(spark, store, grid):
    store.append(records(spark, [("a", "1"), ("b", "2")]), T0)
    store.append(records(spark, [("b", "3")]), T0 + timedelta(days=2))
    assert statuses(store, grid) == ["cached", "cached", "missing", "missing"]
    # exactly as old as the limit is too old
    now = T0 + timedelta(days=3)
    assert statuses(store, grid, now=now, timeout=3 * 86400.0) == ["missing", "cached", "missing", "missing"]
    assert statuses(store, grid, now=now, timeout=3 * 86400.0 + 1) == ["cached", "cached", "missing", "missing"]
    waiting = records(spark, [("a", ""), ("c", "")]).withColumn("state", F.lit("queued"))
    store.append_pending(waiting, T0)
    assert statuses(store, grid) == ["pending", "cached", "pending", "missing"]
    assert [r["prompt"] for r in store.misses(work(grid, [RUN])).collect()] == ["d"]
    store.append_pending(waiting.withColumn("state", F.lit("done")), T0 + timedelta(1))
    assert statuses(store, grid) == ["cached", "cached", "missing", "missing"]


def test_changed_prompt_is_no_hit(spark, store, grid):
    store.append(records(spark, [("a", "1")]).withColumn("prompt", F.lit("other")), T0)
    assert statuses(store, grid)[0] == "missing"
    store.append(records(spark, [("a", "1")]), T0 + timedelta(1))
    assert statuses(store, grid)[0] == "cached"
    # an older good record does not help when the newest was changed
    store.append(records(spark, [("a", "1")]).withColumn("prompt", F.lit("other")), T0 + timedelta(2))
    assert statuses(store, grid)[0] == "missing"


def test_latest_merge_and_diff(spark, store, tmp_path, rows):
    store.append(records(spark, [("a", "1"), ("b", "2")]), T0)
    store.append(records(spark, [("a", "9")]), T0 + timedelta(1))
    other = ResultStore(spark, str(tmp_path / "other"))
    other.append(records(spark, [("a", "9"), ("b", "x"), ("c", "3")]), T0 - timedelta(9))
    assert store.diff(other).first().asDict() == {"copied": 1, "equal": 1, "different": 1}
    for _ in range(2):  # merging again changes nothing
        store.merge(other)
        assert rows(store.latest().select("prompt", "response")) == [("a", "9"), ("b", "x"), ("c", "3")]
    assert store.diff(other).first().asDict() == {"copied": 0, "equal": 3, "different": 0}


def test_expire(spark, store, grid):
    store.append(records(spark, [("a", answer("no")), ("b", answer('{"x": 1}'))]), T0)
    store.append(records(spark, [("c", answer("no")), ("d", answer("[1]"))]), T0 + timedelta(5))
    now = T0 + timedelta(6)
    assert store.expire(now, older_than=5 * 86400.0, errors_only=True) == 1
    assert statuses(store, grid) == ["missing", "cached", "cached", "cached"]
    assert store.expire(now, older_than=6 * 86400.0, keys=work(grid.filter("prompt = 'd'"), [RUN])) == 0
    assert store.expire(now, older_than=6 * 86400.0) == 1
    assert store.expire(now, errors_only=True) == 1
    assert statuses(store, grid) == ["missing", "missing", "missing", "cached"]
    # a new answer after the expiry counts again
    store.append(records(spark, [("a", answer("{}"))]), now + timedelta(1))
    assert statuses(store, grid)[0] == "cached"


def test_expire_any(spark):
    df = records(spark, [("a", answer("no")), ("b", answer("{}"))]).withColumn(
        "written_at", F.when(F.col("prompt") == "a", F.lit(T0)).otherwise(F.lit(T0 - timedelta(9))))
    both = lookup.expired(df, T0, 86400.0, errors_only=True, match="any")
    assert both.count() == 2
    assert lookup.expired(df, T0, 86400.0, errors_only=True).count() == 0
    assert lookup.expired(df, T0).count() == 2  # no test: all of the keys asked for


def test_unfinished_batch_is_invisible(spark, store, tmp_path):
    store.append(records(spark, [("a", "1")]), T0)
    store.append(records(spark, [("b", "2")]), T0 + timedelta(1))
    last = sorted((tmp_path / "store" / "results").iterdir())[-1]
    (last / "_SUCCESS").rename(last / "_NOT_YET")
    assert [r["prompt"] for r in store.latest().collect()] == ["a"]


def test_scan_and_statistics(spark, store, grid, rows):
    store.write_prompts(grid)
    store.write_prompts(grid)
    store.append(records(spark, [("a", "123"), ("b", "é")]), T0)
    store.append(records(spark, [("a", "1234")]), T0 + timedelta(1))
    store.append_pending(records(spark, [("c", "")]).withColumns({"state": F.lit("queued"), "body": F.lit("{}")}), T0)
    assert store.scan("result%").count() == 3 and store.scan("%.delayed").count() == 1
    assert store.scan("prompt.txt").count() == 4
    got = store.statistics().first().asDict()
    assert got == {"total_files": 7, "total_size_bytes": 4 + 4 + 2 + 2, "total_size_mb": 0.0,
                   "prompt_files_count": 4, "result_files_count": 2, "delayed_files_count": 1}


def test_results_for(spark, store, grid):
    other = RunKey("s", Module("m", "M", "mod"), {"x": 1})
    store.append(records(spark, [("a", "1")]), T0)
    found = store.results_for(work(grid, [RUN, other]).filter("combo_id < 2"))
    rows = found.orderBy("combo_id", "run_ord").collect()
    assert [r["content"] for r in rows] == ["1"] + ["No result found"] * 3
    texts = [r["text"] for r in lookup.side_by_side(found).orderBy("combo_id").collect()]
    rule = "=" * 80
    assert texts == [f"{rule}\nRun: r\n{rule}\n1\n\n\n\n{rule}\nRun: s\n{rule}\nNo result found\n\n\n\n", None]


def test_export(spark, store, grid, tmp_path, rows):
    store.write_prompts(grid)
    store.append(records(spark, [("a", "1"), ("z", "2")]), T0)
    kept = grid.filter("prompt in ('a', 'b')")
    missing = store.export(kept, work(kept, [RUN]), str(tmp_path / "copy"))
    assert missing.count() == 1
    copy = ResultStore(spark, str(tmp_path / "copy"))
    assert rows(copy.latest().select("prompt")) == [("a",)] and rows(copy.prompts().select("prompt")) == [("a",), ("b",)]


def test_import_of_a_file_tree(spark, store, grid, tmp_path):
    import hashlib

    def folder(prompt):
        key = hashlib.sha1(prompt.encode()).hexdigest()
        path = tmp_path / "old" / "cache" / key[:2] / key
        path.mkdir(parents=True, exist_ok=True)
        (path / "prompt.txt").write_text(prompt)
        return path

    record = {"prompt": "a", "response": {"choices": []}, "timestamp": "20240101000000", "params": {"w": "a"},
              "usage": {"tokens in": 3, "cost": 0.5}, "elapsed_time": 1.5, "module_args": {"x": 1}}
    (folder("a") / f"result_{RUN.run_hash}.json").write_text(json.dumps(record))
    (folder("b") / f"result_{RUN.run_hash}.json").write_text("{broken")
    (folder("c") / f"result_{RUN.run_hash}.json.delayed").write_text(json.dumps({"prompt": "c", "delayed": {"batch_id": "b1"}}))
    (folder("d") / f"result_{RUN.run_hash}.json.delayed").write_text(json.dumps({"prompt": "d", "delayed": {"body": {"m": 1}}}))
    prompts, results, pending = import_cache_dir(spark, str(tmp_path / "old"))
    assert prompts.count() == 4
    row = results.first()
    assert results.count() == 1 and row["usage"]["tokens_in"] == 3 and row["elapsed_time"] == 1.5
    assert json.loads(row["response"]) == {"choices": []} and row["run_hash"] == RUN.run_hash
    assert {(r["prompt"], r["state"]) for r in pending.collect()} == {("c", "submitted"), ("d", "queued")}
    store.append(results)
    store.append_pending(pending)
    assert statuses(store, grid) == ["cached", "missing", "pending", "pending"]


def test_spread_is_even_and_ordered(spark):
    df = records(spark, [(str(k), "") for k in range(4000)])
    for tasks, wanted in ((None, 4), (2, 2), (64, 4)):
        parts = [[r.prompt_hash for r in p] for p in spread(df, tasks).select("prompt_hash").rdd.glom().collect()]
        assert len(parts) == wanted and max(map(len, parts)) < 1.2 * 4000 / wanted and all(p == sorted(p) for p in parts)


def _scan_side(df):
    """The physical plan, a line for each operator, without what stands on the side of the work."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line or "FileScan" in line]


def test_stored_records_are_not_shuffled(spark, store, rows):
    store.append(spread(records(spark, [(str(k), "x") for k in range(100)])), T0)
    store.append(spread(records(spark, [(str(k), "y") for k in range(50)])), T0 + timedelta(1))
    assert not [line for line in _scan_side(store.latest()) if "Exchange" in line]
    store.append_pending(spread(records(spark, [("999", "")]).withColumn("state", F.lit("queued"))), T0)
    asked = records(spark, [(str(k), "") for k in range(200)]).select(*lookup.KEYS).hint("merge")
    runs = asked.withColumn("run_hash", F.when(F.col("prompt_hash") > "8", "other").otherwise(F.col("run_hash")))
    assert len([line for line in _scan_side(store.lookup(runs)) if "Exchange hashpartitioning" in line]) == 1  # of the work
    assert store.lookup(asked).filter("status = 'cached'").count() == 100
    assert rows(store.latest().groupBy("response").count()) == [("x", 50), ("y", 50)]
    # one file for each bucket that holds rows, and the number of buckets is that of the first append
    folders = sorted(p for p in (spark.sparkContext._jvm.java.io.File(store.root + "/results").list()) if p.startswith("batch="))
    assert len(folders) == 2 and all("-n4-" in f for f in folders)


def test_buckets_stay_when_the_session_changes(spark, store, rows):
    store.append(spread(records(spark, [("a", "1"), ("b", "1")])), T0)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        store.append(records(spark, [("b", "2"), ("c", "2")]), T0 + timedelta(1))
        again = ResultStore(spark, store.root + "/")
        assert rows(again.latest().select("prompt", "response")) == [("a", "1"), ("b", "2"), ("c", "2")]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
