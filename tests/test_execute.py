import json
import sys

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from promptframe.functions.images import images, without_images
from promptframe.operators import batch, usage
from promptframe.operators.execute import execute, request_body, stub_response
from promptframe.operators.grid import distinct_work, expand, group_sizes
from promptframe.operators.runs import Module, RunKey
from promptframe.operators.store import ResultStore
from promptframe.sources.files import group_from_rows
from promptframe.sources.project import Project
from promptframe.streaming import jobs

# workers do not have the test folder on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RUN = RunKey("r", Module("m", "M", "mod", "1"), {"model": "x", "_key": "secret"})


class Echo:
    """Answers with the prompt, for one cent; writes down what it was asked."""

    def __init__(self, log, cost=0.01):
        self.log, self.cost = str(log), cost

    def open(self):
        pass

    def call(self, rows):
        with open(self.log, "a") as f:
            f.writelines(p + "\n" for p in rows["prompt"])
        return pd.DataFrame({"response": [json.dumps({"choices": [{"message": {"content": json.dumps({"p": p})}}]})
                                          for p in rows["prompt"]], "cost_value": self.cost})

    def close(self):
        pass


def grid_of(spark, names):
    return expand(Project(spark, {"q": "Hello {{name}}"}, {"n": group_from_rows(spark, [{"name": n} for n in names])}))


@pytest.fixture
def store(spark, tmp_path):
    return ResultStore(spark, str(tmp_path / "store"))


def calls(log):
    return sorted(log.read_text().splitlines()) if log.exists() else []


def test_one_call_per_distinct_prompt(spark, store, tmp_path):
    log = tmp_path / "log"
    done = execute(grid_of(spark, ["dup"] * 20 + ["unique"]), RUN, store, Echo(log), max_parallel=4)
    assert calls(log) == ["Hello dup", "Hello unique"]
    stats = usage.stats(done, currency="EUR").first()
    assert (stats["executed"], stats["cached"], stats["pending"]) == (2, 19, 0)
    assert stats["cost"] == pytest.approx(0.21) and stats["cost_currency"] == "EUR"
    assert stats["bytes_in"] == 20 * len("Hello dup") + len("Hello unique")


@pytest.mark.parametrize("tasks", [1, 8])
def test_second_run_is_cached(spark, store, tmp_path, tasks):
    log, grid = tmp_path / "log", grid_of(spark, [str(i) for i in range(30)])
    first = execute(grid, RUN, store, Echo(log), max_parallel=tasks)
    assert {r["status"] for r in first.collect()} == {"executed"}
    again = execute(grid, RUN, store, Echo(log), max_parallel=tasks)
    assert {r["status"] for r in again.collect()} == {"cached"} and len(calls(log)) == 30
    rows = again.orderBy("combo_id").collect()
    assert [json.loads(json.loads(r["response"])["choices"][0]["message"]["content"])["p"] for r in rows] == [
        f"Hello {i}" for i in range(30)]
    record = store.latest().first()
    assert json.loads(record["module_args_json"]) == {"model": "x"} and record["module_version"] == "1"
    assert len(record["timestamp"]) == 14


def test_budget_stops_between_waves(spark, store, tmp_path):
    log, grid = tmp_path / "log", grid_of(spark, [str(i) for i in range(20)])
    done = execute(grid, RUN, store, Echo(log), max_cost=0.05, wave=2, total=20)
    assert len(calls(log)) == 6  # 0.04 is below the budget, 0.06 is not
    counts = {r["status"]: r["count"] for r in done.groupBy("status").count().collect()}
    assert counts == {"executed": 6, "missing": 14}
    # what is stored counts too: nothing more is called
    execute(grid, RUN, store, Echo(log), max_cost=0.05, wave=2, total=20)
    assert len(calls(log)) == 6


def test_waves_without_a_budget(spark, store, tmp_path):
    log, grid = tmp_path / "log", grid_of(spark, [str(i) for i in range(40)])
    done = execute(grid, RUN, store, Echo(log), max_parallel=2, calls_per_task=5)
    assert len(calls(log)) == 40 == len(set(calls(log)))
    assert {r["status"] for r in done.collect()} == {"executed"}
    batches = [d for d in (tmp_path / "store" / "results").iterdir() if d.is_dir()]
    assert len(batches) == 4


def test_wrong_answer_count_is_an_error(spark, store):
    class Short(Echo):
        def call(self, rows):
            return pd.DataFrame({"response": []})

    with pytest.raises(Exception, match="every prompt"):
        execute(grid_of(spark, "ab"), RUN, store, Short("/dev/null"))


def test_stub():
    assert json.loads(stub_response())["choices"][0]["message"]["content"] == '"Stub response from the dummy model."'
    assert json.loads(stub_response('{"a":1}'))["choices"][0]["message"]["content"] == '{\n  "a": 1\n}'


def test_images(spark):
    uri = ["data:image/png;base64,AAA=", "data:image/gif;base64,BB"]
    text = f'x [{uri[0]}] "[{uri[1]}]" [{uri[0]}] [data:text/plain;base64,AA]'
    df = spark.createDataFrame([(text,)], "p string")
    row = df.select(without_images(F.col("p")), images(F.col("p")), request_body(F.col("p"), {
        "gpt_model": "m", "gpt_args": {"n": 1}, "gpt_json": False}).alias("b")).first()
    assert row[0] == 'x [img01] "[img02]" [img01] [data:text/plain;base64,AA]'
    assert row[1] == [uri[0], uri[1], uri[0]]
    content = json.loads(row["b"])["messages"][0]["content"]
    assert content[0] == {"type": "text", "text": row[0]} and json.loads(row["b"])["n"] == 1
    assert content[1:] == [{"type": "image_url", "image_url": {"url": u}} for u in row[1]]


def test_request_rules(spark):
    df = spark.createDataFrame([("p",)], "p string")

    def body(args):
        return json.loads(df.select(request_body(F.col("p"), args)).first()[0])

    base = {"gpt_args": {"temperature": 0.5, "n": 2, "top_p": 1}, "gpt_json": True}
    assert body({**base, "gpt_model": "m"})["response_format"] == {"type": "json_object"}
    search = body({**base, "gpt_model": "m-search-preview", "web_search": True})
    assert set(search) == {"model", "messages", "top_p", "web_search_options"}
    tool = body({**base, "gpt_model": "m", "web_search": True})
    assert tool["tools"] == [{"type": "web_search"}] and tool["text"] == {"format": {"type": "json_object"}}
    assert tool["input"][0]["content"] == [{"type": "input_text", "text": "p"}] and tool["temperature"] == 0.5
    queued = body({**base, "gpt_model": "m", "web_search": True, "batch_mode": True})
    assert "messages" in queued and "input" not in queued


# --- batches ---------------------------------------------------------------------------

BATCH_RUN = RunKey("b", Module("m", "M", "mod"), {"gpt_model": "gpt-4o", "batch_mode": True})


def queued(spark, store, names):
    grid = grid_of(spark, names)
    store.append_pending(batch.queue(store.misses(distinct_work(grid, [BATCH_RUN])), BATCH_RUN))
    return grid


def answers(lines):
    return "".join(json.dumps(
        {"custom_id": r["custom_id"], "response": {"body": {
            "model": "gpt-4o-2024-05-13", "usage": {"prompt_tokens": 1_000_000, "completion_tokens": 0},
            "choices": [{"message": {"content": "ok"}}]}}}) + "\n" for r in lines)


def test_batch_life(spark, store, tmp_path):
    grid = queued(spark, store, ["a", "b", "c"])
    batch.submit_queued(store, str(tmp_path / "requests"), "b1")
    sent = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "requests")).collect()]
    assert len(sent) == 3 and all(r["method"] == "POST" and r["body"]["model"] == "gpt-4o" for r in sent)
    # what is queued later belongs to another batch and leaves the first alone
    queued(spark, store, ["a", "b", "c", "d"])
    batch.submit_queued(store, str(tmp_path / "more"), "b2")
    assert spark.read.text(str(tmp_path / "more")).count() == 1
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "b1.jsonl").write_text(answers(sent[:2]))
    failed = tmp_path / "failed"
    failed.mkdir()
    (failed / "b1.jsonl").write_text(json.dumps(
        {"custom_id": sent[2]["custom_id"], "response": {"body": {"error": {"type": "bad"}}}}) + "\n")
    prices = batch.prices_table(spark, {"gpt-4o": {"input": 2.0, "output": 8.0}})
    finished = batch.ingest_batch(
        batch.read_batch_lines(spark, str(inbox)), prices, batch.read_batch_lines(spark, str(failed)),
        spark.createDataFrame([("b1", 90.0)], "batch_id string, elapsed double"))
    batch.settle(store, finished)
    assert batch.still_waiting(store) == 1  # the request of the second batch
    rows = {r["prompt_hash"]: r for r in store.latest().collect()}
    good = [rows[s["custom_id"]] for s in sent[:2]]
    assert [r["usage"]["cost"] for r in good] == [1.0, 1.0] and [r["elapsed_time"] for r in good] == [90.0, None]
    assert rows[sent[2]["custom_id"]]["error"] == "bad"
    assert good[0]["prompt"].startswith("Hello ") and good[0]["params"]["name"]
    # delivered twice: nothing changes
    batch.settle(store, finished)
    assert batch.still_waiting(store) == 1 and store.results().count() == 3
    assert grid.count() == 3


def test_streams(spark, store, tmp_path):
    queued(spark, store, ["a", "b"])
    batch.submit_queued(store, str(tmp_path / "requests"), "b1")
    sent = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "requests")).collect()]
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    prices = batch.prices_table(spark, {"gpt-4o": {"input": 2.0, "output": 8.0}})
    for n, line in enumerate(sent):  # one file per round, the stream goes on where it stopped
        (inbox / "b1.jsonl").write_text(answers([line])) if n == 0 else (inbox / f"b1.{n}").write_text(answers([line]))
        jobs.ingest_answers(jobs.answer_lines(spark, str(inbox)), store, prices, str(tmp_path / "progress")).awaitTermination()
        assert store.latest().count() == n + 1
    assert store.latest().filter("usage.cost = 1.0").count() == 2


def test_answers_meet_a_stream_of_requests(spark, store, tmp_path):
    queued(spark, store, ["a", "b", "c"])
    batch.submit_queued(store, str(tmp_path / "requests"), "b1")
    sent = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "requests")).collect()]
    prices = batch.prices_table(spark, {"gpt-4o": {"input": 2.0, "output": 8.0}})
    elapsed = spark.createDataFrame([("b1", 90.0), ("b2", 7.0)], "batch_id string, elapsed double")
    inbox = tmp_path / "inbox"
    inbox.mkdir()

    def go_on():
        jobs.settle_answers(jobs.timed_lines(spark, str(inbox)), store, prices, str(tmp_path / "progress"),
                            elapsed).awaitTermination()

    (inbox / "b1.jsonl").write_text(answers(sent[:1]) + answers(sent[:1]) + "\n" + '{"custom_id":null}\n{broken\n')
    go_on()
    # the first line again beside a new one, an answer of another batch, and one before its request
    queued(spark, store, ["d"])
    early = [r["prompt_hash"] for r in batch.waiting(store.pending()).filter("state = 'queued'").collect()]
    (inbox / "b1.2").write_text(answers(sent[:2]))
    (inbox / "b2.jsonl").write_text(answers(sent[2:]) + answers([{"custom_id": early[0]}]))
    go_on()
    assert store.results().count() == 2
    batch.submit_queued(store, str(tmp_path / "more"), "b2")
    go_on()
    rows = {(r["batch_id"], r["prompt_hash"]): r for r in store.results().collect()}
    assert len(rows) == store.results().count() == 3 and batch.still_waiting(store) == 1
    assert [rows["b1", s["custom_id"]]["elapsed_time"] for s in sent[:2]] == [90.0, None]  # the earlier micro-batch
    assert rows["b2", early[0]]["elapsed_time"] == 7.0 and rows["b2", early[0]]["usage"]["cost"] == 1.0
    assert rows["b2", early[0]]["prompt"].startswith("Hello ")


def test_records_named_once_are_written_once(spark, store):
    done = spark.createDataFrame([("p", "r", "{}")], "prompt_hash string, run_hash string, response string")
    assert store.append(done, once="x/0") == store.append(done, once="x/0") != store.append(done, once="x/1")
    assert store.results().count() == 2


def test_stream_of_errors(spark, store, tmp_path):
    queued(spark, store, ["a"])
    batch.submit_queued(store, str(tmp_path / "requests"), "b1")
    key = json.loads(spark.read.text(str(tmp_path / "requests")).first()[0])["custom_id"]
    inbox = tmp_path / "failed"
    inbox.mkdir()
    (inbox / "b1.jsonl").write_text(json.dumps({"custom_id": key, "response": {"body": {"error": {"type": "bad"}}}}) + "\n")
    prices = batch.prices_table(spark, {"gpt-4o": {"input": 2.0}})
    jobs.ingest_answers(jobs.answer_lines(spark, str(inbox)), store, prices, str(tmp_path / "progress"),
                        failed=True).awaitTermination()
    assert [(r["prompt_hash"], r["error"]) for r in store.latest().collect()] == [(key, "bad")]


def test_prices_of_providers(spark):
    prices = batch.provider_prices(spark, {"a": {"m": {"input": 1}, "x*": {"input": 2}}, None: {"m": {"input": 3}, "y": {"input": 4}}})
    df = spark.createDataFrame([("a", "m"), ("a", "m-2024-01-02"), ("a", "xy"), ("a", "y"), ("b", "m"), ("b", "xy"),
                                (None, "m"), ("", "y"), ("a", None)], "module_name string, model string")
    got = [r["price_in"] for r in usage.price_join(df.coalesce(1), prices).collect()]
    assert got == [1.0, 1.0, 2.0, 4.0, 3.0, None, 3.0, 4.0, None]
    # without the column only prices for all count
    assert [r["price_in"] for r in usage.price_join(df.drop("module_name").limit(1), prices).collect()] == [3.0]


def test_spend_per_window(spark):
    log = spark.createDataFrame([("2024-01-01 00:10:00", 0.1), ("2024-01-01 00:50:00", 0.2), ("2024-01-01 01:00:00", 1.0)],
                                "at string, cost double").withColumn("written_at", F.col("at").cast("timestamp"))
    rows = jobs.spend_per_window(log).orderBy("window_start").collect()
    assert [(r["answers"], r["cost"]) for r in rows] == [(2, 0.3), (1, 1.0)]


# --- money -----------------------------------------------------------------------------


def test_budget_audit_against_brute_force(spark):
    costs = [(i, ((i * 7919) % 101) / 100) for i in range(500)]
    df = spark.createDataFrame(costs, "combo_id bigint, cost double").repartition(7)
    for limit in (0.5, 10.0, 123.45):
        want, spent = [], 0
        for i, c in costs:
            if spent >= round(limit * 100):
                break
            want.append(i)
            spent += round(c * 100)
        got = usage.within_budget(df, limit, block_rows=16)
        assert sorted(r["combo_id"] for r in got.collect()) == want
    assert usage.within_budget(df, 0).count() == 500


def test_price_rules(spark):
    prices = batch.prices_table(spark, {"gpt-4*": {"input": 1}, "gpt-4o": {"input": 2}, "gpt-*": {"input": 3},
                                        "o1-2024-01-01": {"input": 4}, "*": {"input": 5}})
    names = ["gpt-4o", "gpt-4o-2024-05-13", "gpt-4", "gpt-5", "o1-2024-01-01", "o1", "", "gpt-4o-2024-5-13"]
    df = spark.createDataFrame([(n,) for n in names], "model string")
    got = {r["model"]: r["price_in"] for r in usage.price_join(df, prices).collect()}
    assert got == {"gpt-4o": 2, "gpt-4o-2024-05-13": 2, "gpt-4": 1, "gpt-5": 3, "o1-2024-01-01": 4, "o1": 5, "": 5,
                   "gpt-4o-2024-5-13": 1}
    assert usage.price_join(df, prices.filter("ord > 9")).filter("price_in IS NOT NULL").count() == 0


def test_total_stats(spark):
    rows = [("b", 1, 2, 0, 10, 20, 30, 40, 0.1, 2.0, "EUR", "2"), ("a", 3, 0, 1, 1, 2, 3, 4, 0.2, 1.0, "USD", "9")]
    df = spark.createDataFrame(rows, "run_name string, executed bigint, cached bigint, pending bigint, tokens_in bigint, "
                               "tokens_out bigint, bytes_in bigint, bytes_out bigint, cost double, max_cost double, "
                               "cost_currency string, max_timestamp string")
    got = usage.total_stats(df).first()
    assert (got["executed"], got["cached"], got["pending"], got["cost"], got["max_cost"]) == (4, 2, 1, 0.3, 2.0)
    assert got["cost_currency"] == "USD" and got["max_timestamp"] == "9"


def test_sizes_can_be_reused(spark):
    groups = {"n": group_from_rows(spark, [{"name": "a"}])}
    sizes = group_sizes(groups)
    assert sizes["n"].rows == 1 and sizes["n"].broadcastable


def test_ledger_holds_what_each_wave_costs(spark, tmp_path):
    texts = ["a", "bb", "a", "ccc", "bb", "dddd", "a"]
    grid = expand(Project(spark, {"p": "{{t}}"}, {"g": group_from_rows(spark, [{"t": t} for t in texts])}))

    class Priced(Echo):
        def call(self, batch):
            return pd.DataFrame({"response": ["{}"] * len(batch), "cost_value": [float(len(p)) for p in batch["prompt"]]})

    store, run = ResultStore(spark, str(tmp_path / "s")), RunKey("r", Module("m", "M", "m"), {})
    first = execute(grid, run, store, Priced(tmp_path / "log"), max_cost=6.5, wave=2).orderBy("combo_id").collect()
    # 3 after the first wave, 4 more with the second, so the third does not start
    assert [r.status for r in first] == ["executed", "executed", "cached", "executed", "cached", "missing", "cached"]
    entries = sorted((r.wave, r.served, float(r.cost)) for r in store.ledger().collect())
    assert entries == [(0, 0, 3.0), (0, 1, 1.0), (0, 2, 2.0), (0, 3, 1.0), (1, 1, 3.0)]
    again = execute(grid, run, store, Priced(tmp_path / "log"), max_cost=100, wave=2).orderBy("combo_id").collect()
    assert [r.status for r in again] == ["cached"] * 5 + ["executed", "cached"]
    runs = {r.run_id: float(r.cost) for r in store.ledger(run.run_hash).groupBy("run_id").agg(F.sum("cost").alias("cost")).collect()}
    assert sorted(runs.values()) == [10.0, 14.0]
