"""Queries over stored results: lookups, expiry, usage, budget, batches, execution."""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from promptframe.operators import batch, lookup, usage
from promptframe.operators.analysis import answered
from promptframe.operators.execute import execute, request_body, stub_answers
from promptframe.operators.grid import expand, work
from promptframe.operators.runs import RunKey
from promptframe.operators.store import ResultStore, spread
from promptframe.plans.registry import CHAT, RUN_A, RUN_B, STUB, group, query, table
from promptframe.session import shared_dir
from promptframe.sources.files import group_from_rows
from promptframe.sources.project import Project
from promptframe.streaming import jobs

A, B = RUN_A.run_hash, RUN_B.run_hash
NOW = datetime(2024, 1, 31)
TYPES = ["click", "error", "purchase", "signup", "view"]
DAY = 86400.0

EVENT_SQL = f"""
  SELECT event_id, sha1(p) AS prompt_hash, CASE WHEN value < 20 THEN '{A}' ELSE '{B}' END AS run_hash,
         p AS original, CASE WHEN value > 150 THEN p || '!' ELSE p END AS prompt,
         '{{"choices":[{{"message":{{"content":"' || CASE WHEN value > 60 THEN 'no number'
            ELSE '{{\\"value\\": ' || value::varchar || '}}' END || '"}}}}]}}' AS response,
         value, event_type, props, ts AS written_at
  FROM (SELECT *, 'Review ' || event_type || ' events of customer ' || user_id AS p FROM events)
"""
WORK_SQL = f"""
  SELECT c_custkey * 5 + t.i AS combo_id, r.run_name, r.run_ord, r.run_hash,
         sha1('Review ' || t.name || ' events of customer ' || c_custkey) AS prompt_hash
  FROM customer, (VALUES {", ".join(f"({i}, '{t}')" for i, t in enumerate(TYPES))}) t(i, name),
       (VALUES (0, 'first', '{A}'), (1, 'second', '{B}')) r(run_ord, run_name, run_hash)
"""
HIT_SQL = f"""
  SELECT prompt_hash, run_hash FROM ({EVENT_SQL}) GROUP BY prompt_hash, run_hash
  HAVING max(written_at) = max(written_at) FILTER (sha1(prompt) = prompt_hash)
     AND TIMESTAMP '2024-01-31' - max(written_at) < INTERVAL 20 DAY
"""
PENDING_SQL = f"""
  SELECT prompt_hash, run_hash FROM ({EVENT_SQL}) WHERE event_type = 'error' GROUP BY prompt_hash, run_hash
  HAVING max(written_at) FILTER (value >= 4) IS NULL OR max(written_at) > max(written_at) FILTER (value >= 4)
"""
LATEST_SQL = f"""
  SELECT prompt_hash, run_hash, max(written_at) AS written_at, arg_max(response, written_at) AS response
  FROM ({EVENT_SQL}) GROUP BY prompt_hash, run_hash
"""


def _results(spark: SparkSession, sf: str) -> DataFrame:
    """One stored record per event, with some stale prompts and some unreadable answers."""
    prompt = F.concat(F.lit("Review "), "event_type", F.lit(" events of customer "), F.col("user_id").cast("string"))
    content = F.when(F.col("value") > 60, "no number").otherwise(
        F.concat(F.lit('{\\"value\\": '), F.col("value").cast("string"), F.lit("}")))
    return table(spark, sf, "events").select(
        "event_id", F.sha1(prompt).alias("prompt_hash"), F.substring(F.sha1(prompt), 1, 2).alias("hash_prefix"),
        F.when(F.col("value") < 20, A).otherwise(B).alias("run_hash"), prompt.alias("original"),
        F.when(F.col("value") > 150, F.concat(prompt, F.lit("!"))).otherwise(prompt).alias("prompt"),
        F.concat(F.lit('{"choices":[{"message":{"content":"'), content, F.lit('"}}]}')).alias("response"),
        "value", "event_type", "props", F.col("ts").alias("written_at"))


def _pending(spark: SparkSession, sf: str) -> DataFrame:
    return _results(spark, sf).filter("event_type = 'error'").withColumns({
        "state": F.when(F.col("value") < 4, "queued").otherwise("done"), "body": F.col("props")})


def _grid(spark: SparkSession, sf: str) -> DataFrame:
    return expand(Project(spark, {"r": "Review {{event_type}} events of customer {{c_custkey}}"}, {
        "customer": group(spark, sf, "customer", "c_custkey"),
        "types": group_from_rows(spark, [{"event_type": t} for t in TYPES])}))


def _work(spark: SparkSession, sf: str) -> DataFrame:
    return work(_grid(spark, sf), [RUN_A, RUN_B]).select(
        "combo_id", "run_name", "run_ord", "hash_prefix", "prompt_hash", "run_hash")


# --- lookups -----------------------------------------------------------------------


@query(f"""
  SELECT combo_id, run_name, CASE WHEN p.prompt_hash IS NOT NULL THEN 'pending'
                                  WHEN h.prompt_hash IS NOT NULL THEN 'cached' ELSE 'missing' END AS status
  FROM ({WORK_SQL}) w LEFT JOIN ({HIT_SQL}) h USING (prompt_hash, run_hash)
                      LEFT JOIN ({PENDING_SQL}) p USING (prompt_hash, run_hash)""")
def cache_hits(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.lookup(_work(spark, sf), _results(spark, sf), _pending(spark, sf), NOW, 20 * DAY).select(
        "combo_id", "run_name", "status")


@query(f"""
  SELECT combo_id, run_name FROM ({WORK_SQL}) w
  WHERE NOT EXISTS (SELECT 1 FROM ({HIT_SQL}) h WHERE h.prompt_hash = w.prompt_hash AND h.run_hash = w.run_hash)
    AND NOT EXISTS (SELECT 1 FROM ({PENDING_SQL}) p WHERE p.prompt_hash = w.prompt_hash AND p.run_hash = w.run_hash)""")
def cache_misses(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.misses(_work(spark, sf), _results(spark, sf), _pending(spark, sf), NOW, 20 * DAY).select(
        "combo_id", "run_name")


@query("""SELECT user_id, event_type, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value
          FROM events GROUP BY user_id, event_type""")
def cache_latest(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return lookup.latest(events, ["user_id", "event_type"], "ts").drop("ts")


@query("""
  WITH o AS (SELECT user_id, event_type, arg_max(event_id, ts) AS event_id FROM events WHERE value >= 50 GROUP BY ALL),
       m AS (SELECT user_id, event_type, arg_max(event_id, ts) AS event_id FROM events WHERE value < 50 GROUP BY ALL)
  SELECT user_id, event_type, coalesce(o.event_id, m.event_id) AS event_id
  FROM m FULL JOIN o USING (user_id, event_type)""")
def cache_merge(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value", "ts")
    by = ["user_id", "event_type"]
    return lookup.merge(events.filter("value < 50"), events.filter("value >= 50"), by, "ts").select(
        "user_id", "event_type", "event_id")


CHANGED_SQL = """
  SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'equal' ELSE 'different' END AS status FROM customer
  UNION ALL SELECT s_suppkey + 10000000, 'copied' FROM supplier
"""


def _diff(spark: SparkSession, sf: str) -> DataFrame:
    customer, supplier = table(spark, sf, "customer"), table(spark, sf, "supplier")
    mine = customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("text"))
    theirs = customer.select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_acctbal") < 0, F.col("c_mktsegment")).otherwise("changed").alias("text")
    ).unionByName(supplier.select((F.col("s_suppkey") + 10000000).alias("id"), F.col("s_name").alias("text")))
    return lookup.diff(mine, theirs, ["text"], ["id"])


@query(CHANGED_SQL)
def cache_diff(spark: SparkSession, sf: str) -> DataFrame:
    return _diff(spark, sf)


@query(f"""SELECT count(*) FILTER (status = 'copied') AS copied, count(*) FILTER (status = 'equal') AS "equal",
                  count(*) FILTER (status = 'different') AS different FROM ({CHANGED_SQL})""")
def cache_diff_counts(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.diff_counts(_diff(spark, sf))


@query(f"""SELECT event_id FROM ({EVENT_SQL}) WHERE TIMESTAMP '2024-01-31' - written_at >= INTERVAL 10 DAY""")
def cache_expire_age(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.expired(_results(spark, sf), NOW, 10 * DAY).select("event_id")


@query(f"SELECT event_id FROM ({EVENT_SQL}) WHERE value > 60")
def cache_expire_errors(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.expired(_results(spark, sf), NOW, errors_only=True).select("event_id")


@query(f"""SELECT event_id FROM ({EVENT_SQL})
           WHERE (prompt_hash, run_hash) IN (SELECT (prompt_hash, run_hash) FROM ({WORK_SQL}))
             AND TIMESTAMP '2024-01-31' - written_at >= INTERVAL 5 DAY AND value > 60""")
def cache_expire_keys(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.expired(_results(spark, sf), NOW, 5 * DAY, True, _work(spark, sf)).select("event_id")


@query(f"""
  WITH p AS (SELECT DISTINCT original FROM ({EVENT_SQL})), r AS ({LATEST_SQL}),
       d AS (SELECT props FROM ({EVENT_SQL}) WHERE event_type = 'error' AND value < 4),
       b AS (SELECT (SELECT sum(strlen(original)) FROM p) + (SELECT sum(strlen(response)) FROM r)
                    + (SELECT sum(strlen(props)) FROM d) AS n)
  SELECT (SELECT count(*) FROM p) + (SELECT count(*) FROM r) + (SELECT count(*) FROM d) AS total_files,
         b.n::bigint AS total_size_bytes, round(b.n / (1024 * 1024), 2) AS total_size_mb,
         (SELECT count(*) FROM p) AS prompt_files_count, (SELECT count(*) FROM r) AS result_files_count,
         (SELECT count(*) FROM d) AS delayed_files_count FROM b""")
def cache_statistics(spark: SparkSession, sf: str) -> DataFrame:
    results = _results(spark, sf)
    prompts = results.select(F.col("original").alias("prompt")).distinct()
    newest = lookup.latest(results.select(*lookup.KEYS, "response", "written_at"))
    return lookup.statistics(prompts, newest, _pending(spark, sf).filter("state = 'queued'"))


@query(f"""SELECT combo_id, run_name, coalesce(response, 'No result found') AS content
           FROM ({WORK_SQL}) LEFT JOIN ({LATEST_SQL}) USING (prompt_hash, run_hash)""")
def results_by_run(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.results_for(_work(spark, sf), _results(spark, sf)).select("combo_id", "run_name", "content")


@query(f"""
  SELECT combo_id, CASE WHEN count(response) > 0 THEN md5(string_agg(
      repeat('=', 80) || chr(10) || 'Run: ' || run_name || chr(10) || repeat('=', 80) || chr(10)
      || coalesce(response, 'No result found') || repeat(chr(10), 4), '' ORDER BY run_ord)) END AS text
  FROM ({WORK_SQL}) LEFT JOIN ({LATEST_SQL}) USING (prompt_hash, run_hash) GROUP BY combo_id""")
def results_side_by_side(spark: SparkSession, sf: str) -> DataFrame:
    found = lookup.results_for(_work(spark, sf), _results(spark, sf))
    return lookup.side_by_side(found).select("combo_id", F.md5("text").alias("text"))


@query(f"""SELECT event_id FROM ({EVENT_SQL})
           WHERE (prompt_hash, run_hash) IN (SELECT (prompt_hash, run_hash) FROM ({WORK_SQL}))""")
def cache_export(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.export(_work(spark, sf), _results(spark, sf)).select("event_id")


@query(f"""SELECT DISTINCT prompt_hash, run_hash FROM ({WORK_SQL})
           WHERE (prompt_hash, run_hash) NOT IN (SELECT (prompt_hash, run_hash) FROM ({EVENT_SQL}))""")
def cache_missing(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.missing(_work(spark, sf), _results(spark, sf)).select("prompt_hash", "run_hash")


@query(f"""
  SELECT 'prompt' AS kind, prompt_hash, NULL AS run_hash FROM (SELECT DISTINCT prompt_hash FROM ({WORK_SQL}))
  UNION ALL SELECT 'result', prompt_hash, run_hash FROM ({LATEST_SQL})
  WHERE json_extract_string(response, '$.choices[0].message.content') <> 'no number'""")
def store_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Write prompts and results, expire the unreadable answers, list what is stored."""
    store = ResultStore(spark, shared_dir(spark, "store"))
    store.write_prompts(_grid(spark, sf))
    newest = lookup.latest(_results(spark, sf).select(*lookup.KEYS, "prompt", "response", "written_at"))
    store.append(spread(newest))
    store.expire(errors_only=True)
    return store.scan().select("kind", "prompt_hash", "run_hash")


# --- usage and money ----------------------------------------------------------------

PRICES = {
    "gpt-4o": {"input": 2.5, "output": 10.0},
    "gpt-4o-mini*": {"input": 0.15, "output": 0.6},
    "gpt-*": {"input": 1.0, "output": 2.0},
    "o1*": {"input": 15.0, "output": 60.0},
}
MODELS = {"click": "gpt-4o-2024-05-13", "view": "gpt-4o", "purchase": "gpt-4o-mini-x", "signup": "other",
          "error": "gpt-9-2024-01-01"}
PRICE_SQL = """CASE event_type WHEN 'click' THEN 2.5::double WHEN 'view' THEN 2.5 WHEN 'purchase' THEN 0.15
                               WHEN 'error' THEN 1.0 END"""
PRICE_OUT_SQL = """CASE event_type WHEN 'click' THEN 10.0::double WHEN 'view' THEN 10.0 WHEN 'purchase' THEN 0.6
                                   WHEN 'error' THEN 2.0 END"""
USAGE_SQL = f"""
  SELECT event_id, event_type, value, ts, user_id,
         CASE WHEN event_type = 'error' THEN 0 ELSE user_id * 10 + 3 END AS tokens_in,
         CASE WHEN event_type = 'error' THEN 0 ELSE event_id END AS tokens_out,
         {PRICE_SQL} AS price_in, {PRICE_OUT_SQL} AS price_out
  FROM events
"""
COST_SQL = f"""
  SELECT *, coalesce(tokens_in / 1000000.0::double * price_in, 0) AS cost_in,
         coalesce(tokens_out / 1000000.0::double * price_out, 0) AS cost_out FROM ({USAGE_SQL})
"""


def _responses(spark: SparkSession, sf: str) -> DataFrame:
    """One response per event; the token names depend on the event type."""
    model = F.element_at(F.create_map(*[F.lit(x) for kv in MODELS.items() for x in kv]), F.col("event_type"))
    a, b = (F.col("user_id") * 10 + 3).cast("string"), F.col("event_id").cast("string")
    chat = F.concat(F.lit('{"prompt_tokens":'), a, F.lit(',"completion_tokens":'), b, F.lit("}"))
    other = F.concat(F.lit('{"input_tokens":'), a, F.lit(',"output_tokens":'), b, F.lit("}"))
    counts = (F.when(F.col("event_type").isin("click", "view"), chat)
              .when(F.col("event_type") == "error", F.concat(F.lit('{"prompt_tokens":'), a, F.lit("}")))
              .otherwise(other))
    return table(spark, sf, "events").select(
        "event_id", "event_type", "value", "ts", F.col("props").alias("prompt"),
        F.concat(F.lit('{"model":"'), model, F.lit('","usage":'), counts, F.lit("}")).alias("response"))


@query(f"SELECT event_id, price_in, price_out FROM ({USAGE_SQL})")
def price_lookup(spark: SparkSession, sf: str) -> DataFrame:
    models = _responses(spark, sf).select("event_id", usage.model_name(F.col("response")).alias("model"))
    return usage.price_join(models, batch.prices_table(spark, PRICES)).select("event_id", "price_in", "price_out")


@query(f"""
  SELECT event_id, CASE WHEN user_id % 3 = 0 AND event_type IN ('click', 'view') THEN 7.0::double
                        WHEN user_id % 3 = 0 AND event_type = 'signup' THEN 9.0 ELSE price_in END AS price_in,
         CASE WHEN user_id % 3 = 0 AND event_type IN ('click', 'view') THEN 8.0::double
              WHEN user_id % 3 = 0 AND event_type = 'signup' THEN 0.0 ELSE price_out END AS price_out FROM ({USAGE_SQL})""")
def price_by_provider(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the users ask a provider with prices of its own; what it does not list costs as elsewhere."""
    models = _responses(spark, sf).join(table(spark, sf, "events").select("event_id", "user_id"), "event_id").select(
        "event_id", usage.model_name(F.col("response")).alias("model"),
        F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("module_name"))
    prices = batch.provider_prices(spark, {
        None: PRICES, "p0": {"gpt-4o": {"input": 7, "output": 8}, "ot*": {"input": 9}}, "p9": {"*": {"input": 99}}})
    return usage.price_join(models, prices).select("event_id", "price_in", "price_out")


@query(f"SELECT event_id, tokens_in, tokens_out FROM ({USAGE_SQL})")
def token_usage(spark: SparkSession, sf: str) -> DataFrame:
    return _responses(spark, sf).select("event_id", usage.token_usage(F.col("response")).alias("u")).select(
        "event_id", "u.tokens_in", "u.tokens_out")


@query(f"SELECT event_id, cost_in, cost_out, (cost_in + cost_out) * (1.0::double - 0.0::double) AS cost FROM ({COST_SQL})")
def token_cost(spark: SparkSession, sf: str) -> DataFrame:
    done = usage.with_usage(_responses(spark, sf), batch.prices_table(spark, PRICES))
    return done.select("event_id", "usage.cost_in", "usage.cost_out", "usage.cost")


@query(f"SELECT event_id, (cost_in + cost_out) * (1.0::double - 0.5::double) AS cost FROM ({COST_SQL})")
def batch_discount(spark: SparkSession, sf: str) -> DataFrame:
    done = usage.with_usage(_responses(spark, sf), batch.prices_table(spark, PRICES), batch.BATCH_DISCOUNT)
    return done.select("event_id", "usage.cost")


@query(f"""SELECT event_id, tokens_in, CASE WHEN event_type = 'view' THEN 0 WHEN event_type = 'click' THEN value * 2
                  ELSE value END AS cost_in, CASE WHEN event_type = 'click' THEN value / 2 ELSE 0 END AS cost_out
           FROM ({USAGE_SQL})""")
def cost_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """A cost that is absent (view), given per direction (click) or one number."""
    kind, value = F.col("event_type"), F.col("value")
    shape = usage.normalized_cost(
        F.when(~kind.isin("view", "click"), value), usage.token_usage(F.col("response")),
        F.when(kind == "click", value * 2), F.when(kind == "click", value / 2))
    return _responses(spark, sf).select("event_id", shape.alias("c")).select(
        "event_id", "c.tokens_in", "c.cost_in", "c.cost_out")


@query("SELECT doc_id, strlen(text) AS bytes_in, strlen(lang) AS bytes_out FROM documents")
def byte_usage(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", usage.byte_usage(F.col("text"), F.col("lang")).alias("b")).select(
        "doc_id", "b.bytes_in", "b.bytes_out")


STATUS_SQL = "CASE event_type WHEN 'purchase' THEN 'executed' WHEN 'signup' THEN 'pending' WHEN 'error' THEN 'missing' ELSE 'cached' END"


def _status_work(spark: SparkSession, sf: str) -> DataFrame:
    done = usage.with_usage(_responses(spark, sf), batch.prices_table(spark, PRICES))
    kind = F.col("event_type")
    return done.select(
        "*", F.when(F.col("value") < 20, "first").otherwise("second").alias("run_name"),
        F.when(kind == "purchase", "executed").when(kind == "signup", "pending")
        .when(kind == "error", "missing").otherwise("cached").alias("status"),
        F.date_format("ts", "yyyyMMddHHmmss").alias("timestamp"), F.col("value").alias("elapsed_time"))


MODEL_SQL = "CASE c.event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MODELS.items()) + " END"
RESPONSE_SQL = f"""'{{"model":"' || {MODEL_SQL} || '","usage":{{' || CASE
    WHEN c.event_type IN ('click', 'view') THEN '"prompt_tokens":' || (c.user_id * 10 + 3) || ',"completion_tokens":' || c.event_id
    WHEN c.event_type = 'error' THEN '"prompt_tokens":' || (c.user_id * 10 + 3)
    ELSE '"input_tokens":' || (c.user_id * 10 + 3) || ',"output_tokens":' || c.event_id END || '}}}}'"""
STATS_SQL = f"""
  SELECT CASE WHEN c.value < 20 THEN 'first' ELSE 'second' END AS run_name,
         count(*) FILTER (s = 'executed') AS executed, count(*) FILTER (s = 'cached') AS cached,
         count(*) FILTER (s = 'pending') AS pending,
         coalesce(sum(tokens_in) FILTER (ok), 0)::bigint AS tokens_in,
         coalesce(sum(tokens_out) FILTER (ok), 0)::bigint AS tokens_out,
         coalesce(sum(strlen(props)) FILTER (ok), 0)::bigint AS bytes_in,
         coalesce(sum(strlen({RESPONSE_SQL})) FILTER (ok), 0)::bigint AS bytes_out,
         coalesce(sum(((cost_in + cost_out) * 1.0::double)::decimal(38, 12)) FILTER (ok), 0)::double AS cost,
         1.5::double AS max_cost, min(CASE WHEN c.value < 20 THEN 'BRL' ELSE 'USD' END) AS cost_currency,
         max(strftime(c.ts, '%Y%m%d%H%M%S')) FILTER (ok) AS max_timestamp
  FROM (SELECT *, {STATUS_SQL} AS s, {STATUS_SQL} IN ('executed', 'cached') AS ok FROM ({COST_SQL})) c
  JOIN events e USING (event_id) GROUP BY 1
"""


@query(STATS_SQL)
def run_stats(spark: SparkSession, sf: str) -> DataFrame:
    """One run is paid in another currency."""
    return usage.stats(_status_work(spark, sf), 1.5, {"first": "BRL"})


@query(f"""SELECT sum(executed)::bigint AS executed, sum(cached)::bigint AS cached, sum(pending)::bigint AS pending,
                  sum(tokens_in)::bigint AS tokens_in, sum(tokens_out)::bigint AS tokens_out,
                  sum(bytes_in)::bigint AS bytes_in, sum(bytes_out)::bigint AS bytes_out,
                  sum(cost::decimal(38, 12))::double AS cost, max(max_cost) AS max_cost,
                  arg_min(cost_currency, run_name) AS cost_currency, max(max_timestamp) AS max_timestamp
           FROM ({STATS_SQL})""")
def total_stats(spark: SparkSession, sf: str) -> DataFrame:
    return usage.total_stats(usage.stats(_status_work(spark, sf), 1.5, {"first": "BRL"}))


@query(f"""SELECT CASE WHEN value < 20 THEN 'first' ELSE 'second' END AS run_name,
                  sum(tokens_in)::bigint AS "Tokens Input", sum(tokens_out)::bigint AS "Tokens Output",
                  sum(cost_in::decimal(38, 12))::double AS "Cost Input",
                  sum(cost_out::decimal(38, 12))::double AS "Cost Output",
                  (sum(cost_in::decimal(38, 12)) + sum(cost_out::decimal(38, 12)))::double AS "Cost"
           FROM ({COST_SQL}) GROUP BY 1""")
def cost_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rows = usage.analyse_cost(_status_work(spark, sf))
    return usage.reduce_cost(rows, "run_name").drop("Bytes Input", "Bytes Output")


@query(f"""SELECT CASE WHEN value < 20 THEN 'first' ELSE 'second' END AS run_name,
                  sum(value::decimal(18, 2))::double AS elapsed_time,
                  sum((cost_in + cost_out)::decimal(38, 12))::double AS total_cost FROM ({COST_SQL}) GROUP BY 1""")
def run_info(spark: SparkSession, sf: str) -> DataFrame:
    return usage.run_info(_status_work(spark, sf), "run_name")


CENTS_SQL = """SELECT o_orderkey, sum(round(o_totalprice * 100)::bigint) OVER (
                 ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cents FROM orders"""


def _spending(spark: SparkSession, sf: str) -> DataFrame:
    orders = group(spark, sf, "orders", "o_orderkey", "o_totalprice")
    return orders.select(F.col("_ord").alias("combo_id"), "o_orderkey", F.col("o_totalprice").alias("cost"))


@query(f"SELECT o_orderkey, coalesce(cents, 0) / 100.0::double AS spent_before FROM ({CENTS_SQL})")
def budget_prefix(spark: SparkSession, sf: str) -> DataFrame:
    spent = usage.spent_before(_spending(spark, sf), block_rows=4096)
    return spent.select("o_orderkey", F.col("spent_before").cast("double").alias("spent_before"))


@query(f"SELECT o_orderkey FROM ({CENTS_SQL}) WHERE coalesce(cents, 0) < 100000000000")
def budget_stop(spark: SparkSession, sf: str) -> DataFrame:
    return usage.within_budget(_spending(spark, sf), 1e9, block_rows=4096).select("o_orderkey")


# --- requests and batches -------------------------------------------------------------

CHAT_RUN = RunKey("chat", CHAT, {"gpt_model": "gpt-4o", "gpt_args": {"temperature": 0.5, "n": 1}, "gpt_json": True})
SEARCH_RUN = RunKey("search", CHAT, {"gpt_model": "m-search-preview", "gpt_args": {"temperature": 0.5, "top_p": 1},
                                     "gpt_json": True, "web_search": True})
TOOL_RUN = RunKey("tool", CHAT, {"gpt_model": "gpt-4o", "gpt_args": {"temperature": 0.5}, "web_search": True})


@query("""
  SELECT conv_id, turn,
    md5('{"model":"gpt-4o","messages":[{"role":"user","content":[{"type":"text","text":' || to_json(text)
        || '},{"type":"image_url","image_url":{"url":"data:image/png;base64,QUJD"}}]}],"temperature":0.5,"n":1,'
        || '"response_format":{"type":"json_object"}}') AS chat,
    md5('{"model":"m-search-preview","messages":[{"role":"user","content":[{"type":"text","text":' || to_json(text)
        || '},{"type":"image_url","image_url":{"url":"data:image/png;base64,QUJD"}}]}],"top_p":1,'
        || '"web_search_options":{"user_location":{"type":"approximate","approximate":{"country":"BR"}}}}') AS search,
    md5('{"model":"gpt-4o","input":[{"role":"user","content":[{"type":"input_text","text":' || to_json(text)
        || '},{"type":"input_image","image_url":"data:image/png;base64,QUJD"}]}],"text":{},"temperature":0.5,'
        || '"tools":[{"type":"web_search"}]}') AS tool
  FROM (SELECT conv_id, turn, text || ' [img01]' AS text FROM conversations)""")
def request_bodies(spark: SparkSession, sf: str) -> DataFrame:
    prompt = F.concat("text", F.lit(" [data:image/png;base64,QUJD]"))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.md5(request_body(prompt, CHAT_RUN.args)).alias("chat"),
        F.md5(request_body(prompt, SEARCH_RUN.args)).alias("search"),
        F.md5(request_body(prompt, TOOL_RUN.args)).alias("tool"))


TURN_SQL = "SELECT *, sha1(conv_id || '/' || turn || ': ' || text) AS prompt_hash FROM conversations"


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    prompt = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit(": "), "text")
    return table(spark, sf, "conversations").select(
        "*", prompt.alias("prompt"), F.sha1(prompt).alias("prompt_hash"),
        F.substring(F.sha1(prompt), 1, 2).alias("hash_prefix"))


def _submitted(spark: SparkSession, sf: str) -> DataFrame:
    """Requests of all turns: user and assistant turns are in batches, the others queued."""
    queued = _turns(spark, sf).withColumns({
        "run_hash": F.lit(CHAT_RUN.run_hash), "module_name": F.lit("Chat"), "module_version": F.lit("2.0.0"),
        "args_json": F.lit("{}"), "masked": F.create_map(F.lit("turn"), F.col("turn").cast("string"))})
    in_batch = F.col("role") != "system"
    rows = batch.queue(queued, CHAT_RUN).join(queued.select("prompt_hash", "role"), "prompt_hash")
    return rows.select(
        *[c for c in rows.columns if c not in ("role", "state", "batch_id")],
        F.when(in_batch, "submitted").otherwise("queued").alias("state"),
        F.when(in_batch, F.concat(F.lit("b_"), "role")).alias("batch_id"),
        F.lit(NOW).cast("timestamp").alias("written_at"))


def _body(content: Column) -> Column:
    return F.concat(F.lit('{"model":"gpt-4o","usage":{"prompt_tokens":'), F.length("text").cast("string"),
                    F.lit(',"completion_tokens":'), F.col("turn").cast("string"), F.lit('},"choices":'),
                    F.to_json(F.array(F.struct(F.struct(content.alias("content")).alias("message")))), F.lit("}"))


def _line(body: Column) -> Column:
    return F.concat(F.lit('{"custom_id":"'), "prompt_hash", F.lit('","response":{"body":'), body, F.lit("}}"))


def _answer_lines(spark: SparkSession, sf: str) -> DataFrame:
    """User turns are answered, long before assistant turns, of which some fail."""
    return _turns(spark, sf).filter("role = 'user' OR role = 'assistant' AND turn < 4").select(
        F.concat(F.lit("b_"), "role").alias("batch_id"), _line(_body(F.col("text"))).alias("line"),
        F.struct("conv_id", "turn").alias("at"))


def _error_lines(spark: SparkSession, sf: str) -> DataFrame:
    failed = F.when(F.col("turn") == 5, F.lit('{"error":{"type":"rate_limit"}}')).otherwise(F.lit('{"error":null}'))
    return _turns(spark, sf).filter("role = 'assistant' AND turn >= 5").select(
        F.concat(F.lit("b_"), "role").alias("batch_id"), _line(failed).alias("line"),
        F.struct("conv_id", "turn").alias("at"))


@query(f"""
  SELECT prompt_hash AS custom_id, md5('{{"custom_id":"' || prompt_hash || '","method":"POST","url":"/v1/chat/completions",'
    || '"body":{{"model":"gpt-4o","messages":[{{"role":"user","content":[{{"type":"text","text":'
    || to_json(conv_id || '/' || turn || ': ' || text)
    || '}}]}}],"temperature":0.5,"n":1,"response_format":{{"type":"json_object"}}}}}}') AS line
  FROM ({TURN_SQL}) WHERE role = 'system'""")
def batch_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the requests that are still queued."""
    queued = batch.waiting(_submitted(spark, sf)).filter("state = 'queued'")
    return batch.batch_requests(queued).withColumn("line", F.md5("line"))


@query(f"SELECT prompt_hash, 'submitted' AS state, 'b_new' AS batch_id FROM ({TURN_SQL}) WHERE role = 'system'")
def batch_submit(spark: SparkSession, sf: str) -> DataFrame:
    return batch.submit(_submitted(spark, sf), "b_new").select("prompt_hash", "state", "batch_id")


BATCH_SQL = f"""
  WITH t AS ({TURN_SQL}), a AS (SELECT *, role = 'user' OR role = 'assistant' AND turn < 4 AS answered,
                                        role = 'assistant' AND turn >= 5 AS failed FROM t),
       f AS (SELECT role, min((conv_id, turn)) AS first FROM a WHERE answered GROUP BY role)
  SELECT prompt_hash, CASE WHEN answered OR failed THEN 'done' WHEN role = 'system' THEN 'queued'
                           ELSE 'submitted' END AS state,
         CASE WHEN failed AND turn = 5 THEN 'rate_limit' END AS error,
         CASE WHEN answered THEN (length(text) / 1000000.0::double * 2.5 + turn / 1000000.0::double * 10.0) * 0.5 END AS cost,
         CASE WHEN answered AND (conv_id, turn) = f.first THEN 60.0::double END AS elapsed_time
  FROM a LEFT JOIN f USING (role)
"""


@query(BATCH_SQL)
def batch_resolve(spark: SparkSession, sf: str) -> DataFrame:
    elapsed = spark.createDataFrame([("b_user", 60.0), ("b_assistant", 60.0)], "batch_id string, elapsed double")
    finished = batch.ingest_batch(
        _answer_lines(spark, sf), batch.prices_table(spark, PRICES), _error_lines(spark, sf), elapsed)
    return batch.resolve(_submitted(spark, sf), finished).select(
        "prompt_hash", "state", "error", F.col("usage.cost").alias("cost"), "elapsed_time")


TWO_RUNS = (CHAT_RUN, RunKey("other", CHAT_RUN.module, {"gpt_model": "other"}))


@query(f"""
  SELECT prompt_hash, run, md5(run || text) AS answer, 1::bigint AS n
  FROM ({TURN_SQL}), (SELECT unnest(['{TWO_RUNS[0].name}', '{TWO_RUNS[1].name}']) AS run) WHERE role = 'user'""")
def batch_two_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs queue the same prompts; each has a batch of its own and gets its own answers."""
    store = ResultStore(spark, shared_dir(spark, "store"))
    turns = _turns(spark, sf).filter("role = 'user'")
    for run in TWO_RUNS:
        asked = turns.withColumns({
            "run_hash": F.lit(run.run_hash), "module_name": F.lit("Chat"), "module_version": F.lit("2.0.0"),
            "args_json": F.lit("{}"), "masked": F.create_map(F.lit("turn"), F.col("turn").cast("string"))})
        store.append_pending(spread(batch.queue(asked, run)))
    lines = None
    for run in TWO_RUNS:
        batch.submit_queued(store, shared_dir(spark, "requests"), f"b_{run.name}", run.run_hash)
        answered = turns.select(
            F.lit(f"b_{run.name}").alias("batch_id"), _line(_body(F.concat(F.lit(run.name), "text"))).alias("line"),
            F.struct("conv_id", "turn").alias("at"))
        lines = answered if lines is None else lines.unionByName(answered)
    batch.settle(store, batch.ingest_batch(lines, batch.prices_table(spark, PRICES)))
    names = F.create_map(*[F.lit(x) for r in TWO_RUNS for x in (r.run_hash, r.name)])
    return store.results().groupBy("prompt_hash", names[F.col("run_hash")].alias("run")).agg(
        F.md5(F.max(F.get_json_object("response", "$.choices[0].message.content"))).alias("answer"),
        F.count(F.lit(1)).alias("n"))


@query(f"""SELECT prompt_hash, 'b_user' AS batch_id, md5(text) AS answer FROM ({TURN_SQL}) WHERE role = 'user'""")
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Answer files of one batch arrive as a stream and are settled in a store."""
    store = ResultStore(spark, shared_dir(spark, "store"))
    store.append_pending(spread(_submitted(spark, sf)))
    inbox = shared_dir(spark, "inbox")
    _answer_lines(spark, sf).filter("batch_id = 'b_user'").select("line").write.text(inbox)
    lines = jobs.answer_lines(spark, inbox, "b_user")
    job = jobs.ingest_answers(lines, store, batch.prices_table(spark, PRICES), shared_dir(spark, "progress"))
    job.awaitTermination()
    return store.latest().select("prompt_hash", "batch_id", F.md5(
        F.get_json_object("response", "$.choices[0].message.content")).alias("answer"))


@query(f"""
  WITH t AS ({TURN_SQL})
  SELECT prompt_hash, 'b_' || role AS batch_id, 1::bigint AS n,
         CASE WHEN role = 'assistant' AND turn = 5 THEN 'rate_limit' END AS error,
         CASE WHEN role = 'user' THEN (length(text) / 1000000.0::double * 2.5 + turn / 1000000.0::double * 10.0) * 0.5 END
           AS cost,
         CASE WHEN role = 'user' AND prompt_hash = min(prompt_hash) OVER (PARTITION BY role) THEN 60.0::double END
           AS elapsed_time
  FROM t WHERE role = 'user' OR role = 'assistant' AND turn >= 5""")
def stream_settle(spark: SparkSession, sf: str) -> DataFrame:
    """Answers and errors of two batches meet the stream of requests; then all answers come again."""
    store = ResultStore(spark, shared_dir(spark, "store"))
    store.append_pending(spread(_submitted(spark, sf)))
    inbox, failed, progress = (shared_dir(spark, n) for n in ("inbox", "failed", "progress"))
    answers = _answer_lines(spark, sf).filter("batch_id = 'b_user'").select("line")
    _error_lines(spark, sf).select("line").write.text(failed)
    elapsed = spark.createDataFrame([("b_user", 60.0), ("b_assistant", 60.0)], "batch_id string, elapsed double")
    for _ in range(2):
        answers.write.mode("append").text(inbox)
        lines = jobs.timed_lines(spark, inbox, "b_user").unionByName(
            jobs.timed_lines(spark, failed, "b_assistant", failed=True))
        jobs.settle_answers(lines, store, batch.prices_table(spark, PRICES), progress, elapsed).awaitTermination()
    return store.results().groupBy("prompt_hash", "batch_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("error").alias("error"), F.max("usage.cost").alias("cost"),
        F.max("elapsed_time").alias("elapsed_time"))


@query("""SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS answers,
                 sum(value::decimal(18, 2))::double AS cost FROM events GROUP BY 1""")
def stream_spend(spark: SparkSession, sf: str) -> DataFrame:
    """Money per six hours of a stream of results."""
    log = (spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events*.parquet")
           .select(F.col("ts").cast("timestamp").alias("written_at"), F.col("value").alias("cost")))
    out = shared_dir(spark, "spend")

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/{number:09d}")

    job = (jobs.spend_per_window(log, "6 hours", "60 days").writeStream.outputMode("complete").foreachBatch(keep)
           .option("checkpointLocation", shared_dir(spark, "progress")).trigger(availableNow=True).start())
    job.awaitTermination()
    last = job.lastProgress["batchId"]
    return spark.read.parquet(f"{out}/{last:09d}").select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "answers", "cost")


@query("""SELECT DISTINCT sha1(event_type || user_id) AS prompt_hash, CASE WHEN value < 20 THEN 'a' ELSE 'b' END AS run_hash
          FROM events""")
def stream_first_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct keys of a stream of work; the watermark spans the whole month."""
    asked = (spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events*.parquet")
             .select(F.sha1(F.concat("event_type", F.col("user_id").cast("string"))).alias("prompt_hash"),
                     F.when(F.col("value") < 20, "a").otherwise("b").alias("run_hash"),
                     F.col("ts").cast("timestamp").alias("requested_at")))
    out = shared_dir(spark, "first")
    job = (jobs.first_requests(asked, "60 days").writeStream.format("parquet").option("path", out)
           .option("checkpointLocation", shared_dir(spark, "progress")).trigger(availableNow=True).start())
    job.awaitTermination()
    return spark.read.parquet(out).select("prompt_hash", "run_hash")


# --- execution -----------------------------------------------------------------------

OFFER_SQL = """SELECT p_partkey AS combo_id, 'Offer a ' || p_name || ' of size ' || p_size AS prompt FROM part"""


def _offers(spark: SparkSession, sf: str) -> DataFrame:
    return expand(Project(spark, {"o": "Offer a {{p_name}} of size {{p_size}}"}, {
        "part": group(spark, sf, "part", "p_name", "p_size")}))


@query(f"""
  SELECT combo_id, sha1(prompt) AS prompt_hash,
         CASE WHEN row_number() OVER (PARTITION BY prompt ORDER BY combo_id) = 1 THEN 'executed' ELSE 'cached' END AS status,
         '{{"choices":[{{"message":{{"content":"{{\\n  \\"ok\\": true\\n}}"}}}}]}}' AS response
  FROM ({OFFER_SQL})""")
def stub_execute(spark: SparkSession, sf: str) -> DataFrame:
    store = ResultStore(spark, shared_dir(spark, "store"))
    run = RunKey("stub", STUB, {"stub_response": '{"ok": true}'})
    done = execute(_offers(spark, sf), run, store, stub='{"ok": true}')
    return done.select("combo_id", "prompt_hash", "status", "response")


class CountingProvider:
    """A model function in Python: the length of each prompt."""

    def open(self) -> None:
        self.calls = 0

    def call(self, batch_rows: pd.DataFrame) -> pd.DataFrame:
        self.calls += len(batch_rows)
        return pd.DataFrame({
            "response": ['{"chars":%d}' % len(p) for p in batch_rows["prompt"]],
            "cost_value": [0.001] * len(batch_rows)})

    def close(self) -> None:
        self.calls = 0


@query(f"""
  SELECT combo_id, CASE WHEN row_number() OVER (PARTITION BY prompt ORDER BY combo_id) = 1 THEN 'executed' ELSE 'cached' END
         AS status, '{{"chars":' || length(prompt) || '}}' AS response, 0.001::double AS cost FROM ({OFFER_SQL})""")
def provider_execute(spark: SparkSession, sf: str) -> DataFrame:
    store = ResultStore(spark, shared_dir(spark, "store"))
    done = execute(_offers(spark, sf), RUN_B, store, CountingProvider(), max_parallel=4)
    return done.select("combo_id", "status", "response", "usage.cost")


class TokenProvider(CountingProvider):
    """Answers that name a model and their tokens, and no cost."""

    def call(self, batch_rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"response": [
            '{"model":"gpt-4o-2024-08-06","usage":{"prompt_tokens":%d,"completion_tokens":7}}' % len(p)
            for p in batch_rows["prompt"]]})


@query(f"""
  SELECT combo_id, length(prompt) AS tokens_in, length(prompt) / 1000000.0::double * 2.5 AS cost_in,
         7 / 1000000.0::double * 10.0 AS cost_out,
         length(prompt) / 1000000.0::double * 2.5 + 7 / 1000000.0::double * 10.0 AS cost FROM ({OFFER_SQL})""")
def execute_cost(spark: SparkSession, sf: str) -> DataFrame:
    """Direct calls whose answers say only tokens are priced."""
    store = ResultStore(spark, shared_dir(spark, "store"))
    done = execute(_offers(spark, sf), RUN_B, store, TokenProvider(), prices=batch.prices_table(spark, PRICES))
    return done.select("combo_id", "usage.tokens_in", "usage.cost_in", "usage.cost_out", "usage.cost")


class LengthPriced(CountingProvider):
    """A model that asks one unit for every character of its prompt."""

    def call(self, batch_rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"response": ['{"chars":%d}' % len(p) for p in batch_rows["prompt"]],
                             "cost_value": [float(len(p)) for p in batch_rows["prompt"]]})


@query(f"""
  WITH o AS ({OFFER_SQL}),
       z AS (SELECT greatest(1, count(*) // 8) AS size FROM part),
       w AS (SELECT combo_id // size AS wave, sum(length(prompt)) AS cost FROM o, z GROUP BY 1),
       b AS (SELECT wave, coalesce(sum(cost) OVER (ORDER BY wave ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                    < (SELECT sum(cost) FROM w) * 0.4 AS runs FROM w),
       f AS (SELECT prompt, min(combo_id) AS first FROM o GROUP BY prompt),
       s AS (SELECT combo_id, prompt, first, r.runs FROM o JOIN f USING (prompt), z, b r WHERE r.wave = first // size)
  SELECT combo_id, CASE WHEN NOT runs THEN 'missing' WHEN combo_id = first THEN 'executed' ELSE 'cached' END AS status,
         CASE WHEN runs THEN length(prompt)::double END AS cost,
         (SELECT sum(length(prompt)) FROM s WHERE runs)::double AS ledger_total
  FROM s""")
def budget_live_stop(spark: SparkSession, sf: str) -> DataFrame:
    """A live run over all parts stops before the wave that follows the spending of two fifths of all money."""
    store, grid = ResultStore(spark, shared_dir(spark, "store")), _offers(spark, sf)
    total, n = grid.agg(F.sum(F.length("prompt")), F.count("*")).first()
    done = execute(grid, RUN_B, store, LengthPriced(), max_cost=total * 0.4, wave=max(1, n // 8))
    entered = store.ledger(RUN_B.run_hash).agg(F.sum("cost").cast("double").alias("ledger_total"))
    return done.select("combo_id", "status", "usage.cost").join(F.broadcast(entered))


@query(f"""
  SELECT sha1(prompt) AS prompt_hash, prompt, 'Chat' AS module_name, '2.0.0' AS module_version,
         '{{"gpt_model":"m-large"}}' AS module_args, p_name, p_size::varchar AS p_size, 14 AS stamp_length,
         strlen(prompt) AS bytes_in, 2::bigint AS bytes_out
  FROM (SELECT arg_min(p_name, p_partkey) AS p_name, arg_min(p_size, p_partkey) AS p_size, prompt
        FROM (SELECT *, 'Offer a ' || p_name || ' of size ' || p_size AS prompt FROM part) GROUP BY prompt)""")
def stored_records(spark: SparkSession, sf: str) -> DataFrame:
    """What a run leaves in the store: no secret arguments, masked variables, usage."""
    store = ResultStore(spark, shared_dir(spark, "store"))
    execute(_offers(spark, sf), RUN_B, store, stub="1")
    return store.latest().select(
        "prompt_hash", "prompt", "module_name", "module_version", F.col("module_args_json").alias("module_args"),
        F.col("params").getItem("p_name").alias("p_name"), F.col("params").getItem("p_size").alias("p_size"),
        F.length("timestamp").alias("stamp_length"), "usage.bytes_in",
        (F.col("usage.bytes_out") - F.octet_length(F.lit('{"choices":[{"message":{"content":""}}]}')) + 1).alias("bytes_out"))


@query(f"SELECT combo_id, run_name, response FROM ({WORK_SQL}) JOIN ({LATEST_SQL}) USING (prompt_hash, run_hash)")
def answered_work(spark: SparkSession, sf: str) -> DataFrame:
    """Combinations without a record are left out."""
    return answered(_work(spark, sf), lookup.latest(_results(spark, sf).select(
        *lookup.KEYS, "response", "written_at"))).select("combo_id", "run_name", "response")


@query(f"""SELECT DISTINCT sha1(prompt) AS prompt_hash, '{{"choices":[{{"message":{{"content":"\\"plain text\\""}}}}]}}' AS response
           FROM ({OFFER_SQL})""")
def stub_columns(spark: SparkSession, sf: str) -> DataFrame:
    """The stub as columns over distinct prompts."""
    distinct = _offers(spark, sf).select("prompt_hash", "prompt").dropDuplicates(["prompt_hash"])
    return stub_answers(distinct, "plain text").select("prompt_hash", "response")
