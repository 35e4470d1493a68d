"""Tokens, bytes, prices and money of stored answers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

USAGE_TYPE = (
    "struct<tokens_in:bigint,tokens_out:bigint,bytes_in:bigint,bytes_out:bigint,"
    "cost_in:double,cost_out:double,discount:double,cost:double>"
)
# money is summed as a decimal so that a total does not depend on the partitioning
MONEY = "decimal(38,12)"
# Fixed value: the date that may end a model name.
DATE_SUFFIX = r"-\d{4}-\d{2}-\d{2}$"
# rows per block of a running total: a window task sorts this many
BLOCK_ROWS = 1 << 20


def token_usage(response: Column) -> Column:
    """struct(tokens_in, tokens_out) of a response text; 0 when it does not say."""
    usage = F.from_json(
        response,
        "usage struct<prompt_tokens:bigint,completion_tokens:bigint,"
        "input_tokens:bigint,output_tokens:bigint>")["usage"]
    chat = usage["prompt_tokens"].isNotNull() & usage["completion_tokens"].isNotNull()
    other = usage["input_tokens"].isNotNull() & usage["output_tokens"].isNotNull()

    def pick(a: str, b: str) -> Column:
        return F.when(chat, usage[a]).when(other, usage[b]).otherwise(F.lit(0).cast("long"))

    return F.struct(pick("prompt_tokens", "input_tokens").alias("tokens_in"),
                    pick("completion_tokens", "output_tokens").alias("tokens_out"))


def model_name(response: Column) -> Column:
    return F.coalesce(F.get_json_object(response, "$.model"), F.lit(""))


def price_join(results: DataFrame, prices: DataFrame, provider: str = "module_name") -> DataFrame:
    """``results`` (with ``model``) plus ``price_in``, ``price_out``; NULL if unknown: the price of the
    name itself, else of the name without a date at the end, else of the first ``prefix*`` pattern.

    Prices may have a ``provider``: they are for results whose column ``provider`` names it, and go
    before all prices without one.

    The price list, an argument of a run, is one value of the plan (a scalar subquery): its exact
    names as a map and its prefixes as an array in order. Results are read once and not joined.
    """
    def listed_for(scope: Column) -> Column:
        """The names and prefixes of the entries of one provider."""
        chosen = F.filter("_list", lambda p: p["provider"] == scope)
        # of equal names the first in order counts, which a map built backwards keeps
        named = F.map_from_entries(F.transform(F.reverse(chosen), lambda p: F.struct(p["pattern"], p["price"])))
        starts = F.transform(F.filter(chosen, lambda p: p["pattern"].endswith("*")), lambda p: F.struct(
            F.substring(p["pattern"], F.lit(1), F.length(p["pattern"]) - 1).alias("prefix"), p["price"].alias("price")))
        return F.struct(named.alias("named"), starts.alias("starts"))

    amounts = F.struct(F.col("input").cast("double").alias("input"), F.col("output").cast("double").alias("output"))
    scoped = "provider" in prices.columns
    scope = F.coalesce("provider", F.lit("")) if scoped else F.lit("")
    entry = F.struct("ord", "pattern", scope.alias("provider"), amounts.alias("price"))
    whole = prices.agg(F.sort_array(F.collect_list(entry)).alias("_list"))
    scopes = F.array_distinct(F.transform("_list", lambda p: p["provider"])) if scoped else F.array(F.lit(""))
    listed = whole.select(F.map_from_entries(F.transform(
        scopes, lambda name: F.struct(name, listed_for(name)))).alias("all")).scalar()
    name = F.col("model")
    undated = F.regexp_replace(name, DATE_SUFFIX, "")

    def found(known: Column) -> Column:
        by_prefix = F.get(F.filter(known["starts"], lambda p: name.startswith(p["prefix"])), F.lit(0))["price"]
        return F.coalesce(F.try_element_at(known["named"], name), F.try_element_at(known["named"], undated), by_prefix)

    price = found(F.try_element_at("_prices", F.lit("")))
    if scoped and provider in results.columns:
        own = F.when(F.col(provider) != "", F.col(provider))
        price = F.coalesce(found(F.try_element_at("_prices", own)), price)
    priced = results.withColumn("_prices", listed).withColumn("_price", price)
    return priced.withColumns({
        "price_in": F.col("_price.input"), "price_out": F.col("_price.output")}).drop("_price", "_prices")


def cost(tokens: Column, price: Column) -> Column:
    """Money for tokens at a price per million; an unknown price costs nothing."""
    return F.coalesce(tokens / F.lit(1000000) * price, F.lit(0.0))


def normalized_cost(value: Column, tokens: Column, cost_in: Column | None = None,
                    cost_out: Column | None = None) -> Column:
    """One shape for a cost that is absent, one number, or given per direction."""
    return F.struct(
        tokens["tokens_in"].alias("tokens_in"), tokens["tokens_out"].alias("tokens_out"),
        F.coalesce(*[c for c in (cost_in, value) if c is not None], F.lit(0.0)).cast("double").alias("cost_in"),
        F.coalesce(*[c for c in (cost_out,) if c is not None], F.lit(0.0)).cast("double").alias("cost_out"))


def discounted(cost_in: Column, cost_out: Column, discount: Column) -> Column:
    return (cost_in + cost_out) * (F.lit(1.0) - discount)


def byte_usage(prompt: Column, response: Column) -> Column:
    """struct(bytes_in, bytes_out): UTF-8 lengths of prompt and response text."""
    return F.struct(F.octet_length(prompt).cast("long").alias("bytes_in"),
                    F.octet_length(response).cast("long").alias("bytes_out"))


def with_usage(results: DataFrame, prices: DataFrame, discount: float = 0.0) -> DataFrame:
    """Add the ``usage`` struct to rows with ``prompt`` and ``response``."""
    counted = results.withColumn("_tokens", token_usage(F.col("response"))).withColumn(
        "model", model_name(F.col("response")))
    priced = price_join(counted, prices)
    cost_in = cost(F.col("_tokens.tokens_in"), F.col("price_in"))
    cost_out = cost(F.col("_tokens.tokens_out"), F.col("price_out"))
    size = byte_usage(F.col("prompt"), F.col("response"))
    usage = F.struct(
        F.col("_tokens.tokens_in").alias("tokens_in"), F.col("_tokens.tokens_out").alias("tokens_out"),
        size["bytes_in"].alias("bytes_in"), size["bytes_out"].alias("bytes_out"),
        cost_in.alias("cost_in"), cost_out.alias("cost_out"), F.lit(discount).alias("discount"),
        discounted(cost_in, cost_out, F.lit(discount)).alias("cost"))
    return priced.withColumn("usage", usage).drop("_tokens", "model", "price_in", "price_out")


def _money(col: Column) -> Column:
    return F.coalesce(F.sum(col.cast(MONEY)), F.lit(0)).cast("double")


def _count(col: Column) -> Column:
    return F.coalesce(F.sum(col), F.lit(0)).cast("long")


def stats(work: DataFrame, max_cost: float = 0.0, currency: str | Mapping[str, str] = "USD") -> DataFrame:
    """Execution statistics per run; ``currency`` is that of all runs, or of each run by its name.

    ``work``: one row per combination and run with ``run_name``, ``status`` (executed,
    cached or pending), and for answered rows ``prompt``, ``response``, ``usage``,
    ``timestamp``.
    """
    answered = F.col("status").isin("executed", "cached")

    def known(c: Column) -> Column:
        return F.when(answered, c)

    paid_in = F.lit(currency) if isinstance(currency, str) else F.lit("USD")
    if not isinstance(currency, str) and currency:
        named = F.create_map(*[F.lit(x) for kv in currency.items() for x in kv])
        paid_in = F.coalesce(F.try_element_at(named, F.col("run_name")), paid_in)
    place = [F.min("run_ord").alias("run_ord")] if "run_ord" in work.columns else []
    return work.groupBy("run_name").agg(
        *place,
        F.count_if(F.col("status") == "executed").alias("executed"),
        F.count_if(F.col("status") == "cached").alias("cached"),
        F.count_if(F.col("status") == "pending").alias("pending"),
        _count(known(F.col("usage.tokens_in"))).alias("tokens_in"),
        _count(known(F.col("usage.tokens_out"))).alias("tokens_out"),
        _count(known(F.coalesce(F.col("usage.bytes_in"), F.octet_length("prompt")))).alias("bytes_in"),
        _count(known(F.coalesce(F.col("usage.bytes_out"), F.octet_length("response")))).alias("bytes_out"),
        _money(known(F.col("usage.cost"))).alias("cost"),
        F.lit(float(max_cost)).alias("max_cost"),
        paid_in.alias("cost_currency"),
        F.max(known(F.col("timestamp"))).alias("max_timestamp"))


def total_stats(per_run: DataFrame) -> DataFrame:
    """Statistics over all runs: sums, the largest budget, the first run's currency."""
    sums = ["executed", "cached", "pending", "tokens_in", "tokens_out", "bytes_in", "bytes_out"]
    return per_run.agg(
        *[_count(F.col(c)).alias(c) for c in sums],
        _money(F.col("cost")).alias("cost"),
        F.max("max_cost").alias("max_cost"),
        F.min_by("cost_currency", "run_ord" if "run_ord" in per_run.columns else "run_name").alias("cost_currency"),
        F.max("max_timestamp").alias("max_timestamp"))


def analyse_cost(results: DataFrame) -> DataFrame:
    """Cost row of each answer: from its usage, else from the response, else 0."""
    def pick(field: str, json_name: str, dtype: str) -> Column:
        return F.coalesce(
            F.col(f"usage.{field}").cast(dtype),
            F.get_json_object("response", f"$['{json_name}']").cast(dtype),
            F.lit(0).cast(dtype)).alias(field)

    kept = [c for c in results.columns if c not in ("usage", "response")]
    return results.select(
        *kept,
        pick("tokens_in", "tokens in", "bigint"), pick("tokens_out", "tokens out", "bigint"),
        pick("bytes_in", "bytes in", "bigint"), pick("bytes_out", "bytes out", "bigint"),
        pick("cost_in", "cost in", "double"), pick("cost_out", "cost out", "double"))


def reduce_cost(rows: DataFrame, *by: str) -> DataFrame:
    """Totals of cost rows; ``Cost`` is both directions together."""
    money_in, money_out = (F.sum(F.col(c).cast(MONEY)) for c in ("cost_in", "cost_out"))
    return rows.groupBy(*by).agg(
        _count(F.col("tokens_in")).alias("Tokens Input"),
        _count(F.col("tokens_out")).alias("Tokens Output"),
        _count(F.col("bytes_in")).alias("Bytes Input"),
        _count(F.col("bytes_out")).alias("Bytes Output"),
        money_in.cast("double").alias("Cost Input"),
        money_out.cast("double").alias("Cost Output"),
        (money_in + money_out).cast("double").alias("Cost"))


def run_info(answered: DataFrame, *by: str) -> DataFrame:
    """Elapsed time and cost over combinations; a shared answer counts for each.

    A record without usage may carry an older top-level ``cost``.
    """
    old = F.col("cost") if "cost" in answered.columns else F.lit(None).cast("double")
    money = F.coalesce(F.col("usage.cost"), old, F.lit(0.0))
    return answered.groupBy(*by).agg(
        _money(F.coalesce(F.col("elapsed_time"), F.lit(0.0))).alias("elapsed_time"),
        _money(money).alias("total_cost"))


def spent_before(rows: DataFrame, order: str = "combo_id", money: str = "cost",
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Money spent by all rows before each row, in ``order`` (dense from 0).

    Two levels: one sum per block of rows, a running total over those few sums, then a
    running total inside each block. No window ever spans the whole table.
    """
    amount = F.coalesce(F.col(money), F.lit(0.0)).cast(MONEY)
    blocks = rows.withColumn("_block", F.expr(f"`{order}` div {block_rows}L")).withColumn("_amount", amount)
    sums = blocks.groupBy("_block").agg(F.sum("_amount").alias("_sum"))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocks.withColumn("_inside", F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
        .join(starts, "_block")
        .withColumn("spent_before", (F.col("_start") + F.col("_inside")).cast(MONEY))
        .drop("_block", "_amount", "_start", "_inside"))


def within_budget(rows: DataFrame, max_cost: float, order: str = "combo_id", money: str = "cost",
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows that may run: those before which less than ``max_cost`` was spent; 0 = all."""
    if not max_cost:
        return rows
    spent = spent_before(rows, order, money, block_rows)
    return spent.filter(F.col("spent_before") < F.lit(max_cost).cast(MONEY)).drop("spent_before")
