"""From stored responses to typed rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import Column, DataFrame, functions as F, types as T

from promptframe.functions.answers import (
    extract_json, is_wrapped_list, list_elements, read_response)
from promptframe.functions.text import let
from promptframe.operators import usage as money
from promptframe.operators.lookup import KEYS
from promptframe.session import shared_dir



def answered(work: DataFrame, results: DataFrame) -> DataFrame:
    """Work with its stored record; combinations without one are left out."""
    fields = [c for c in results.columns if c not in work.columns or c in KEYS]
    return work.join(results.select(*fields), KEYS, "inner")


def parsed_items(records: DataFrame) -> DataFrame:
    """``items``: array of struct(pos, data, extra, error, raw) of each record's response,
    and ``several``: whether it has more than one.

    ``data`` is JSON object text; an unreadable item has ``error`` and ``raw`` instead.
    All items of a response stay in one row, so nothing is shuffled to judge them together.
    """
    def judged(i: Column, data: Column) -> Column:
        unread = F.when(i["content"].isNull(), "Content is None").otherwise("Error parsing JSON")
        return F.struct(
            i["pos"].alias("pos"), data.alias("data"), i["extra"].alias("extra"),
            F.coalesce(i["error"], F.when(data.isNull(), unread)).alias("error"),
            F.when(data.isNull(), i["content"]).alias("raw"))

    read = records.withColumn("_response", read_response(F.col("response")))
    items = F.transform("_response.items", lambda i: let(
        F.when(i["error"].isNull(), extract_json(i["content"])), lambda data: judged(i, data)))
    return read.withColumns({"items": items, "several": F.col("_response.count") > 1}).drop("_response")


def answer_items(records: DataFrame) -> DataFrame:
    """One row per item of each response: ``pos``, ``data``, ``extra``, ``choice`` (its
    number, when there are several), ``error``, ``raw``, next to the record's columns."""
    kept = _carried(records)
    return _item_rows(parsed_items(records), *kept, "several").select(
        *kept, "pos", "data", "extra", _choice(), "error", "raw")


def _carried(records: DataFrame) -> list[str]:
    """Columns of a record that its rows keep; the item's own names are taken."""
    own = {"response", "pos", "list_pos", "data", "extra", "choice", "error", "raw"}
    return [c for c in records.columns if c not in own]


def _item_rows(parsed: DataFrame, *kept: str) -> DataFrame:
    """One row per item. The outer form, since for the inner one Spark computes the array
    a second time to drop rows without any."""
    return parsed.select(*kept, F.inline_outer("items")).filter(F.col("pos").isNotNull())


def _choice() -> Column:
    return F.when(F.col("several") & F.col("error").isNull(), F.col("pos")).alias("choice")


def flatten_answers(records: DataFrame) -> DataFrame:
    """:func:`answer_items`, with wrapped lists taken apart: ``list_pos`` is the place in
    the list. Only when every item of the response is such a wrapper."""
    kept = _carried(records)
    parsed = parsed_items(records).withColumn(
        "flat", F.forall("items", lambda i: is_wrapped_list(i["data"])))
    rows = _item_rows(parsed, *kept, "several", "flat")
    data = F.when(F.col("flat"), list_elements(F.col("data"))).otherwise(F.array("data"))
    return rows.select(
        *kept, "pos", F.posexplode_outer(data).alias("list_pos", "data"), "extra", _choice(), "error", "raw")


def row_keys(rows: DataFrame, masked: str | None = "masked", timestamp: str | None = "timestamp") -> Column:
    """Column names of an answer row: answer keys first, then ``input_<variable>`` of the
    masked arguments, then the item's extras, its number and the time stamp."""
    none = F.array().cast("array<string>")
    parts = [F.coalesce(F.json_object_keys("data"), none),
             F.when(F.col("error").isNotNull(), F.array(F.lit("_error"))).otherwise(none),
             F.when(F.col("raw").isNotNull(), F.array(F.lit("_raw"))).otherwise(none)]
    if masked and masked in rows.columns:
        parts.append(F.coalesce(F.transform(
            F.map_keys(masked), lambda k: F.concat(F.lit("input_"), k)), none))
    parts.append(F.coalesce(F.json_object_keys("extra"), none))
    parts.append(F.when(F.col("choice").isNotNull(), F.array(F.lit("_choice"))).otherwise(none))
    if timestamp and timestamp in rows.columns:
        parts.append(F.when(F.col(timestamp).isNotNull(), F.array(F.lit("_timestamp"))).otherwise(none))
    return F.concat(*parts)


#: Columns that a report without a list of its own may have; further keys stay in one variant column.
MOST_COLUMNS = 10_000


def first_places(rows: DataFrame, masked: str | None = "masked", timestamp: str | None = "timestamp") -> DataFrame:
    """``key, first, key_pos``: where each key appears first (combination, item, place; then place in the row).

    Rows of the same keys are collapsed before their keys are taken apart. The place is one
    decimal number with room for all values of its parts, so that this needs no sorting.
    """
    place = F.lit(0).cast("decimal(38,0)")
    for name, width in (("combo_id", 19), ("pos", 10), ("list_pos", 9)):
        part = F.coalesce(F.col(name).cast("long"), F.lit(0)) if name in rows.columns else F.lit(0)
        step = F.lit(10**width if name != "combo_id" else 1).cast("decimal(11,0)")
        place = (place * step + part.cast("decimal(19,0)")).cast("decimal(38,0)")
    alike = rows.select(place.alias("at"), row_keys(rows, masked, timestamp).alias("keys")).groupBy("keys").agg(
        F.min("at").alias("at"))
    seen = alike.select("at", F.posexplode("keys").alias("key_pos", "key"))
    return seen.groupBy("key").agg(F.min(F.struct("at", "key_pos")).alias("p")).select(
        "key", F.col("p.at").alias("first"), F.col("p.key_pos").alias("key_pos"))


def column_names(rows: DataFrame, masked: str | None = "masked", timestamp: str | None = "timestamp",
                 most: int = MOST_COLUMNS) -> list[str]:
    """The first ``most`` keys of all rows, ordered by where they first appear."""
    first = first_places(rows, masked, timestamp)
    return [r[0] for r in first.orderBy("first", "key_pos", "key").limit(most).select("key").collect()]


def answer_schema(rows: DataFrame, *by: str, data: str = "data") -> DataFrame:
    """``schema`` of all answers (of a group), as an aggregate: a variant's type with every key that
    occurs and the least type that holds its values. NULL where no answer is JSON."""
    # the aggregate says VOID of no values at all
    found = F.schema_of_variant_agg(F.try_parse_json(data))
    return rows.groupBy(*by).agg(F.when(F.count(F.try_parse_json(data)) > 0, found).alias("schema"))


def typed_columns(rows: DataFrame, columns: Mapping[str, str], keep: Sequence[str] = (),
                  data: str = "data") -> DataFrame:
    """Answers as typed columns of the wished keys, and ``rest``: all other keys as one variant.

    The data are read once and nothing is gathered. A value that its type cannot hold is NULL in
    its column and stays in ``rest``; so does an answer that is no object. A key may hold any character.
    """
    whole = rows.withColumn("_answer", F.try_parse_json(data)).withColumn(
        "_keys", F.try_variant_get("_answer", "$", "map<string,variant>"))
    wished = F.array(*[F.lit(c) for c in columns]).cast("array<string>")
    read = whole.withColumns({f"_value_{i}": F.try_variant_get(F.try_element_at("_keys", F.lit(name)), "$", kind)
                              for i, (name, kind) in enumerate(columns.items())})
    # a null in the answer is held by NULL; anything else that gives NULL did not fit
    lost = [F.when(F.col(f"_value_{i}").isNull() & ~F.coalesce(
        F.is_variant_null(F.try_element_at("_keys", F.lit(name))), F.lit(True)), F.lit(name))
        for i, name in enumerate(columns)]
    held = F.array_except(wished, F.array_compact(F.array(*lost)).cast("array<string>"))
    rest = F.map_filter("_keys", lambda k, v: ~F.array_contains(held, k))
    return read.select(
        *keep, *[F.col(f"_value_{i}").alias(name) for i, name in enumerate(columns)],
        F.when(F.col("_keys").isNull(), F.col("_answer")).when(
            F.size(rest) > 0, F.to_variant_object(rest)).alias("rest"))


def to_columns(rows: DataFrame, columns: Sequence[str] | None = None, keep: Sequence[str] = (),
               masked: str | None = "masked", timestamp: str | None = "timestamp",
               most: int = MOST_COLUMNS) -> DataFrame:
    """Answer rows as a table with one text column per key; an absent key is NULL.

    ``columns`` (for instance the fields a template asks for) saves the pass over the
    data that finds them. Without it, keys beyond the first ``most`` stay together in a
    variant column ``_rest``, so that none is lost and the driver holds ``most`` names at the most.
    The rows are then written once, since taking answers apart costs more than reading their rows again.
    """
    if columns is None:
        rows = _written(rows, [*keep, "combo_id", "pos", "list_pos", "data", "extra", "choice", "error", "raw",
                               *[c for c in (masked, timestamp) if c]])
    names = list(columns) if columns is not None else column_names(rows, masked, timestamp, most + 1)
    more = columns is None and len(names) > most
    names = names[:most] if more else names
    read = rows.withColumns({
        "_data": F.from_json("data", "map<string,string>"), "_more": F.from_json("extra", "map<string,string>")})

    def value(name: str) -> Column:
        # what is set later goes first: time stamp, number, extras, inputs, the answer
        found = []
        if name == "_timestamp" and timestamp and timestamp in rows.columns:
            found.append(F.col(timestamp))
        if name == "_choice":
            found.append(F.col("choice").cast("string"))
        found.append(F.col("_more").getItem(name))
        if name.startswith("input_") and masked and masked in rows.columns:
            found.append(F.col(masked).getItem(name[len("input_"):]))
        if name in ("_error", "_raw"):
            found.append(F.col(name[1:]))
        found.append(F.col("_data").getItem(name))
        return F.coalesce(*found)

    shown = [value(n).alias(n) for n in names if n not in keep]
    if more:
        shown.append(_rest(rows, names, masked, timestamp))
    return read.select(*keep, *shown)


def _written(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Some columns of rows that are costly to make, from a work table."""
    path = shared_dir(rows.sparkSession, "rows")
    chosen = rows.select(*[F.col(f"`{c}`") for c in dict.fromkeys(names) if c in rows.columns])
    chosen = chosen.withColumns({c: F.col(f"`{c}`").cast("string") for c, kind in chosen.dtypes if kind == "void"})
    chosen.write.parquet(path)
    return rows.sparkSession.read.schema(chosen.schema).parquet(path)


def _rest(rows: DataFrame, names: Sequence[str], masked: str | None, timestamp: str | None) -> Column:
    """Variant of all values of a row whose key is not in ``names``."""
    own = [("_error", "error"), ("_raw", "raw"), ("_choice", "choice")]
    if timestamp and timestamp in rows.columns:
        own.append(("_timestamp", timestamp))
    parts = [F.col("_data")]
    parts += [F.create_map(F.lit(k), F.col(c).cast("string")) for k, c in own[:2]]
    if masked and masked in rows.columns:
        parts.append(F.transform_keys(masked, lambda k, v: F.concat(F.lit("input_"), k)).cast("map<string,string>"))
    parts.append(F.col("_more"))
    parts += [F.create_map(F.lit(k), F.col(c).cast("string")) for k, c in own[2:]]
    known = F.array(*[F.lit(n) for n in names]).cast("array<string>")
    left = [F.map_filter(F.coalesce(p, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))),
                         lambda k, v: v.isNotNull() & ~F.array_contains(known, k)) for p in parts]
    every = F.map_concat(*left)
    return F.when(F.size(every) > 0, F.to_variant_object(every)).alias("_rest")


# --- analyses -------------------------------------------------------------------


@dataclass(frozen=True)
class Analysis:
    """A named reading of answered work; ``reduce`` sums its rows up."""

    name: str
    analyse: Callable[[DataFrame], DataFrame]
    reduce: Callable[[DataFrame], DataFrame] | None = None


def _gpt_json(records: DataFrame) -> DataFrame:
    return to_columns(flatten_answers(records))


ANALYSES: dict[str, Analysis] = {
    "gpt_json": Analysis("gpt_json", _gpt_json),
    "cost": Analysis("cost", money.analyse_cost, money.reduce_cost),
}


def register_analysis(name: str, analyse: Callable[..., Any], reduce: Callable[..., Any] | None = None,
                      schema: str | None = None, reduce_schema: str | None = None,
                      reduce_keys: Sequence[str] = ()) -> Analysis:
    """Add an analysis.

    Without a schema the functions take and return DataFrames. With one,
    ``analyse(response, timestamp, usage)`` is user code that returns a dict, a list of
    dicts or None per record. ``reduce(rows)`` gets rows of one task as dicts, and then
    results of several tasks, so it must accept rows of its own making; with
    ``reduce_keys`` it gets rows of one key at a time.
    """
    if schema is None:
        made = Analysis(name, analyse, reduce)
    else:
        made = Analysis(
            name, lambda records: with_inputs(python_analysis(records, analyse, schema)),
            None if reduce is None else
            lambda rows: python_reduce(rows, reduce, reduce_schema or schema, reduce_keys))
    ANALYSES[name] = made
    return made


def python_analysis(records: DataFrame, analyse: Callable[..., Any], schema: str) -> DataFrame:
    """User rows of each record, with its number, run, masked arguments and time stamp (``_timestamp``).

    Only the answer reaches Python as objects; what is carried along stays in Arrow.
    """
    out = T.StructType.fromDDL(schema)
    carried = [c for c in ("combo_id", "run_name", "masked") if c in records.columns]
    full = T.StructType([*[records.schema[c] for c in carried], T.StructField("_timestamp", T.StringType()), *out.fields])
    made_schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            rows: list[dict] = []
            read = [batch.column(c).to_pylist() for c in ("response", "timestamp", "usage")]
            for k, (response, stamp, usage) in enumerate(zip(*read, strict=True)):
                made = analyse(json.loads(response) if response else None, timestamp=stamp, usage=usage)
                if made is None:
                    continue
                made = made if isinstance(made, list) else [made]
                at += [k] * len(made)
                rows += made
            places = pa.array(at, pa.int64())
            kept = [batch.column(c).take(places) for c in (*carried, "timestamp")]
            made = pa.RecordBatch.from_pylist(rows, schema=made_schema)
            yield pa.RecordBatch.from_arrays([*kept, *made.columns], names=full.names)

    stamp = F.col("timestamp").cast("string").alias("timestamp")
    return records.select(*carried, "response", stamp, "usage").mapInArrow(run, full)


def with_inputs(rows: DataFrame, masked: str = "masked") -> DataFrame:
    """Masked arguments as columns ``input_<name>``; their names are the variables of the prompts."""
    if masked not in rows.columns:
        return rows
    names = sorted(r[0] for r in rows.select(F.explode(F.map_keys(masked))).distinct().collect())
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != masked],
                       *[F.col(masked).getItem(n).alias(f"input_{n}") for n in names])


#: Results of tasks that one task of the next round takes.
REDUCE_WIDTH = 16
#: Rows of one key that are handed to the user's roll-up at once.
REDUCE_ROWS = 4096


def _same_key(a: tuple, b: tuple) -> bool:
    """Whether two keys are one group; a NaN equals itself, as in Spark."""
    return all(x == y or (x != x and y != y) for x, y in zip(a, b, strict=True))


def python_reduce(rows: DataFrame, reduce: Callable[[list[dict]], Any], schema: str,
                  keys: Sequence[str] = ()) -> DataFrame:
    """User roll-up: over the rows of each task, then in rounds over the results of a few tasks.

    With ``keys``, which the results must have too, results meet by key instead of in one last task:
    each task sorts its rows by key and rolls a key up as its rows stream by, so it holds one key at
    a time and at most ``REDUCE_ROWS`` of its rows, however many keys or rows of a key there are.
    A key that has most rows has one result a task after the first round, so it needs no salt.
    """
    out = T.StructType.fromDDL(schema)
    out_arrow = to_arrow_schema(out)

    def rolled(group: list[dict]) -> list[dict]:
        made = reduce(group)
        return made if isinstance(made, list) else [made]

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        at: tuple | None = None
        done: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist(maps_as_pydicts="strict"):
                key = tuple(row[k] for k in keys)
                if at is not None and not _same_key(at, key):
                    done += rolled(held)
                    held = []
                at = key
                held.append(row)
                if len(held) >= REDUCE_ROWS:
                    held = rolled(held)
                if len(done) >= REDUCE_ROWS:
                    yield pa.RecordBatch.from_pylist(done, schema=out_arrow)
                    done = []
        done += rolled(held) if held else []
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=out_arrow)

    if keys:
        made = rows.sortWithinPartitions(*keys).mapInArrow(roll, out)
        return made.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(roll, out)
    made = rows.mapInArrow(roll, out)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while tasks > 1:
        tasks = -(-tasks // REDUCE_WIDTH)
        made = made.repartition(tasks).mapInArrow(roll, out)
    return made


def analyse(records: DataFrame, name: str) -> DataFrame:
    """Rows of a registered analysis, reduced if it says so."""
    chosen = ANALYSES[name]
    rows = chosen.analyse(records)
    return chosen.reduce(rows) if chosen.reduce else rows
