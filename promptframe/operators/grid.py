"""The grid: every enabled prompt with every row of every group, rendered and keyed.

A combination is the mixed-radix number of its row ordinals, so its place in the
product is arithmetic. Where all groups are small, numbers are dealt to tasks and
every group is looked up by ordinal in a broadcast. A larger group is streamed: its
rows are repeated by an index, and small groups are looked up. Two large groups meet
by tiles: each row is copied to the tiles of the other side, and combinations are
made inside a tile, so that rows times tiles are shuffled and combinations never are.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from promptframe.functions import keys
from promptframe.functions.templates import (
    MISSING_MARKER, Piece, literal_render, placeholder_names, spans, split_template, variable_name,
    function_params, placeholder_values, fill, literals)
from promptframe.functions.text import value_text
from promptframe.operators.runs import RunKey, with_runs
from promptframe.sources.ordinals import ORD
from promptframe.sources.project import Project

# an index array in the plan holds at most this many numbers
INDEX_BLOCK = 4096
COMBOS_PER_TASK = 100_000
BYTES_PER_TASK = 8 << 20
# rows of a group in one tile: a tile makes the product of two such numbers
TILE_ROWS = 1024
# tasks that tiles, or rows of one large group, are dealt to
MOST_TASKS = 4096
# a group is broadcast only when it was measured to stay below both bounds
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


class PromptFunction(Protocol):
    """``{{name(a, b)}}``: text computed from variables of the combination."""

    def variables(self, params: Sequence[str]) -> list[str]:
        """Variables the call reads."""

    def apply(self, calls: DataFrame, texts: Mapping[str, DataFrame], params: Sequence[str]) -> DataFrame:
        """``calls`` has one column per variable, the MD5 key of its text, in distinct rows;
        ``texts`` gives ``key`` and ``text`` of each variable, distinct. Returns the rows of
        ``calls`` with ``value``."""


@dataclass(frozen=True)
class _Variable:
    group: int
    column: str
    is_text: bool
    id_column: str | None


@dataclass(frozen=True)
class Size:
    """Measured size of a group: rows and, for a group of few rows, bytes of text."""

    rows: int
    bytes: int | None = None

    @property
    def broadcastable(self) -> bool:
        return self.bytes is not None and self.bytes <= BROADCAST_BYTES


def group_size(group: DataFrame) -> Size:
    """Rows of a group, whose ordinals must be 0..n-1, and its bytes if it is small."""
    return group_sizes({"group": group})["group"]


def group_sizes(groups: Mapping[str, DataFrame]) -> dict[str, Size]:
    """Sizes of all groups; pass them on to save the jobs when a grid is built again.

    One job counts the rows of all groups, another the bytes of those of few rows.
    """
    def of_all(chosen: Mapping[str, DataFrame], *measures: Column) -> dict[str, Any]:
        rows = [df.agg(*measures).withColumn("_name", F.lit(name)) for name, df in chosen.items()]
        return {r["_name"]: r for r in reduce(DataFrame.unionByName, rows).collect()} if rows else {}

    counted = of_all(groups, F.count(F.lit(1)).alias("n"), F.min(ORD).alias("low"), F.max(ORD).alias("high"))
    for r in counted.values():
        if r["n"] and (r["low"] != 0 or r["high"] != r["n"] - 1):
            raise ValueError("ordinals have gaps: use close_ordinals or with_ordinals")
    few = {name: df for name, df in groups.items() if counted[name]["n"] <= BROADCAST_ROWS}
    sized = of_all(few, F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("b"))
    return {name: Size(counted[name]["n"], (sized[name]["b"] or 0) if name in few else None) for name in groups}


def num_combinations(project: Project) -> int:
    """Size of the grid, without expanding it."""
    total = len(project.enabled_prompts)
    for df in project.groups.values():
        total *= df.count()
    return total


def _repeat(df: DataFrame, times: int) -> DataFrame:
    """Each row ``times`` times, numbered by ``_i``; rows stream through, nothing is kept."""
    def upto(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    if times == 0:
        return df.filter(F.lit(False)).withColumn("_i", F.lit(0).cast("long"))
    if times <= INDEX_BLOCK:
        return df.select("*", upto(times).alias("_i"))
    blocks = df.select("*", upto(-(-times // INDEX_BLOCK)).alias("_hi"))
    lows = blocks.select("*", upto(INDEX_BLOCK).alias("_lo"))
    return (lows.withColumn("_i", F.col("_hi") * INDEX_BLOCK + F.col("_lo"))
            .filter(F.col("_i") < times).drop("_hi", "_lo"))


def product(spark: SparkSession, groups: Sequence[DataFrame | None],
            sizes: Sequence[Size]) -> DataFrame:
    """Cross product of groups with ordinals; ``combo_id`` counts with the last fastest.

    Group ``k`` brings its columns as ``_g<k>_<name>`` and its ordinal as ``_o<k>``; a
    group given as None brings only the ordinal.
    """
    rows = [s.rows for s in sizes]
    total = math.prod(rows)
    if total >= 2**63:
        raise ValueError("the grid has more combinations than a bigint can number")

    def member(k: int) -> DataFrame:
        if groups[k] is None:
            return spark.range(rows[k]).select(F.col("id").alias(f"_o{k}"))
        return groups[k].select(
            F.col(ORD).alias(f"_o{k}"),
            *[F.col(f"`{c}`").alias(f"_g{k}_{c}") for c in groups[k].columns if c != ORD])

    order = sorted(range(len(groups)), key=lambda k: -rows[k])
    # a group given as None is only a number, whatever its rows
    large = [k for k in order if groups[k] is not None and not sizes[k].broadcastable]
    small = [k for k in order if k not in large]
    content = sum((sizes[k].bytes or 0) * (total // max(rows[k], 1)) for k in range(len(groups)))
    tasks = max(1, -(-total // COMBOS_PER_TASK), min(content // BYTES_PER_TASK, total))
    times = math.prod(rows[k] for k in small) if total else 0
    if not large:
        # numbers are dealt to tasks; nothing is shuffled
        out = spark.range(0, total, 1, tasks).withColumnRenamed("id", "_i")
    else:
        out, done = member(large[0]), rows[large[0]]
        wanted = min(tasks, rows[large[0]], MOST_TASKS)
        if len(large) == 1 and out.rdd.getNumPartitions() < wanted:
            # a scan of few splits, whose rows would be more combinations in a task than it should hold;
            # by ordinal, since rows dealt in turn would be sorted first
            out = out.repartition(wanted, f"_o{large[0]}")
        for at, k in enumerate(large[1:], 1):
            out = _tiled(out, large[:at], rows, done, member(k), k)
            done *= rows[k]
        out = _repeat(out, times)
    for k in small:
        times = times // rows[k] if rows[k] else 0
        out = out.withColumn(f"_o{k}", F.expr(f"(_i div {max(times, 1)}L) % {max(rows[k], 1)}L"))
        if groups[k] is not None:
            # never the other way round: the repeated side is larger than its statistics say
            out = out.join(F.broadcast(member(k)), f"_o{k}")
    combo, weight = F.lit(0).cast("long"), 1
    for k in reversed(range(len(groups))):
        combo = combo + F.col(f"_o{k}") * F.lit(weight)
        weight *= max(rows[k], 1)
    return out.drop("_i").withColumn("combo_id", combo)


def _tiled(left: DataFrame, members: Sequence[int], rows: Sequence[int], n_left: int, right: DataFrame,
           k: int) -> DataFrame:
    """Product of rows made of ``members`` with group ``k``, by tiles of both.

    A row of either side is copied to every tile of the other, and a pair of tiles is one key.
    """
    place, weight = F.lit(0).cast("long"), 1
    for m in reversed(members):
        place = place + F.col(f"_o{m}") * F.lit(weight)
        weight *= max(rows[m], 1)
    tiles_left, tiles_right = -(-n_left // TILE_ROWS), -(-rows[k] // TILE_ROWS)
    own = _repeat(left, tiles_right).withColumnRenamed("_i", "_tr").withColumn(
        "_tl", F.floor(place / TILE_ROWS).cast("long"))
    other = _repeat(right, tiles_left).withColumnRenamed("_i", "_tl").withColumn(
        "_tr", F.floor(F.col(f"_o{k}") / TILE_ROWS).cast("long"))
    # a number that is asked for: adaptive plans would join many tiles into one task, since copies are few bytes
    tasks = max(1, min(tiles_left * tiles_right, MOST_TASKS))
    own, other = own.repartition(tasks, "_tl", "_tr"), other.repartition(tasks, "_tl", "_tr")
    return own.join(other.hint("merge"), ["_tl", "_tr"]).drop("_tl", "_tr")


def text_group(group: DataFrame) -> DataFrame:
    """The group with every variable as the text it has inside a prompt (NULL if missing).

    Done before the product: once per row of the group, not once per combination.
    """
    columns = []
    for f in group.schema.fields:
        col = F.col(f"`{f.name}`")
        if f.name == "_id":
            columns.append(col.cast("string").alias("_id"))
        elif f.name.startswith("_") or isinstance(f.dataType, T.StringType):
            columns.append(col)
        else:
            present = col.isNotNull()
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                present = present & ~F.isnan(col)
            columns.append(F.when(present, value_text(col, f.dataType)).alias(f.name))
    return group.select(*columns)


def _owners(groups: Sequence[DataFrame | None]) -> dict[str, _Variable]:
    """Variable name to its column; a later group takes over the name."""
    found: dict[str, _Variable] = {}
    for k, g in enumerate(groups):
        if g is None:
            continue
        id_column = f"_g{k}__id" if "_id" in g.columns else None
        for f in g.schema.fields:
            if not f.name.startswith("_"):
                text = isinstance(f.dataType, T.StringType) and not f.metadata.get("json_text")
                found[f.name] = _Variable(k, f"_g{k}_{f.name}", text, id_column)
    return found


def _text_or_null(v: _Variable) -> Column:
    return F.col(f"`{v.column}`")


def _masked_text(v: _Variable) -> Column:
    """Text of a value, or the row's ``_id`` in its place when the value is a string."""
    text = _text_or_null(v)
    if v.id_column is None or not v.is_text:
        return text
    row_id = F.col(v.id_column)
    return F.when(text.isNotNull() & (row_id != ""), row_id).otherwise(text)


def _text_map(texts: Mapping[str, Column]) -> Column:
    if not texts:
        return F.create_map().cast("map<string,string>")
    # not from arrays: of a map by pairs the plan reads one value without making the map
    return F.create_map(*[c for n, text in texts.items() for c in (F.lit(n), text)])


def missing_variables(templates: Mapping[str, str], known: Sequence[str],
                      functions: Sequence[str] = ()) -> list[tuple[str, str]]:
    """(prompt, variable) of every placeholder no group and no function can fill."""
    out = []
    for prompt, template in templates.items():
        for piece in split_template(template)[1]:
            fillable = piece.name in known if piece.params is None else False
            if not fillable and piece.name not in functions:
                out.append((prompt, piece.name))
    return out


def missing_in(templates: DataFrame, known: DataFrame) -> DataFrame:
    """Same check for templates held in a table: ``prompt_name``, ``var_name``.

    ``known`` has one column ``var_name``.
    """
    used = templates.select(
        "prompt_name", F.explode(placeholder_names(F.col("template"))).alias("placeholder"))
    named = used.select("prompt_name", variable_name(F.col("placeholder")).alias("var_name"))
    return named.join(known, "var_name", "left_anti").select("prompt_name", "var_name").distinct()


def _add_calls(df: DataFrame, piece: Piece, function: PromptFunction, column: str,
               groups: Sequence[DataFrame | None], sizes: Sequence[Size],
               owners: Mapping[str, _Variable]) -> DataFrame:
    """Join the value of one function placeholder.

    Calls are distinct keys over the product of only those groups that own the
    arguments; the texts themselves stay out of that product.
    """
    params = list(piece.params or ())
    names = function.variables(params)
    involved = sorted({owners[n].group for n in names})
    thin = [groups[k].select(ORD, *[_key_name(n) for n in names if owners[n].group == k]) for k in involved]
    # texts do not count for the tasks: of a large group only keys are there
    part = product(df.sparkSession, thin, [sizes[k] if sizes[k].broadcastable else Size(sizes[k].rows) for k in involved])
    calls = part.select(*[
        F.col(f"`_g{involved.index(owners[n].group)}_{_key_name(n)}`").alias(n) for n in names]).distinct()
    texts = {
        n: groups[owners[n].group].select(
            F.col(_key_name(n)).alias("key"), F.coalesce(F.col(f"`{n}`"), F.lit("")).alias("text")
        ).dropDuplicates(["key"]) for n in names}
    values = function.apply(calls, texts, params).select(
        *[F.col(n).alias(f"{column}_{n}") for n in names], F.col("value").alias(column))
    keyed = df.withColumns({
        f"{column}_{n}": F.col(f"`_g{owners[n].group}_{_key_name(n)}`") for n in names})
    return keyed.join(values, [f"{column}_{n}" for n in names], "left")


def _key_name(variable: str) -> str:
    """Hidden column of a group: key of a variable that a function reads."""
    return f"_md5_{variable}"


def _beyond(text: Column) -> Column:
    """Bytes of a text beyond the first of each character."""
    return F.coalesce(F.octet_length(text) - F.length(text), F.lit(0))


def _beyond_name(variable: str) -> str:
    """Hidden column of a group: ``_beyond`` of a variable's text."""
    return f"_beyond_{variable}"


def expand(project: Project, missing: str = "error",
           functions: Mapping[str, PromptFunction] | None = None,
           sizes: Mapping[str, Size] | None = None, chars: bool = False) -> DataFrame:
    """The grid of a project: ``combo_id, prompt_name, args, masked, prompt,
    prompt_hash, hash_prefix``.

    An unknown placeholder is an error, or with ``missing="marker"`` leaves a marker. With ``chars`` a last
    column ``chars`` holds the number of characters of the prompt: its bytes, which are known, less those beyond
    the first of a character, which are counted once for each value and not for each combination.
    """
    functions = dict(functions or {})
    templates = project.enabled_prompts
    groups: list[DataFrame | None] = [None, *project.groups.values()]
    known = sizes if sizes is not None else group_sizes(project.groups)
    counts = [Size(len(templates)), *[known[n] for n in project.groups]]
    owners = _owners(groups)
    groups = [None if g is None else text_group(g) for g in groups]
    if chars:
        used = {p.name for t in templates.values() for p in split_template(t)[1] if p.params is None and p.name in owners}
        groups = [None if g is None else g.select("*", *[
            _beyond(F.col(f"`{n}`")).alias(_beyond_name(n)) for n in sorted(used) if owners[n].group == k])
            for k, g in enumerate(groups)]

    unknown = missing_variables(templates, ["prompt", *owners], list(functions))
    if unknown and missing == "error":
        raise ValueError(
            f'Prompt contains argument "{unknown[0][1]}", but it was not found in the input '
            f"arguments (all: {unknown})")

    calls: dict[Piece, str] = {}
    for template in templates.values():
        for piece in split_template(template)[1]:
            plain = piece.params is None and (piece.name in owners or piece.name == "prompt")
            if not plain and piece.name in functions:
                calls.setdefault(piece, f"_call{len(calls)}")
    for piece in calls:
        for n in functions[piece.name].variables(list(piece.params or ())):
            if n not in owners:
                raise ValueError(f'function "{piece.name}" needs variable "{n}"')
            k = owners[n].group
            groups[k] = groups[k].withColumn(_key_name(n), F.md5(F.coalesce(F.col(f"`{n}`"), F.lit(""))))

    df = product(project.spark, groups, counts)
    # prompts are few constants, looked up by number
    number = F.col("_o0").cast("int")
    df = df.select(
        "*",
        F.get(F.array(*[F.lit(n) for n in templates]), number).alias("prompt_name"),
        F.get(F.array(*[F.lit(t) for t in templates.values()]), number).alias("_template"))
    for piece, column in calls.items():
        df = _add_calls(df, piece, functions[piece.name], column, groups, counts, owners)

    def value_of(piece: Piece) -> Column:
        if piece in calls:
            return F.coalesce(F.col(calls[piece]), F.lit(""))
        if piece.params is None and piece.name in owners:
            return F.coalesce(_text_or_null(owners[piece.name]), F.lit(""))
        if piece.params is None and piece.name == "prompt":
            return F.col("_template")
        return F.lit(MISSING_MARKER.format(piece.name))

    # each template becomes one concat over the columns it names
    rendered = [literal_render(t, value_of) for t in templates.values()]
    if len(rendered) > 1:
        prompt = F.when(F.col("_o0") == 0, rendered[0])
        for i, text in enumerate(rendered[1:], 1):
            prompt = prompt.when(F.col("_o0") == i, text)
    else:
        prompt = rendered[0] if rendered else F.lit(None).cast("string")
    args = {"prompt": F.col("_template")} | {n: _text_or_null(v) for n, v in owners.items()}
    masked = {"prompt": F.col("prompt_name")} | {n: _masked_text(v) for n, v in owners.items()}
    if not chars:
        return _keyed(df, prompt, _text_map(args), _text_map(masked))

    def beyond(template: str) -> Column:
        texts, pieces = split_template(template)
        fixed, found = sum(len(t.encode()) - len(t) for t in texts), F.lit(0)
        for piece in pieces:
            if piece not in calls and piece.params is None and piece.name in owners:
                found = found + F.col(f"`_g{owners[piece.name].group}_{_beyond_name(piece.name)}`")
            else:
                found = found + _beyond(value_of(piece))
        return found + fixed

    less = F.coalesce(*[F.when(F.col("_o0") == i, beyond(t)) for i, t in enumerate(templates.values())], F.lit(0))
    return _keyed(df.withColumn("_less", less), prompt, _text_map(args), _text_map(masked),
                  (F.octet_length("prompt") - F.col("_less")).alias("chars"))


def _keyed(df: DataFrame, prompt: Column, args: Column, masked: Column, *more: Column) -> DataFrame:
    """The grid of combinations whose prompt is rendered, with maps of its variables.

    The maps come last: the plan does not join the steps before, whose prompt and key are read several times, and
    a step that reads one value of a map would have to make the whole map for it.
    """
    hashed = df.withColumn("prompt", prompt).withColumn("prompt_hash", keys.prompt_hash(F.col("prompt")))
    return hashed.select(
        "combo_id", "prompt_name", args.alias("args"), masked.alias("masked"), "prompt",
        "prompt_hash", keys.hash_prefix(F.col("prompt_hash")).alias("hash_prefix"), *more)


def expand_templates(templates: DataFrame, groups: Mapping[str, DataFrame],
                     sizes: Mapping[str, Size] | None = None) -> DataFrame:
    """The grid for templates that are themselves a table (``_ord, prompt_name, template``).

    Templates are cut into pieces before the product; unknown names leave a marker.
    """
    first = templates.select(
        ORD, F.col("prompt_name").alias("_id"), F.col("template").alias("prompt"),
        literals(F.col("template")).alias("_literals"),
        placeholder_names(F.col("template")).alias("_names"))
    members = [first, *groups.values()]
    known = dict(sizes) if sizes is not None else group_sizes(groups)
    counts = [group_size(templates), *[known[n] for n in groups]]
    owners = _owners(members)
    df = product(templates.sparkSession, [text_group(m) for m in members], counts)
    # every template reads the map, which is made once
    df = df.select("*", F.col("_g0__id").alias("prompt_name"), _text_map(
        {n: _text_or_null(v) for n, v in owners.items()}).alias("_args"))
    prompt = fill(F.col("_g0__literals"), placeholder_values(F.col("_g0__names"), F.col("_args")))
    return _keyed(df, prompt, F.col("_args"), _text_map({n: _masked_text(v) for n, v in owners.items()}))


def current_combo(project: Project, prompt_name: str, picks: Mapping[str, int],
                  functions: Mapping[str, PromptFunction] | None = None) -> DataFrame:
    """The one combination of a prompt with the picked row of each group."""
    groups = {
        name: df.filter(F.col(ORD) == picks.get(name, 0)).withColumn(ORD, F.lit(0).cast("long"))
        for name, df in project.groups.items()}
    one = Project(project.spark, {prompt_name: project.prompts[prompt_name]}, groups)
    return expand(one, functions=functions, sizes={n: Size(1, 0) for n in groups})


def placeholders(templates: DataFrame, args: str | None = None) -> DataFrame:
    """One row per placeholder: name, call arguments, offsets and, given a map column
    of argument texts, the value that takes its place."""
    template = F.col("template")
    names = placeholder_names(template)
    pieces = spans(template)
    if args is None:
        values = F.transform(names, lambda n: F.lit(None).cast("string"))
    else:
        values = placeholder_values(names, F.col(args))
    # outer: the inner form computes the array twice, to look for templates without any
    rows = templates.select("prompt_name", F.posexplode_outer(F.arrays_zip(
        pieces.alias("span"), values.alias("value"))).alias("pos", "p")).filter("pos IS NOT NULL")
    name = F.col("p.span.placeholder")
    return rows.select(
        "prompt_name", "pos", name.alias("placeholder"), variable_name(name).alias("var_name"),
        function_params(name).alias("function_params"),
        F.col("p.span.start").alias("start"), F.col("p.span.end").alias("end"),
        F.col("p.value").alias("value"))


def highlights(templates: DataFrame, args: str, rendered: bool = True) -> DataFrame:
    """Where each placeholder lies in the template, or its value in the filled text."""
    template = F.col("template")
    values = placeholder_values(placeholder_names(template), F.col(args)) if rendered else None
    rows = templates.select("prompt_name", F.explode_outer(spans(template, values)).alias("s")).filter(
        "s IS NOT NULL")
    return rows.select(
        "prompt_name", F.col("s.pos").alias("pos"),
        variable_name(F.col("s.placeholder")).alias("var_name"),
        F.col("s.start").alias("start"), F.col("s.end").alias("end"))


def work(grid: DataFrame, runs: Sequence[RunKey]) -> DataFrame:
    """Every combination with every run."""
    return with_runs(grid, runs)


def distinct_work(grid: DataFrame, runs: Sequence[RunKey]) -> DataFrame:
    """One row per (prompt, run): its first combination and how many it serves.

    Prompts are collapsed before the runs are added, with map-side partial results,
    so one very frequent prompt costs one row per task in the shuffle.
    """
    once = grid.groupBy("hash_prefix", "prompt_hash").agg(
        F.min("combo_id").alias("combo_id"),
        F.count(F.lit(1)).alias("combos"),
        F.min_by(F.struct("prompt", "masked"), "combo_id").alias("_first"))
    flat = once.select("combo_id", "hash_prefix", "prompt_hash", "combos",
                       F.col("_first.prompt").alias("prompt"), F.col("_first.masked").alias("masked"))
    return with_runs(flat, runs)
