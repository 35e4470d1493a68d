"""Templates with ``{{variable}}`` and ``{{function(a, b)}}`` placeholders."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from promptframe.functions.text import strip

# Placeholder and call patterns, the marker of an unknown variable,
# and the patterns of the pseudo JSON object that describes an answer.
PLACEHOLDER = r"\{\{([^{}]*)\}\}"
CALL = r"^([^()]+)\((.*)\)"
MISSING_MARKER = "[!! Missing Variable: {} !!]"
FIELD_WRAPPER = r'"result"\s*:\s*\[\s*\{(.*)\}\s*\]'
FIELD_BODY = r"\{(.*)\}"
FIELD_ENTRY = r'"([^"]+)"\s*:\s*(.+?)\s*(?:,\s*)?$'


@dataclass(frozen=True)
class Piece:
    """One placeholder of a template known at plan time."""

    placeholder: str
    name: str
    params: tuple[str, ...] | None


def read_placeholder(text: str) -> Piece:
    """Name and call arguments of the text between the braces."""
    call = re.match(CALL, text)
    if call is None:
        return Piece(text, text, None)
    return Piece(text, call.group(1), tuple(p.strip() for p in call.group(2).split(",")))


def split_template(template: str) -> tuple[list[str], list[Piece]]:
    """Literal pieces (one more than placeholders) and placeholders."""
    parts = re.split(PLACEHOLDER, template)
    return parts[0::2], [read_placeholder(p) for p in parts[1::2]]


def literal_render(template: str, value_of: Callable[[Piece], Column]) -> Column:
    """Filled template as one ``concat`` over the columns it names.

    For templates known at plan time: only the named columns are read, and the
    expression stays inside generated code.
    """
    literals, pieces = split_template(template)
    cols: list[Column] = []
    for i, literal in enumerate(literals):
        if literal:
            cols.append(F.lit(literal))
        if i < len(pieces):
            cols.append(value_of(pieces[i]))
    return F.concat(*cols) if cols else F.lit("")


# --- templates held in a column ------------------------------------------------


def literals(template: Column) -> Column:
    """Literal pieces of a template column."""
    return F.split(template, PLACEHOLDER, -1)


def placeholder_names(template: Column) -> Column:
    """Texts between the braces, in order."""
    return F.regexp_extract_all(template, F.lit(PLACEHOLDER), F.lit(1))


def variable_name(placeholder: Column) -> Column:
    """Variable or function name of a placeholder text."""
    call = F.regexp_extract(placeholder, f"(?d){CALL}", 1)
    return F.when(call == "", placeholder).otherwise(call)


def function_params(placeholder: Column) -> Column:
    """Trimmed call arguments, NULL for a plain variable."""
    call = f"(?d){CALL}"
    params = F.transform(F.split(F.regexp_extract(placeholder, call, 2), ",", -1), strip)
    return F.when(F.regexp_extract(placeholder, call, 1) != "", params)


def marker(name: Column) -> Column:
    before, after = MISSING_MARKER.split("{}")
    return F.concat(F.lit(before), name, F.lit(after))


def placeholder_values(names: Column, args: Column) -> Column:
    """Text put in place of every placeholder; unknown names give the marker."""
    return F.transform(
        names,
        lambda n: F.when(F.map_contains_key(args, n), F.coalesce(F.element_at(args, n), F.lit("")))
        .otherwise(marker(variable_name(n))))


def fill(pieces: Column, values: Column) -> Column:
    """Interleave literal pieces with values, in one pass (values stay as they are)."""
    return F.concat_ws(
        "", F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(values, i), F.lit("")))))


def render(template: Column, args: Column) -> Column:
    """Fill a template column from a ``map<string,string>`` of argument texts."""
    return fill(literals(template), placeholder_values(placeholder_names(template), args))


def spans(template: Column, values: Column | None = None) -> Column:
    """Array of (pos, placeholder, start, end): offsets in the template, or in the
    filled text when the placeholder values are given."""
    names = placeholder_names(template)
    pieces = literals(template)
    if values is None:
        shown = F.transform(names, lambda n: F.concat(F.lit("{{"), n, F.lit("}}")))
    else:
        shown = values
    sized = F.transform(
        names,
        lambda n, i: F.struct(
            n.alias("placeholder"),
            F.length(F.get(pieces, i)).cast("long").alias("lead"),
            F.length(F.get(shown, i)).cast("long").alias("width")))
    empty = F.array().cast("array<struct<pos:int,placeholder:string,start:bigint,end:bigint>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out"))

    def step(acc: Column, item: Column) -> Column:
        begin = acc["at"] + item["lead"]
        end = begin + item["width"]
        row = F.struct(F.size(acc["out"]).alias("pos"), item["placeholder"].alias("placeholder"),
                       begin.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(row)).alias("out"))

    return F.aggregate(sized, start, step, lambda acc: acc["out"])


def migrate_template(template: Column) -> Column:
    """Old files wrote ``{x}`` for a placeholder and ``{{...}}`` for plain braces."""
    # doubled braces wait as two Unicode noncharacters while single ones are doubled
    opened, closed = F.lit("\ufdd0"), F.lit("\ufdd1")
    waiting = F.replace(F.replace(template, F.lit("{{"), opened), F.lit("}}"), closed)
    doubled = F.regexp_replace(waiting, r"\{([^{}]+)\}", r"{{$1}}")
    return F.replace(F.replace(doubled, opened, F.lit("{")), closed, F.lit("}"))


def output_fields(template: Column) -> Column:
    """Expected answer fields of a template: struct(multiple, fields[name, type, description]).

    Reads the pseudo JSON object of the template; NULL when it names no field.
    """
    wrapped = F.regexp_like(template, F.lit(f"(?s){FIELD_WRAPPER}"))
    body = F.when(wrapped, F.regexp_extract(template, f"(?s){FIELD_WRAPPER}", 1)).otherwise(
        F.regexp_extract(template, f"(?s){FIELD_BODY}", 1))
    entry = F.lit(f"(?dmU){FIELD_ENTRY}")
    entries = F.arrays_zip(
        F.regexp_extract_all(body, entry, F.lit(1)).alias("name"),
        F.regexp_extract_all(body, entry, F.lit(2)).alias("value"))

    def tidy(e: Column) -> Column:
        value = strip(F.regexp_replace(strip(e["value"]), r",+$", ""))
        return F.struct(strip(e["name"]).alias("name"), value.alias("value"))

    def unwrapped(text: Column, left: str, right: str) -> tuple[Column, Column]:
        inside = text.startswith(left) & text.endswith(right) & (F.length(text) >= 2)
        return inside, F.when(
            inside, strip(text.substr(F.lit(2), F.length(text) - 2))).otherwise(text)

    def field(e: Column) -> Column:
        quoted, text = unwrapped(e["value"], '"', '"')
        return F.struct(
            e["name"].alias("name"),
            F.when(quoted, "string").otherwise("numeric/logical").alias("type"),
            unwrapped(text, "<", ">")[1].alias("description"))

    named = F.filter(F.transform(entries, tidy),
                     lambda e: (e["name"] != "") & ~e["value"].isin("{", "["))
    fields = F.transform(named, field)
    return F.when(F.size(fields) > 0,
                  F.struct(wrapped.alias("multiple"), fields.alias("fields")))


def field_names(template: str) -> list[str]:
    """Expected answer columns of one template known at plan time."""
    found = (re.search(FIELD_WRAPPER, template, re.DOTALL)
             or re.search(FIELD_BODY, template, re.DOTALL))
    if found is None:
        return []
    entries = re.findall(FIELD_ENTRY, found.group(1), re.MULTILINE)
    names = (name.strip() for name, value in entries if value.strip() not in ("{", "["))
    return [name for name in names if name]


def variables_used(templates: Mapping[str, str]) -> list[tuple[str, Piece]]:
    """(prompt name, placeholder) of every template known at plan time."""
    return [(name, piece) for name, text in templates.items() for piece in split_template(text)[1]]
