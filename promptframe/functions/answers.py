"""From the text of an answer to JSON, and from a response to its items."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from promptframe.functions.text import let, strip

# Keys that wrap a list of rows, and the two patterns that find JSON
# inside other text.
WRAPPER_KEYS = ("response", "list", "data", "result", "results", "output")
FENCED = r"(?s)^.*?```json\s*([\{\[].{5,}[\}\]])\s*```.*?$"
EMBEDDED = r"(?s)^.*?([\{\[].{5,}[\}\]]).*?$"

RESPONSE_SCHEMA = (
    "choices array<struct<message:struct<content:string>,_extra:string>>, "
    "output array<struct<content:array<struct<text:string>>,_extra:string>>"
)


def _first_char(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, r"^\s+", ""), 1, 1)


def is_json(text: Column) -> Column:
    """Whether the whole text is one JSON value.

    The parsers accept trailing text, so the value is put in front of a key that
    cannot occur in it (its own digest) and must leave that key readable.
    """
    def readable(probe: Column) -> Column:
        whole, digest = probe["whole"], probe["digest"]
        return F.coalesce(
            (F.json_object_keys(whole) == F.array(F.lit("v"), digest))
            & F.try_parse_json(whole).isNotNull(), F.lit(False))

    return let(
        F.sha1(text),
        lambda digest: let(
            F.struct(F.concat(F.lit('{"v":'), text, F.lit(',"'), digest, F.lit('":1}')).alias("whole"),
                     digest.alias("digest")),
            readable))


def _first_value(*texts: Column) -> Column:
    """The first of some texts that is a JSON value other than null; later ones are made only if needed."""
    return F.coalesce(*[let(text, lambda t: F.when((t != "") & (_first_char(t) != "n") & is_json(t), t)) for text in texts])


def _text_row(text: Column) -> Column:
    return F.to_json(F.struct(text.alias("text")))


def _lenient(text: Column) -> Column:
    """Tolerant reading: single quotes, bare names, trailing commas, NaN."""
    options = {"allowSingleQuotes": "true", "allowUnquotedFieldNames": "true",
               "allowNonNumericNumbers": "true"}

    def read(t: Column) -> Column:
        whole = F.concat(F.lit('{"v":'), F.regexp_replace(t, r",\s*([}\]])", "$1"), F.lit("}"))
        return F.when(_first_char(t).isin("{", "["), F.from_json(whole, "v string", options)["v"])

    return let(strip(text), read)


def as_object(value: Column) -> Column:
    """JSON object text for any JSON value text."""
    def typed(v: Column) -> Column:
        first = _first_char(v)
        return (
            F.when(first == "{", v)
            .when(first == "[", F.concat(F.lit('{"response":'), v, F.lit("}")))
            .when(first == '"', _text_row(F.get_json_object(
                F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v")))
            .when(v.isNotNull(), F.concat(F.lit('{"value":'), v, F.lit("}"))))

    return let(F.btrim(value, F.lit(" \t\r\n")), typed)


def extract_json(content: Column) -> Column:
    """JSON object text of an answer, NULL when none can be read.

    Tried in turn: the whole text, a fenced block, a text in single quotes, the
    widest bracketed part, a tolerant reading. A string becomes ``{"text": ...}``,
    a list ``{"response": [...]}``, any other scalar ``{"value": ...}``.
    """
    quoted = F.when(
        content.startswith("'") & content.endswith("'"),
        _text_row(content.substr(F.lit(2), F.greatest(F.length(content) - 2, F.lit(0)))))
    return as_object(F.coalesce(
        _first_value(content, F.regexp_extract(content, FENCED, 1)),
        quoted,
        _first_value(F.regexp_extract(content, EMBEDDED, 1), _lenient(content))))


def read_response(response: Column) -> Column:
    """struct(items, count) of a response text; items are struct(pos, content, extra, error).

    Chat answers hold ``choices``, the other shape holds ``output`` whose items without
    content are skipped (but counted). A response without items gives one error item.
    """
    items_type = "array<struct<pos:int,content:string,extra:string,error:string>>"
    nothing = F.lit(None).cast("string")

    def failed(message: Column) -> Column:
        item = F.struct(F.lit(0).alias("pos"), nothing.alias("content"), nothing.alias("extra"),
                        message.alias("error"))
        return F.struct(F.array(item).cast(items_type).alias("items"), F.lit(0).alias("count"))

    def taken(outputs: Column, content_of) -> Column:
        items = F.transform(outputs, lambda c, i: F.struct(
            i.alias("pos"), content_of(c).alias("content"), c["_extra"].alias("extra"),
            nothing.alias("error")))
        return F.struct(items.cast(items_type).alias("items"), F.size(outputs).alias("count"))

    def with_content(outputs: Column) -> Column:
        numbered = F.transform(outputs, lambda c, i: F.struct(i.alias("pos"), c.alias("c")))
        kept = F.filter(numbered, lambda n: n["c"]["content"].isNotNull())
        items = F.transform(kept, lambda n: F.struct(
            n["pos"].alias("pos"), F.get(n["c"]["content"], F.lit(0))["text"].alias("content"),
            n["c"]["_extra"].alias("extra"), nothing.alias("error")))
        return F.struct(items.cast(items_type).alias("items"), F.size(outputs).alias("count"))

    def shaped(r: Column) -> Column:
        keys, choices, output = r["keys"], r["parsed"]["choices"], r["parsed"]["output"]
        empty = failed(F.lit("Empty response from API"))
        return (
            F.when(F.coalesce(F.size(keys), F.lit(0)) < 1, failed(F.lit("Null response")))
            .when(F.array_contains(keys, "choices"), F.when(
                F.coalesce(F.size(choices), F.lit(0)) > 0,
                taken(choices, lambda c: c["message"]["content"])).otherwise(empty))
            .when(F.array_contains(keys, "output"), F.when(
                F.coalesce(F.size(output), F.lit(0)) > 0, with_content(output)).otherwise(empty))
            .otherwise(failed(F.concat(
                F.lit("Unknown response format: dict_keys(['"), F.array_join(keys, "', '"), F.lit("'])")))))

    return let(F.struct(F.json_object_keys(response).alias("keys"),
                        F.from_json(response, RESPONSE_SCHEMA).alias("parsed")), shaped)


def has_error(response: Column) -> Column:
    """Whether any item of a response is an error or cannot be read as JSON."""
    return F.exists(
        read_response(response)["items"],
        lambda i: i["error"].isNotNull() | extract_json(i["content"]).isNull())


def is_wrapped_list(data: Column) -> Column:
    """Whether JSON object text is one key, of those that wrap lists, holding a list."""
    opening = rf'^\s*\{{\s*"({"|".join(WRAPPER_KEYS)})"\s*:\s*\['
    return F.coalesce(
        data.rlike(opening) & (F.size(F.json_object_keys(data)) == 1), F.lit(False))


def list_elements(data: Column) -> Column:
    """Object texts of a wrapped list; an empty list gives one empty object."""
    def first(schema: str) -> Column:
        return F.get(F.map_values(F.from_json(data, schema)), F.lit(0))

    elements = F.arrays_zip(first("map<string,array<string>>").alias("text"),
                            first("map<string,array<variant>>").alias("value"))

    def row(e: Column) -> Column:
        return let(F.to_json(e["value"]), lambda json: F.when(
            F.substring(json, 1, 1) == "{", e["text"]).otherwise(
            F.concat(F.lit('{"value":'), F.coalesce(json, F.lit("null")), F.lit("}"))))

    return let(F.transform(elements, row),
               lambda rows: F.when(F.size(rows) > 0, rows).otherwise(F.array(F.lit("{}"))))
