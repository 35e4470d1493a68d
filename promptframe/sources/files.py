"""Readers that turn files, folders, pasted text and code into groups."""

from __future__ import annotations

import codecs
import csv
import io
import json
import math
import re
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from promptframe.functions.images import IMAGE_TYPES, image_text
from promptframe.functions.text import strip
from promptframe.session import path_exists, shared_dir
from promptframe.sources.ordinals import (
    ORD, dense_ordinals, file_order, read_parquet_group, scanned_ordinals)

# Spellings of a missing value in a CSV file.
NA_VALUES = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

SPLIT_LENGTH = 8_000_000
# rows a generator's partition holds before it hands them on
GENERATED_ROWS = 10_000

# metadata of a text column whose values were JSON numbers or nested JSON
JSON_TEXT = {"json_text": True}


# stands behind a CSV row that is read again
END_MARK = "\u0001"


def charset(encoding: str) -> str:
    """Java's name of a Python encoding name (latin-1, cp1252, utf8 ...)."""
    name = codecs.lookup(encoding).name
    return re.sub(r"^cp(125\d)$", r"windows-\1", re.sub(r"^iso8859-", "iso-8859-", name)).replace("ascii", "us-ascii")


def read_csv_group(
    spark: SparkSession, path: str, sep: str = ",", encoding: str = "utf-8",
    na_values: Iterable[str] = NA_VALUES, multi_line: bool = True,
) -> DataFrame:
    """CSV with a header; every column is text, missing spellings are NULL.

    ``multi_line=False`` lets Spark split large files whose fields hold no line breaks. A row
    with more fields than the header is an error, one with fewer ends in NULLs. All files of a
    folder must have the same header.
    """
    options = {"sep": sep, "encoding": charset(encoding), "escape": '"', "multiLine": str(multi_line).lower()}
    names = spark.read.options(header=True, inferSchema=False, **options).csv(path).columns
    text = [T.StructField(n, T.StringType()) for n in names]
    raw = "_raw_row"
    scan = spark.read.options(
        header=True, enforceSchema=False, mode="PERMISSIVE", columnNameOfCorruptRecord=raw, **options
    ).schema(T.StructType([*text, T.StructField(raw, T.StringType())])).csv(path)
    # a row of another length is kept whole by the reader: read again with an end mark behind it, which
    # lies beyond the next field if there are too many, empty ones included
    width = len(names) + 1
    fields = F.from_csv(F.concat(F.regexp_replace(raw, r"[\r\n]+\z", ""), F.lit(f"{sep}{END_MARK}")),
                        ", ".join(f"_{k} string" for k in range(width)), {"sep": sep, "escape": '"', "multiLine": "true"})
    ended = F.exists(F.array(*[fields[f"_{k}"] for k in range(width)]), lambda v: F.coalesce(v.endswith(END_MARK), F.lit(False)))
    extra = F.col(raw).isNotNull() & ~ended
    missing = [v for v in na_values if v]
    columns = []
    for k, name in enumerate(names):
        value = F.col(f"`{name}`")
        known = F.when(~value.isin(missing) & (value != ""), value)
        if k == 0:
            known = F.when(extra, F.raise_error(F.concat(
                F.lit(f"a CSV row has more than {len(names)} fields: "), F.col(raw)))).otherwise(known)
        columns.append(known.alias(name))
    return scanned_ordinals(scan, columns)


def read_lines_group(
    spark: SparkSession, path: str, variable: str, encoding: str = "utf-8") -> DataFrame:
    """One row per line, trimmed; blank lines are rows too."""
    name = charset(encoding)
    if name.startswith(("utf-16", "utf-32")):
        # line ends are not single bytes: such a file is decoded whole
        text = F.decode("content", name)
        files = spark.read.format("binaryFile").load(path).select(
            *file_order(F.col("path")),
            F.posexplode(F.split(F.regexp_replace(text, r"(\r\n?|\n)\z", ""), r"\r\n?|\n", -1)).alias("_at", "value"))
        return dense_ordinals(
            files.withColumn("value", strip(F.col("value"))).withColumnRenamed("value", variable),
            ["_dir", "_part", "_name"], "_at")
    line = F.col("value")
    if name != "utf-8":
        line = F.decode(line.cast("binary"), name)
    return scanned_ordinals(spark.read.text(path), [strip(line).alias(variable)])


def _json_schema(inferred: T.StructType) -> T.StructType:
    """Fractional numbers and nested values are kept as their JSON text.

    Inference turns ``1`` beside ``2.5`` into ``1.0``; a prompt must show ``1``.
    """
    fields = []
    for f in inferred.fields:
        if isinstance(f.dataType, (T.DoubleType, T.DecimalType, T.ArrayType, T.StructType)):
            fields.append(T.StructField(f.name, T.StringType(), True, JSON_TEXT))
        else:
            fields.append(f)
    return T.StructType(fields)


def _read_json(spark: SparkSession, path: str, encoding: str | None, multi_line: bool,
               schema: T.StructType | str | None) -> DataFrame:
    reader = spark.read.option("mode", "FAILFAST")
    if encoding is not None:
        reader = reader.option("encoding", charset(encoding))
    reader = reader.option("multiLine", multi_line)
    if schema is None:
        schema = _json_schema(reader.json(path).schema)
    scan = reader.schema(schema).json(path)
    columns = [
        F.col(f"`{f.name}`").alias(f.name, metadata=f.metadata) if f.metadata else F.col(f"`{f.name}`")
        for f in (schema.fields if isinstance(schema, T.StructType) else scan.schema.fields)]
    return scanned_ordinals(scan, columns)


def read_jsonl_group(spark: SparkSession, path: str, encoding: str = "utf-8",
                     schema: T.StructType | str | None = None) -> DataFrame:
    """One JSON object per line; give a schema to save the inference pass."""
    return _read_json(spark, path, encoding, False, schema)


def read_json_group(spark: SparkSession, path: str, encoding: str = "utf-8",
                    schema: T.StructType | str | None = None) -> DataFrame:
    """Files that each hold one JSON array of objects; any other shape is refused."""
    # first bytes are looked at where the files are read; the driver learns two answers of all files
    head = F.hex(F.substring("content", 1, 64))
    # in every encoding that JSON may have, blanks and brackets are ASCII bytes among zeros
    opening = F.regexp_replace(head, "^(EFBBBF)?(FFFE0000)?(0000FEFF)?(FFFE)?(FEFF)?(00|20|09|0D|0A)*", "")
    found = spark.read.format("binaryFile").load(path).agg(
        F.max(~opening.rlike("^(5B|$)")).alias("other"), F.max(head.startswith("EFBBBF")).alias("marked")).first()
    if found["other"]:
        raise ValueError("a JSON file must hold a list of objects")
    # only the parser's own detection takes the mark
    name = None if found["marked"] and charset(encoding) == "utf-8" else encoding
    return _read_json(spark, path, name, True, schema)


def _column_type(values: list[Any]) -> tuple[T.DataType, dict]:
    kinds = {type(v) for v in values if v is not None}
    if kinds <= {bool}:
        return (T.BooleanType(), {}) if kinds else (T.StringType(), {})
    if kinds == {int}:
        return T.LongType(), {}
    if kinds == {float}:
        return T.DoubleType(), {}
    if kinds == {str}:
        return T.StringType(), {}
    return T.StringType(), ({} if str in kinds else JSON_TEXT)


def _cell(value: Any, dtype: T.DataType) -> Any:
    if value is None or not isinstance(dtype, T.StringType) or isinstance(value, str):
        return value
    if isinstance(value, (dict, list)):
        return json.dumps(value, ensure_ascii=False)
    return str(value)


def group_from_rows(spark: SparkSession, rows: list[Mapping[str, Any]]) -> DataFrame:
    """Rows given as dicts (maybe ragged): union of keys, an absent key is NULL."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    clean = [
        {k: None if isinstance(v, float) and math.isnan(v) else v for k, v in r.items()}
        for r in rows]
    types = {n: _column_type([r.get(n) for r in clean]) for n in names}
    schema = T.StructType(
        [T.StructField(ORD, T.LongType(), False)]
        + [T.StructField(n, types[n][0], True, types[n][1]) for n in names])
    data = [(i, *[_cell(r.get(n), types[n][0]) for n in names]) for i, r in enumerate(clean)]
    return spark.createDataFrame(data, schema)


def group_from_string(spark: SparkSession, content: str, fmt: str, variable: str = "value",
                      sep: str = ",") -> DataFrame:
    """Pasted text as txt, csv, json or jsonl (an argument, so driver-sized)."""
    if fmt == "txt":
        return group_from_rows(spark, [{variable: line.strip()} for line in content.splitlines()])
    if fmt == "csv":
        reader = csv.DictReader(io.StringIO(content), delimiter=sep)
        return group_from_rows(spark, [
            {k: None if v is None or v in NA_VALUES else v for k, v in row.items() if k is not None}
            for row in reader])
    if fmt == "jsonl":
        return group_from_rows(spark, [json.loads(line) for line in content.splitlines()])
    if fmt == "json":
        rows = json.loads(content)
        if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
            raise ValueError("a JSON text must hold a list of objects")
        return group_from_rows(spark, rows)
    raise ValueError(f"unknown format {fmt!r}")


def parts_of(text, length: int):
    """Array of consecutive pieces of ``length`` characters; a short text is one piece."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{length}}}"), F.lit(0))
    return F.when(F.length(text) > length, pieces).otherwise(F.array(text))


def keep_parts(parts, count: int | None):
    """First ``count`` parts, last ``-count`` parts, or all for 0 and None."""
    if not count:
        return parts
    if count > 0:
        return F.slice(parts, 1, count)
    return F.slice(parts, F.greatest(F.size(parts) + count + 1, F.lit(1)), -count)


def split_fixed(df: DataFrame, key: str, text: str, length: int = SPLIT_LENGTH,
                count: int | None = None) -> DataFrame:
    """Rows of (``_id``, ``document_text``, ``document_size``) plus ``_part``, the
    place among the kept parts. Parts of a split text are named ``<key>_part_000`` on."""
    parts = parts_of(F.col(text), length)
    numbered = F.transform(parts, lambda p, i: F.struct(i.alias("no"), p.alias("text")))
    long = F.length(F.col(text)) > length
    # outer: the inner form computes the parts twice, to look for rows without any
    out = df.select(
        "*", long.alias("_long"),
        F.posexplode_outer(keep_parts(numbered, count)).alias("_part", "_piece")).filter("_part IS NOT NULL")
    number = F.col("_piece.no").cast("string")
    suffix = F.concat(F.lit("_part_"), F.lpad(number, F.greatest(F.length(number), F.lit(3)), "0"))
    name = F.col(key).cast("string")
    return out.select(
        *[F.col(f"`{c}`") for c in df.columns if c not in (key, text)],
        F.col("_part").cast("long").alias("_part"),
        F.when(F.col("_long"), F.concat(name, suffix)).otherwise(name).alias("_id"),
        F.col("_piece.text").alias("document_text"),
        F.length("_piece.text").cast("long").alias("document_size"))


def _decoded(encoding: str):
    text = F.decode("content", charset(encoding))
    if charset(encoding) == "utf-8":
        text = F.when(F.is_valid_utf8(F.col("content").cast("string")), text).otherwise(
            F.raise_error(F.concat(F.lit("Errors reading files: "), F.col("_name"))))
    return F.regexp_replace(text, "\r\n?", "\n")


#: Encodings whose line ends are single bytes that stand for nothing else: their files are read by lines.
BY_LINES = r"utf-8|us-ascii|iso-8859-\d+|windows-125\d"
FILE = ["_dir", "_part", "_name"]


def _text_lines(found: DataFrame, lines: DataFrame, encoding: str) -> tuple[DataFrame, DataFrame]:
    """Lines of text files with ``_text`` (line end included) and ``_start``, its place in the file in
    characters; and the files with ``_total``, their characters.

    ``found``: the files with ``_length``; ``lines``: written rows of the files and their splits.
    A file is never held: characters before a split are sums over splits, those inside it a window.
    The reader drops a byte order mark, and does not tell whether the last line has an end; a file's
    bytes beyond those of its lines say both.
    """
    value = F.col("value")
    if charset(encoding) == "utf-8":
        value = F.when(F.is_valid_utf8(value), value).otherwise(
            F.raise_error(F.concat(F.lit("Errors reading files: "), F.col("_name"))))
    else:
        value = F.decode(value.cast("binary"), charset(encoding))
    mark = F.decode(F.unhex(F.lit("EFBBBF")), charset(encoding))
    returned = F.col("_text").endswith("\r")
    # every line counts with its end; only the last of a file may have none
    chars = F.length("_text") - returned.cast("int") + 1
    read = lines.select(*FILE, "_block", "_at", F.octet_length("value").alias("_bytes"), value.alias("_text"))
    splits = read.groupBy(*FILE, "_block").agg(
        F.sum("_bytes").alias("_bytes"), F.count(F.lit(1)).alias("_lines"), F.sum(chars).alias("_chars"),
        F.max("_at").alias("_last_at"), F.max_by(returned, "_at").alias("_returned"))
    whole = Window.partitionBy(*FILE)
    ordered = whole.orderBy("_block")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    known = splits.join(found.select(*FILE, "_length"), FILE).select(
        *FILE, "_block", "_last_at", "_returned", F.coalesce(F.sum("_chars").over(before), F.lit(0)).alias("_before"),
        F.lead("_block").over(ordered).isNull().alias("_final"), F.sum("_chars").over(whole).alias("_chars"),
        (F.first("_length").over(whole) - F.sum("_bytes").over(whole) - F.sum("_lines").over(whole)).alias("_more"))
    known = known.select(
        *FILE, "_block", "_last_at", "_returned", "_before", "_final", "_chars", (F.col("_more") >= 2).alias("_marked"),
        F.col("_more").isin(0, 3).alias("_ended"))
    inside = Window.partitionBy(*FILE, "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    placed = read.withColumn("_inside", F.coalesce(F.sum(chars).over(inside), F.lit(0))).join(known, [*FILE, "_block"])
    start = F.col("_before") + F.col("_inside")
    open_end = F.col("_final") & (F.col("_at") == F.col("_last_at")) & ~F.col("_ended")
    text = F.when(open_end, F.col("_text")).otherwise(F.concat(
        F.when(returned, F.expr("left(_text, length(_text) - 1)")).otherwise(F.col("_text")), F.lit("\n")))
    text = F.concat(F.when(F.col("_marked") & (start == 0), mark).otherwise(""), F.replace(text, F.lit("\r"), F.lit("\n")))
    shift = F.when(F.col("_marked"), F.length(mark)).otherwise(0)
    ends = known.filter("_final").select(*FILE, (
        F.col("_chars") + shift + F.when(F.col("_ended"), 0).otherwise(F.col("_returned").cast("int") - 1)).alias("_total"))
    # a file without any line is empty, or a mark
    empty = found.join(ends.select(*FILE), FILE, "left_anti").withColumn(
        "_text", F.when(F.col("_length") > 0, mark).otherwise(""))
    rows = placed.select(*FILE, F.when(start == 0, start).otherwise(start + shift).alias("_start"), text.alias("_text"))
    return (rows.unionByName(empty.select(*FILE, F.lit(0).cast("long").alias("_start"), "_text")),
            ends.unionByName(empty.select(*FILE, F.length("_text").cast("long").alias("_total"))))


def _line_parts(found: DataFrame, lines: DataFrame, encoding: str, length: int,
                count: int | None) -> tuple[DataFrame, DataFrame]:
    """Rows of :func:`split_fixed` from the lines of files, with ``_at``, and the kept parts ``_n`` of each file.

    A line is cut where parts end, and a part is put together from its pieces.
    """
    rows, ends = _text_lines(found, lines, encoding)
    head = length - F.col("_start") % length
    pieces = F.when(F.length("_text") <= head, F.array("_text")).otherwise(F.concat(
        F.array(F.substring("_text", F.lit(1), head)),
        F.regexp_extract_all(F.substring("_text", head + 1, F.length("_text")), F.lit(f"(?s).{{1,{length}}}"), F.lit(0))))
    # outer: the inner form computes the pieces twice, to look for rows without any
    cut = rows.select(*FILE, "_start", F.posexplode_outer(pieces).alias("_k", "_piece")).withColumn(
        "_no", F.expr(f"_start div {length}") + F.col("_k"))
    parts = cut.groupBy(*FILE, "_no").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_start", "_piece"))), lambda p: p["_piece"]), "").alias("document_text"))
    known = ends.withColumn("_all", F.greatest(F.expr(f"(_total + {length - 1}) div {length}"), F.lit(1)))
    first = F.greatest(F.col("_all") + F.lit(count), F.lit(0)) if count and count < 0 else F.lit(0).cast("long")
    last = F.least(F.col("_all"), F.lit(count)) if count and count > 0 else F.col("_all")
    known = known.select(*FILE, (F.col("_total") > length).alias("_long"), first.alias("_first_kept"), last.alias("_end_kept"))
    number = F.col("_no").cast("string")
    suffix = F.concat(F.lit("_part_"), F.lpad(number, F.greatest(F.length(number), F.lit(3)), "0"))
    kept = parts.join(known, FILE).filter("_no >= _first_kept AND _no < _end_kept").select(
        *FILE, (F.col("_no") - F.col("_first_kept")).alias("_at"),
        F.when(F.col("_long"), F.concat("_name", suffix)).otherwise(F.col("_name")).alias("_id"), "document_text",
        F.length("document_text").cast("long").alias("document_size"))
    return kept, known.select(*FILE, (F.col("_end_kept") - F.col("_first_kept")).alias("_n"))


def read_directory_group(
    spark: SparkSession, path: str, encoding: str = "utf-8", split_length: int = SPLIT_LENGTH,
    split_count: int | None = None, decode: Callable[[], Any] | None = None, check: bool = True,
) -> DataFrame:
    """Text and image files of a folder, one row per file or per part, in name order.

    ``decode`` replaces the text decoding by another expression over ``content``.
    Unreadable files fail the load; ``check`` names them all first (one more read).

    Text files are split by lines over tasks, and only a part is ever held in one place. A file that goes
    to ``decode``, or whose encoding has line ends of several bytes, is one row.
    """
    def glob(suffixes: Iterable[str]) -> str:
        """Suffixes in any case; the glob keeps other files from being read."""
        cases = ["".join(f"[{c}{c.upper()}]" for c in suffix) for suffix in suffixes]
        return f"*.{{{','.join(cases)}}}"

    def matching(suffixes: Iterable[str]) -> DataFrame:
        found = spark.read.format("binaryFile").option("pathGlobFilter", glob(suffixes)).load(path)
        return found.select(*file_order(F.col("path")), F.col("length").alias("_length"), "content",
                            F.lower(F.element_at(F.split("path", r"\."), -1)).alias("_suffix"))

    listed = spark.read.format("binaryFile").load(path).select(
        F.lower(F.element_at(F.split("path", r"\."), -1)).alias("suffix"))
    kinds = {r[0] for r in listed.filter(F.col("suffix").isin("txt", *IMAGE_TYPES)).distinct().collect()}
    texts = matching(["txt"])
    by_lines = "txt" in kinds and decode is None and re.fullmatch(BY_LINES, charset(encoding)) is not None
    counts = None
    if by_lines:
        # how files are split depends on the cores at hand, so the lines are written once with their place
        written = shared_dir(spark, "lines")
        spark.read.option("pathGlobFilter", glob(["txt"])).text(path, lineSep="\n").select(
            *file_order(F.col("_metadata.file_path")), F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_at"), "value").write.parquet(written)
        lines = spark.read.parquet(written)
        if check and charset(encoding) == "utf-8":
            broken = lines.filter(~F.is_valid_utf8("value")).select("_name").distinct()
            names = sorted(r[0] for r in broken.collect())
            if names:
                raise ValueError(f"Errors reading files: {names}")
        rows, counts = _line_parts(texts.drop("content"), lines, encoding, split_length, split_count)
    else:
        body = _decoded(encoding) if decode is None else decode()
        rows = split_fixed(
            texts.select(*FILE, F.col("_name").alias("_key"), body.alias("_text"))
            .withColumnRenamed("_part", "_file_part"), "_key", "_text", split_length, split_count)
        rows = rows.withColumnsRenamed({"_part": "_at", "_file_part": "_part"})
    if kinds & set(IMAGE_TYPES):
        pictures = matching(IMAGE_TYPES).select(
            *FILE, F.lit(0).cast("long").alias("_at"), F.col("_name").alias("_id"),
            image_text(F.col("content"), F.col("_suffix")).alias("image"),
            F.col("_length").alias("image_size"))
        rows = (rows.unionByName(pictures, allowMissingColumns=True)
                if "txt" in kinds else pictures)
        if counts is not None:
            counts = counts.unionByName(matching(IMAGE_TYPES).select(*FILE, F.lit(1).cast("long").alias("_n")))
    return dense_ordinals(rows, FILE, "_at", counts)


def read_image_group(spark: SparkSession, path: str) -> DataFrame:
    """Image files of a folder: ``_id``, ``image`` text, ``image_size`` in bytes."""
    group = read_directory_group(spark, path)
    if "image" not in group.columns:
        raise ValueError(f"no image file in {path}")
    return group.filter("image is not null").select(ORD, "_id", "image", "image_size")


def generator_format(
    spark: SparkSession, generate: Callable[..., Iterable[Mapping[str, Any]]],
    schema: T.StructType | str, partitions: int = 1, per_batch: int = 1,
) -> str:
    """Register a user function as a data source and return the name of its format.

    A partition calls ``generate()`` if it is the only one, else ``generate(part, parts)``, and gives
    rows with ``_slot`` (its number) and ``_at`` (place in it). ``spark.read.format(name).load()`` reads
    all partitions; ``spark.readStream`` reads ``per_batch`` more in every micro-batch.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    name = f"generated_{uuid.uuid4().hex}"
    names = schema.fieldNames()
    placed = T.StructType([T.StructField("_slot", T.LongType()), T.StructField("_at", T.LongType()), *schema.fields])
    arrow = to_arrow_schema(placed)

    class Slot(InputPartition):
        pass

    def rows_of(slot: int) -> Iterator[pa.RecordBatch]:
        made = generate() if partitions == 1 else generate(slot, partitions)
        columns: list[list] = [[] for _ in names]
        first = 0
        for at, row in enumerate(made):
            for column, n in zip(columns, names, strict=True):
                column.append(row.get(n))
            if at + 1 - first == GENERATED_ROWS:
                yield batch_of(slot, first, columns)
                columns, first = [[] for _ in names], at + 1
        if columns and columns[0]:
            yield batch_of(slot, first, columns)

    def batch_of(slot: int, first: int, columns: list[list]) -> pa.RecordBatch:
        n = len(columns[0])
        places = [pa.array([slot] * n, pa.int64()), pa.array(range(first, first + n), pa.int64())]
        return pa.RecordBatch.from_arrays(
            [*places, *[pa.array(c, f.type) for c, f in zip(columns, list(arrow)[2:], strict=True)]], schema=arrow)

    class Reader(DataSourceReader):
        def partitions(self):
            return [Slot(k) for k in range(partitions)]

        def read(self, partition):
            return rows_of(partition.value)

    class StreamReader(DataSourceStreamReader):
        def __init__(self):
            self.reached = 0

        def initialOffset(self):
            return {"slot": 0}

        def latestOffset(self):
            self.reached = min(partitions, self.reached + per_batch)
            return {"slot": self.reached}

        def partitions(self, start, end):
            self.reached = max(self.reached, end["slot"])
            return [Slot(k) for k in range(start["slot"], end["slot"])]

        def read(self, partition):
            return rows_of(partition.value)

    class Generated(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return placed

        def reader(self, schema):
            return Reader()

        def streamReader(self, schema):
            return StreamReader()

    spark.dataSource.register(Generated)
    return name


def group_from_generator(
    spark: SparkSession, generate: Callable[..., Iterable[Mapping[str, Any]]],
    schema: T.StructType | str, partitions: int = 1,
) -> DataFrame:
    """Rows of a user function, or ``generate(part, parts)`` called once per partition.

    The rows are written once and read back: a second call might give others.
    """
    path = shared_dir(spark, "generated")
    spark.read.format(generator_format(spark, generate, schema, partitions)).load().write.parquet(path)
    return dense_ordinals(spark.read.parquet(path), ["_slot"], "_at")


def read_group(spark: SparkSession, path: str, variable: str | None = None, **options) -> DataFrame:
    """Reader chosen by the suffix of ``path``; a folder is a folder of documents."""
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    name = path.rstrip("/").rsplit("/", 1)[-1]
    stem, _, suffix = name.rpartition(".")
    suffix = suffix.lower() if stem else ""
    if suffix == "csv":
        return read_csv_group(spark, path, **options)
    if suffix == "txt":
        return read_lines_group(spark, path, variable or stem, **options)
    if suffix == "jsonl":
        return read_jsonl_group(spark, path, **options)
    if suffix == "json":
        return read_json_group(spark, path, **options)
    if suffix == "parquet":
        return read_parquet_group(spark, path)
    if not suffix:
        return read_directory_group(spark, path, **options)
    raise ValueError(f"file suffix {suffix!r} is not supported")


def require_max_rows(df: DataFrame, maximum_rows: int) -> DataFrame:
    """The group itself, or an error when it has more rows than the caller allows."""
    if df.limit(maximum_rows + 1).count() > maximum_rows:
        raise ValueError(f"the table has more than {maximum_rows} rows")
    return df
