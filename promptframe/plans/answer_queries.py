"""Queries over answers, reports and retrieved passages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from promptframe.functions.answers import extract_json
from promptframe.operators import analysis, rag
from promptframe.operators.grid import expand
from promptframe.operators.report import order_report_columns, read_report, union_runs, write_report
from promptframe.plans.registry import group, query, table
from promptframe.session import shared_dir
from promptframe.sources.files import group_from_rows
from promptframe.sources.ordinals import with_ordinals
from promptframe.sources.project import Project

# --- answers -------------------------------------------------------------------------

OBJECT_SQL = "json_object('role', role, 'text', text)::varchar"
DATA_SQL = f"""CASE turn WHEN 2 THEN json_object('text', role)::varchar WHEN 5 THEN NULL
                         WHEN 6 THEN '{{"response":["a","b"]}}' WHEN 7 THEN '{{"value":42}}' ELSE {OBJECT_SQL} END"""
CONTENT_SQL = f"""CASE turn WHEN 5 THEN 'no JSON in ' || text END"""


def _contents(spark: SparkSession, sf: str) -> DataFrame:
    """Answer texts that are JSON in as many ways as there are turns."""
    whole = F.to_json(F.struct("role", "text"))
    turn = F.col("turn")
    content = (
        F.when(turn == 1, F.concat(F.lit("Sure, here:\n```json\n"), whole, F.lit("\n```\nAnything else?")))
        .when(turn == 2, F.concat(F.lit("'"), "role", F.lit("'")))
        .when(turn == 3, F.concat(F.lit("The answer is "), whole, F.lit(" I think")))
        .when(turn == 4, F.concat(F.substring(whole, F.lit(1), F.length(whole) - 1), F.lit(",}")))
        .when(turn == 5, F.concat(F.lit("no JSON in "), "text"))
        .when(turn == 6, F.lit('["a","b"]')).when(turn == 7, F.lit(" 42 ")).otherwise(whole))
    return table(spark, sf, "conversations").withColumn("content", content)


def _chat(*contents: Column) -> Column:
    return F.to_json(F.struct(F.array(*[
        F.struct(F.struct(c.alias("content")).alias("message")) for c in contents]).alias("choices")))


@query(f"SELECT conv_id, turn, {DATA_SQL} AS data FROM conversations")
def json_rescue(spark: SparkSession, sf: str) -> DataFrame:
    return _contents(spark, sf).select("conv_id", "turn", extract_json(F.col("content")).alias("data"))


@query(f"""
  SELECT conv_id, turn, 0 AS pos, {DATA_SQL} AS data,
         CASE WHEN role = 'user' AND turn <> 5 THEN 0 END AS choice, {CONTENT_SQL} AS raw FROM conversations
  UNION ALL
  SELECT conv_id, turn, 1, '{{"second":true}}', 1, NULL FROM conversations WHERE role = 'user'""")
def answer_items(spark: SparkSession, sf: str) -> DataFrame:
    """User turns have two choices, the others one in the other response shape."""
    content = F.col("content")
    other = F.to_json(F.struct(F.array(
        F.struct(F.array(F.struct(content.alias("text"))).alias("content"))).alias("output")))
    records = _contents(spark, sf).select("conv_id", "turn", F.when(
        F.col("role") == "user", _chat(content, F.lit('{"second":true}'))).otherwise(other).alias("response"))
    return analysis.answer_items(records).select("conv_id", "turn", "pos", "data", "choice", "raw")


@query("""
  SELECT event_id, CASE event_type WHEN 'click' THEN 'Null response' WHEN 'view' THEN 'Empty response from API'
           WHEN 'purchase' THEN 'Unknown response format: dict_keys([''k'', ''kind''])'
           WHEN 'signup' THEN 'Content is None' ELSE 'Error parsing JSON' END AS error,
         CASE event_type WHEN 'error' THEN 'k is ' || props[6:] || ' and {' END AS raw
  FROM events""")
def answer_errors(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    response = (
        F.when(kind == "click", "{}").when(kind == "view", '{"choices":[]}')
        .when(kind == "purchase", F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"kind":1}')))
        .when(kind == "signup", '{"choices":[{"message":{"content":null}}]}')
        .otherwise(_chat(F.concat(F.lit("k is "), F.substring(F.col("props"), F.lit(6), F.length("props")), F.lit(" and {")))))
    records = table(spark, sf, "events").select("event_id", response.alias("response"))
    return analysis.answer_items(records).select("event_id", "error", "raw")


K = "json_extract_string(props, '$.k')"
FLAT_SQL = f"""
  SELECT event_id, 0 AS pos, 0 AS list_pos, '{{"k":' || {K} || '}}' AS data FROM events WHERE event_type = 'click'
  UNION ALL SELECT event_id, 0, 1, '{{"kind":"click","k":"' || {K} || '"}}' FROM events WHERE event_type = 'click'
  UNION ALL SELECT event_id, 0, 0, '{{}}' FROM events WHERE event_type = 'view'
  UNION ALL SELECT event_id, 0, 0, '{{"value":' || {K} || '}}' FROM events WHERE event_type = 'purchase'
  UNION ALL SELECT event_id, 1, 0, '{{"value":"x"}}' FROM events WHERE event_type = 'purchase'
  UNION ALL SELECT event_id, 0, 0, '{{"data":[{{"k":' || {K} || '}}]}}' FROM events WHERE event_type = 'signup'
  UNION ALL SELECT event_id, 1, 0, '{{"other":[1]}}' FROM events WHERE event_type = 'signup'
  UNION ALL SELECT event_id, 0, 0, '{{"result":"[' || {K} || ']"}}' FROM events WHERE event_type = 'error'
"""


def _wrapped_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Lists under a wrapper key, an empty one, two wrappers, one that is not, and a string."""
    k, kind = F.get_json_object("props", "$.k"), F.col("event_type")

    def text(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    response = (
        F.when(kind == "click", _chat(text('{"result": [{"k":', k, '},{"kind":"click","k":"', k, '"}]}')))
        .when(kind == "view", _chat(F.lit('{"list":[]}')))
        .when(kind == "purchase", _chat(text('{"data":[', k, ']}'), F.lit('{"results":["x"]}')))
        .when(kind == "signup", _chat(text('{"data":[{"k":', k, "}]}"), F.lit('{"other":[1]}')))
        .otherwise(_chat(text('{"result":"[', k, ']"}'))))
    return table(spark, sf, "events").select(
        "event_id", F.col("event_id").alias("combo_id"), response.alias("response"),
        F.date_format("ts", "yyyyMMddHHmmss").alias("timestamp"),
        F.create_map(F.lit("kind"), "event_type").alias("masked"))


@query(FLAT_SQL)
def flatten_answers(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.flatten_answers(_wrapped_answers(spark, sf)).select("event_id", "pos", "list_pos", "data")


@query(f"""
  SELECT event_id, pos, list_pos, json_extract_string(data, '$.k') AS k, json_extract_string(data, '$.kind') AS kind,
         json_extract_string(data, '$.value') AS value,
         CASE WHEN event_type = 'signup' AND pos = 0 THEN '[{{"k":' || {K} || '}}]' END AS data,
         CASE WHEN event_type = 'signup' AND pos = 1 THEN '[1]' END AS other,
         CASE WHEN event_type = 'error' THEN '[' || {K} || ']' END AS result,
         event_type AS input_kind, strftime(ts, '%Y%m%d%H%M%S') AS _timestamp,
         CASE WHEN event_type IN ('purchase', 'signup') THEN pos::varchar END AS _choice
  FROM ({FLAT_SQL}) JOIN events USING (event_id)""")
def answer_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Columns are found in the data; keys of the record stay in front."""
    rows = analysis.flatten_answers(_wrapped_answers(spark, sf))
    return analysis.to_columns(rows, keep=["event_id", "pos", "list_pos"])


@query(f"""
  SELECT event_id, pos, list_pos, try_cast(json_extract_string(data, '$.k') AS bigint) AS k,
         json_extract_string(data, '$.kind') AS kind,
         CASE WHEN event_type = 'error' THEN '{{"result":"[' || {K} || ']"}}'
              WHEN event_type NOT IN ('click', 'view') THEN data::varchar END AS rest
  FROM ({FLAT_SQL}) JOIN events USING (event_id)""")
def answer_typed(spark: SparkSession, sf: str) -> DataFrame:
    """Two wished keys as typed columns, all others as one variant; the data are read once."""
    rows = analysis.flatten_answers(_wrapped_answers(spark, sf))
    typed = analysis.typed_columns(rows, {"k": "bigint", "kind": "string"}, ["event_id", "pos", "list_pos"])
    return typed.withColumn("rest", F.to_json("rest"))


@query(f"""
  WITH keys AS (SELECT event_type, unnest(json_keys(data)) AS key, data FROM ({FLAT_SQL}) JOIN events USING (event_id)),
       kinds AS (SELECT event_type, key, CASE json_type(data, '$.' || key) WHEN 'VARCHAR' THEN 'STRING'
                   WHEN 'ARRAY' THEN CASE key WHEN 'data' THEN 'ARRAY<OBJECT<k: BIGINT>>' ELSE 'ARRAY<BIGINT>' END
                   ELSE 'BIGINT' END AS kind FROM keys),
       types AS (SELECT event_type, key, CASE WHEN count(DISTINCT kind) > 1 THEN 'VARIANT' ELSE min(kind) END AS kind
                 FROM kinds GROUP BY ALL)
  SELECT event_type AS input_kind,
         'OBJECT<' || coalesce(string_agg(key || ': ' || kind, ', ' ORDER BY key), '') || '>' AS schema
  FROM (SELECT DISTINCT event_type FROM events) LEFT JOIN types USING (event_type) GROUP BY 1""")
def answer_schema(spark: SparkSession, sf: str) -> DataFrame:
    """The type of all answers of each kind of event, found by one aggregate."""
    rows = analysis.flatten_answers(_wrapped_answers(spark, sf)).withColumn("input_kind", F.col("masked")["kind"])
    return analysis.answer_schema(rows, "input_kind")


@query("""SELECT event_id, event_type || '!' AS label, length(props) AS size, event_type AS input_kind, 't' AS _timestamp
          FROM events WHERE event_type <> 'view'
          UNION ALL SELECT event_id, 'twice', 0, event_type, 't' FROM events WHERE event_type = 'click'""")
def python_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """User code that returns a row, a list of rows or nothing per answer."""
    records = table(spark, sf, "events").select(
        F.col("event_id").alias("combo_id"), F.to_json(F.struct("event_type", "props")).alias("response"),
        F.lit("t").alias("timestamp"), F.lit(None).cast("struct<cost:double>").alias("usage"),
        F.create_map(F.lit("kind"), "event_type").alias("masked"))

    def read(response, timestamp, usage):
        kind = response["event_type"]
        row = {"label": kind + "!", "size": len(response["props"])}
        if kind == "view":
            return None
        return [row, {"label": "twice", "size": 0}] if kind == "click" else row

    made = analysis.with_inputs(analysis.python_analysis(records, read, "label string, size bigint"))
    return made.withColumnRenamed("combo_id", "event_id")


@query("SELECT count(*) AS n, sum(length(props))::bigint AS total FROM events")
def python_reduce(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(
        F.lit(1).cast("long").alias("n"), F.length("props").cast("long").alias("total"))
    return analysis.python_reduce(
        rows, lambda rs: {"n": sum(r["n"] for r in rs), "total": sum(r["total"] for r in rs)}, "n bigint, total bigint")


@query("SELECT event_type AS kind, count(*) AS n, sum(length(props))::bigint AS total FROM events GROUP BY 1")
def python_reduce_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """A user's roll-up for each kind of event."""
    rows = table(spark, sf, "events").select(
        F.col("event_type").alias("kind"), F.lit(1).cast("long").alias("n"), F.length("props").cast("long").alias("total"))
    return analysis.python_reduce(
        rows, lambda rs: {"kind": rs[0]["kind"], "n": sum(r["n"] for r in rs), "total": sum(r["total"] for r in rs)},
        "kind string, n bigint, total bigint", ["kind"])


@query("""SELECT user_id, event_type AS kind, count(*) AS n, max(length(props))::bigint AS longest
          FROM events GROUP BY ALL""")
def python_reduce_many_keys(spark: SparkSession, sf: str) -> DataFrame:
    """A user's roll-up by keys whose number grows with the table; a task holds one at a time."""
    rows = table(spark, sf, "events").select(
        "user_id", F.col("event_type").alias("kind"), F.lit(1).cast("long").alias("n"),
        F.length("props").cast("long").alias("longest"))
    return analysis.python_reduce(
        rows, lambda rs: {"user_id": rs[0]["user_id"], "kind": rs[0]["kind"], "n": sum(r["n"] for r in rs),
                          "longest": max(r["longest"] for r in rs)},
        "user_id bigint, kind string, n bigint, longest bigint", ["user_id", "kind"])


# --- reports -------------------------------------------------------------------------

UNION_SQL = """
  SELECT 'cheap' AS "Run Name", 'Stub' AS "Module Name", o_orderstatus AS input_status, NULL AS _note,
         o_orderpriority AS answer, NULL AS score, o_orderkey AS id FROM orders
  UNION ALL SELECT 'dear', 'Chat', c_mktsegment, 'n' || c_nationkey, NULL, c_acctbal, c_custkey FROM customer
"""


def _union(spark: SparkSession, sf: str) -> DataFrame:
    cheap = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("answer"),
        F.col("o_orderstatus").alias("input_status"))
    dear = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"),
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("_note"),
        F.col("c_mktsegment").alias("input_status"))
    return order_report_columns(union_runs({"cheap": cheap, "dear": dear}, {"cheap": "Stub", "dear": "Chat"}))


@query(UNION_SQL)
def union_runs_table(spark: SparkSession, sf: str) -> DataFrame:
    return _union(spark, sf)


@query(UNION_SQL)
def report_package(spark: SparkSession, sf: str) -> DataFrame:
    """Written as a package and read back."""
    path = shared_dir(spark, "report")
    write_report({"answers": _union(spark, sf), "labels": table(spark, sf, "labels")}, path)
    return read_report(spark, path)["answers"]


# --- retrieval -----------------------------------------------------------------------


@query("""
  SELECT doc_id, i AS chunk_id, md5(substr(text, (i * 450 + 1)::bigint, 500)) AS chunk
  FROM (SELECT *, CASE WHEN length(text) <= 500 THEN 1 ELSE ceil((length(text) - 50) / 450.0)::bigint END AS n
        FROM documents), LATERAL (SELECT unnest(generate_series(0, n - 1)) AS i)""")
def fixed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return rag.fixed_chunks(docs, "text").withColumn("chunk", F.md5("chunk"))


def _cut_sql(level: int, separator: str) -> str:
    """The pieces of all texts that the level before left too long."""
    parts = (f"list_transform(string_split(piece, {separator}), lambda r, k: CASE WHEN k = 1 THEN r ELSE {separator} || r END)"
             if separator else "regexp_extract_all(piece, '(?s).')")
    return f"""
  l{level} AS (
    SELECT doc_id, list_append(path, k) AS path, piece,
           k = 1 OR lag(length(piece)) OVER (PARTITION BY doc_id, path ORDER BY k) >= 500 AS first
    FROM (SELECT doc_id, path, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS k
          FROM (SELECT doc_id, path, list_filter({parts}, lambda p: p <> '') AS pieces
                FROM l{level - 1} WHERE {'length(piece) >= 500' if level > 1 else 'true'})))"""


# a chunk's pieces are held as their texts and the places where they end
_HELD = "list_filter(a.held, lambda h: a.stop - h.stop + length(h.t) <= 50 AND a.stop - h.stop + length(h.t) + length(x.t) <= 500)"
_OUT = "CASE WHEN len(a.held) > 0 THEN list_append(a.chunks, list_aggregate([h.t FOR h IN a.held], 'string_agg', '')) ELSE a.chunks END"
_NEW = "{'t': x.t, 'stop': a.stop + length(x.t)}"
CHUNK_SQL = f"""
WITH l0 AS (SELECT doc_id, []::BIGINT[] AS path, coalesce(text, '') AS piece FROM documents),
  {",".join(_cut_sql(k + 1, s) for k, s in enumerate(("chr(10) || chr(10)", "chr(10)", "' '", "")))},
  leaves AS (
    SELECT doc_id, list({{'t': piece, 'first': first, 'held': []::STRUCT(t VARCHAR, stop BIGINT)[], 'stop': 0::BIGINT,
                         'chunks': []::VARCHAR[]}} ORDER BY path) AS xs
    FROM ({" UNION ALL ".join(f"SELECT * FROM l{k} WHERE length(piece) < 500" for k in (1, 2, 3, 4))}) GROUP BY doc_id),
  folded AS (
    SELECT doc_id, list_reduce(list_append(xs, {{'t': '', 'first': true, 'held': []::STRUCT(t VARCHAR, stop BIGINT)[],
                                                 'stop': 0::BIGINT, 'chunks': []::VARCHAR[]}}),
      lambda a, x: {{
        't': '', 'first': false,
        'held': CASE WHEN x.first THEN [{_NEW}]
                     WHEN len(a.held) > 0 AND a.stop - a.held[1].stop + length(a.held[1].t) + length(x.t) > 500
                     THEN list_append({_HELD}, {_NEW}) ELSE list_append(a.held, {_NEW}) END,
        'stop': a.stop + length(x.t),
        'chunks': CASE WHEN x.first OR len(a.held) > 0 AND a.stop - a.held[1].stop + length(a.held[1].t) + length(x.t) > 500
                       THEN {_OUT} ELSE a.chunks END}},
      {{'t': '', 'first': false, 'held': []::STRUCT(t VARCHAR, stop BIGINT)[], 'stop': 0::BIGINT,
        'chunks': []::VARCHAR[]}}).chunks AS chunks FROM leaves)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS chunk_id, md5(c) AS chunk
FROM (SELECT doc_id, k, regexp_replace(regexp_replace(c, '^[\\s\\x0b\\x1c-\\x1f\\x85\\x{{a0}}\\p{{Z}}]+', ''),
                                       '[\\s\\x0b\\x1c-\\x1f\\x85\\x{{a0}}\\p{{Z}}]+$', '') AS c
      FROM (SELECT doc_id, unnest(chunks) AS c, generate_subscripts(chunks, 1) AS k FROM folded))
WHERE c <> ''
"""


@query(CHUNK_SQL)
def recursive_chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return rag.chunk(docs, "text").withColumn("chunk", F.md5("chunk"))


@query("""SELECT DISTINCT md5(text) AS doc_hash FROM documents
          WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE source = 'src1')""")
def new_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    index = docs.filter("source = 'src1'").select(
        F.md5("text").alias("doc_hash"), F.lit(500).alias("chunk_size"), F.lit(50).alias("chunk_overlap"),
        F.lit(rag.MODEL).alias("model"))
    return rag.new_documents(docs, "text", index).select("doc_hash")


@query("SELECT DISTINCT md5(text) AS query_hash, 64 AS width FROM conversations")
def embed_queries(spark: SparkSession, sf: str) -> DataFrame:
    """User turns are in the cache already; only the others are embedded."""
    turns = table(spark, sf, "conversations").select("role", "text")
    cache = rag.embed_queries(turns.filter("role = 'user'"), "text")
    return rag.embed_queries(turns, "text", cache).select("query_hash", F.size("embedding").alias("width"))


TOP_SQL = """
  SELECT * FROM (
    SELECT q.label::varchar AS doc_hash, q.vec_id::varchar AS query_hash, c.vec_id AS chunk_id, d AS distance,
           (row_number() OVER (PARTITION BY q.vec_id ORDER BY d, c.vec_id))::int AS rank
    FROM embeddings q JOIN embeddings c ON q.label = c.label, LATERAL (
      SELECT list_sum(list_transform(list_zip(q.embedding, c.embedding),
                                     lambda x: (x[1]::double - x[2]::double) * (x[1]::double - x[2]::double))) AS d) s)
  WHERE rank <= 5
"""


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Every vector is a chunk of the document of its label, and a query to it."""
    vectors = table(spark, sf, "embeddings").select(
        F.col("label").cast("string").alias("doc_hash"), F.col("vec_id").alias("chunk_id"), "embedding")
    queries = vectors.select("doc_hash", F.col("chunk_id").cast("string").alias("query_hash"), "embedding")
    return queries, vectors


@query(f"SELECT doc_hash, query_hash, rank, chunk_id, round(distance, 6) AS distance FROM ({TOP_SQL})")
def top_k_passages(spark: SparkSession, sf: str) -> DataFrame:
    queries, chunks = _vectors(spark, sf)
    hits = rag.retrieve(queries, chunks, chunk_block=256, query_block=64)
    return hits.select("doc_hash", "query_hash", "rank", "chunk_id", F.round("distance", 6).alias("distance"))


@query(f"""
  SELECT q.vec_id::varchar AS query_hash, string_agg('Passage "' || chunk_id || '"', '----' || chr(10) ORDER BY rank) AS plain,
         '[' || string_agg('"Passage \\"' || chunk_id || '\\""', ',' ORDER BY rank) || ']' AS listed,
         '[' || chr(10) || '  ' || string_agg('"Passage \\"' || chunk_id || '\\""', ',' || chr(10) || '  ' ORDER BY rank)
             || chr(10) || ']' AS json
  FROM embeddings q JOIN ({TOP_SQL}) t ON t.query_hash = q.vec_id::varchar GROUP BY q.vec_id""")
def passages_text(spark: SparkSession, sf: str) -> DataFrame:
    queries, chunks = _vectors(spark, sf)
    texts = chunks.select("doc_hash", "chunk_id", F.concat(
        F.lit('Passage "'), F.col("chunk_id").cast("string"), F.lit('"')).alias("chunk"))
    found = rag.passages(rag.retrieve(queries, chunks), texts)
    out = queries.select("doc_hash", "query_hash")
    for name, fmt in (("plain", "text"), ("listed", None), ("json", "json")):
        out = out.join(rag.format_passages(queries, found, fmt).withColumnRenamed("value", name),
                       ["doc_hash", "query_hash"])
    return out.drop("doc_hash")


def letter_counts(texts: pd.Series) -> pd.Series:
    """A vector that SQL can make, too: how often each letter a to z stands in a text."""
    return pd.Series([np.array([t.count(c) for c in LETTERS], "float32") for t in texts.fillna("")])


LETTERS = "abcdefghijklmnopqrstuvwxyz"
QUESTIONS = ("the and of in", "le un une des")
_LETTERS_OF = "[length({0}) - length(replace({0}, c, '')) FOR c IN string_split('" + ",".join(LETTERS) + "', ',')]"


@query(f"""
WITH chunked AS ({CHUNK_SQL.replace("md5(c) AS chunk", "c AS chunk")}),
  q AS (SELECT i, q, {_LETTERS_OF.format("q")} AS v FROM (VALUES (0, '{QUESTIONS[0]}'), (1, '{QUESTIONS[1]}')) t(i, q)),
  near AS (
    SELECT doc_id, i, chunk, row_number() OVER (PARTITION BY doc_id, i ORDER BY d, chunk_id) AS rank FROM (
      SELECT doc_id, i, chunk_id, chunk, list_sum([(p[1] - p[2]) ** 2 FOR p IN list_zip(v, w)]) AS d
      FROM (SELECT *, {_LETTERS_OF.format("chunk")} AS w FROM chunked), q)),
  found AS (SELECT doc_id, i, string_agg(chunk, '----' || chr(10) ORDER BY rank) AS value FROM near WHERE rank <= 5 GROUP BY 1, 2)
SELECT doc_id * 2 + q.i AS combo_id, sha1('Use these passages:' || chr(10) || coalesce(value, '(empty)') || chr(10)
       || 'to answer: ' || q.q) AS prompt_hash
FROM documents CROSS JOIN q LEFT JOIN found USING (doc_id, i)""")
def rendered_rag(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts that hold the passages of their document for their question, from an index that is there already."""
    docs = group(spark, sf, "documents", "text", "doc_id")
    project = Project(
        spark, {"ask": "Use these passages:\n{{text(question)}}\nto answer: {{question}}"},
        {"docs": docs.drop("doc_id"), "questions": group_from_rows(spark, [{"question": q} for q in QUESTIONS])},
        rag={"text": {"chunk_size": 500, "chunk_overlap": 50, "return_format": "text", "model_name": "letters"}})
    index = shared_dir(spark, "index")
    functions = rag.passage_functions(dict(project.rag), index, letter_counts)
    # a first grid over half of the documents leaves its chunks and queries in the index
    half = with_ordinals(docs.filter(F.col("doc_id") % 2 == 0), "doc_id").drop("doc_id")
    first = Project(spark, dict(project.prompts), {"docs": half, "questions": project.groups["questions"]}, rag=dict(project.rag))
    expand(first, functions=functions).count()
    return expand(project, functions=functions).select("combo_id", "prompt_hash")
