"""Queries over sources, tables and the prompt grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from promptframe.functions import templates
from promptframe.functions.images import image_text, images, without_images
from promptframe.functions.text import double_text
from promptframe.operators import grid as g, tables
from promptframe.operators.report import project_json, read_report_project, report_prompts, write_report
from promptframe.operators.runs import public_args
from promptframe.plans.registry import RUN_A, RUN_B, group, query, table
from promptframe.session import shared_dir
from promptframe.sources import files
from promptframe.sources.ordinals import with_ordinals
from promptframe.sources.project import Project, enabled, migrate_templates, validate_runs

SEGMENT_PROMPTS = {
    "offer": "Write an offer to {{c_name}} ({{c_mktsegment}}) in {{r_name}}. Dear {{c_name}},",
    "call": "Call {{c_name}} about {{r_name}}; balance {{c_acctbal}}",
}
SEGMENT_SQL = """
  SELECT p.i * (SELECT count(*) FROM customer) * (SELECT count(*) FROM region)
         + c_custkey * (SELECT count(*) FROM region) + r_regionkey AS combo_id,
         p.name AS prompt_name,
         CASE p.i WHEN 0 THEN 'Write an offer to ' || c_name || ' (' || c_mktsegment || ') in ' || r_name
                              || '. Dear ' || c_name || ','
              ELSE 'Call ' || c_name || ' about ' || r_name || '; balance ' || c_acctbal::varchar END AS prompt
  FROM (VALUES (0, 'offer'), (1, 'call')) p(i, name), customer, region
"""

# the runs' keys as SQL: prefix of the module and digest of the arguments with sorted names
RUN_A_KEY = """'stub_' || md5('{"stub_response": "ok"}')"""
RUN_B_KEY = """'chat_' || md5('{"_key": "secret", "gpt_model": "m-large"}')"""


def _segments(spark: SparkSession, sf: str) -> Project:
    return Project(spark, SEGMENT_PROMPTS, {
        "customer": group(spark, sf, "customer", "c_name", "c_mktsegment", "c_acctbal"),
        "region": group(spark, sf, "region", "r_name")})


@query(f"SELECT combo_id, prompt_name, prompt, sha1(prompt) AS prompt_hash, sha1(prompt)[1:2] AS hash_prefix "
       f"FROM ({SEGMENT_SQL})")
def grid_render(spark: SparkSession, sf: str) -> DataFrame:
    return g.expand(_segments(spark, sf)).select(
        "combo_id", "prompt_name", "prompt", "prompt_hash", "hash_prefix")


@query("""
  SELECT p.i * (SELECT count(*) FROM documents) + doc_id AS combo_id,
         sha1(CASE p.i WHEN 0 THEN 'Summarise this ' || lang || ' text: ' || text
              ELSE 'Is this from ' || source || '? ' || text || ' Answer yes or no.' END) AS prompt_hash
  FROM (VALUES (0), (1)) p(i), documents""")
def grid_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = group(spark, sf, "documents", "text", "lang", "source")
    prompts = {"sum": "Summarise this {{lang}} text: {{text}}",
               "src": "Is this from {{source}}? {{text}} Answer yes or no."}
    return g.expand(Project(spark, prompts, {"docs": docs})).select("combo_id", "prompt_hash")


@query("""SELECT 2 * (SELECT count(*) FROM customer) * (SELECT count(*) FROM supplier)
              * (SELECT count(*) FROM part) AS combinations""")
def grid_count(spark: SparkSession, sf: str) -> DataFrame:
    project = Project(spark, {"a": "x", "b": "y"}, {
        n: group(spark, sf, n) for n in ("customer", "supplier", "part")})
    return spark.createDataFrame([(g.num_combinations(project),)], "combinations bigint")


@query("""
  SELECT p.i * (SELECT count(*) FROM customer) * (SELECT count(*) FROM nation)
         + c_custkey * (SELECT count(*) FROM nation) + n_nationkey AS combo_id,
         sha1(CASE p.i WHEN 0 THEN 'Tell about ' || c_name || ' in ' || n_name
              WHEN 1 THEN c_mktsegment || ' of ' || c_name || ': ' || n_name || '?'
              ELSE 'What sells in ' || n_name || '?' END) AS prompt_hash
  FROM (VALUES (0), (1), (2)) p(i), customer, nation""")
def grid_large(spark: SparkSession, sf: str) -> DataFrame:
    """More than a million combinations at scale factor 0.1."""
    prompts = {"tell": "Tell about {{c_name}} in {{n_name}}",
               "who": "{{c_mktsegment}} of {{c_name}}: {{n_name}}?", "what": "What sells in {{n_name}}?"}
    project = Project(spark, prompts, {
        "customer": group(spark, sf, "customer", "c_name", "c_mktsegment"),
        "nation": group(spark, sf, "nation", "n_name")})
    return g.expand(project).select("combo_id", "prompt_hash")


@query("""
  SELECT s_suppkey, count(*) AS n, sum(combo_id)::bigint AS places, sum(length(prompt))::bigint AS chars,
         min(sha1(prompt)) AS first_hash, max(sha1(prompt)) AS last_hash
  FROM (SELECT s_suppkey, p.i * (SELECT count(*) FROM supplier) * (SELECT count(*) FROM orders)
               + s_suppkey * (SELECT count(*) FROM orders) + o_orderkey AS combo_id,
               p.head || o_orderkey || ' (' || o_orderpriority || ') to ' || s_name AS prompt
        FROM (VALUES (0, 'Give order '), (1, 'Take order ')) p(i, head), supplier, orders)
  GROUP BY s_suppkey""")
def grid_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """All suppliers with all orders, a group of each kind that is taken as too large to broadcast."""
    groups = {
        "supplier": group(spark, sf, "supplier", "s_name", "s_suppkey"),
        "orders": with_ordinals(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey")}
    sizes = {name: g.Size(s.rows) for name, s in g.group_sizes(groups).items()}
    prompts = {w: w + " order {{o_orderkey}} ({{o_orderpriority}}) to {{s_name}}" for w in ("Give", "Take")}
    grid = g.expand(Project(spark, prompts, groups), sizes=sizes, chars=True)
    # the least and the greatest key over the first orders bound those over all; keys outside the bounds
    # only count, so that combinations are hashed into few rows and never sorted
    some = g.expand(Project(spark, prompts, {**groups, "orders": tables.truncate(groups["orders"], FIRST_ORDERS)}), sizes={
        **sizes, "orders": g.Size(min(sizes["orders"].rows, FIRST_ORDERS))})
    low, high = _key_bounds(some, F.col("args")["s_suppkey"])
    # keys are read once here and compared in a step of their own: one that reads them several times would
    # not be joined with the grid's, and make its maps for each combination
    each = grid.select(
        F.col("args")["s_suppkey"].cast("long").alias("s_suppkey"), "combo_id", "chars",
        F.col("prompt_hash").alias("key"))
    key = F.col("key")
    keys = each.withColumn("key", F.when((key <= low) | (key >= high), key))
    few = keys.groupBy("s_suppkey", "key").agg(
        F.count("*").alias("n"), F.sum("combo_id").alias("places"), F.sum("chars").alias("chars"))
    return few.groupBy("s_suppkey").agg(
        F.sum("n").alias("n"), F.sum("places").alias("places"), F.sum("chars").alias("chars"),
        F.min("key").alias("first_hash"), F.max("key").alias("last_hash"))


# orders whose prompts bound the keys of all
FIRST_ORDERS = 16 * g.TILE_ROWS


def _key_bounds(grid: DataFrame, by: Column) -> tuple[str, str]:
    """Texts between which no group ``by`` has its least or its greatest key, from some rows of every group.

    The first 15 digits as a number, whose extremes need no sorting.
    """
    digits = F.conv(F.substring("prompt_hash", 1, 15), 16, 10).cast("long")
    found = grid.select(by.alias("by"), digits.alias("n")).groupBy("by").agg(F.min("n").alias("low"), F.max("n").alias("high")).agg(
        F.max("low").alias("low"), F.min("high").alias("high")).first()
    return f"{found['low'] or 0:015x}g", f"{found['high'] or 0:015x}"


@query("""
  SELECT row_number() OVER (ORDER BY p_partkey, r_regionkey) - 1 AS combo_id, p_name, r_name
  FROM part, region""")
def grid_order(spark: SparkSession, sf: str) -> DataFrame:
    project = Project(spark, {"q": "-"}, {
        "part": group(spark, sf, "part", "p_name"), "region": group(spark, sf, "region", "r_name")})
    return g.expand(project).select(
        "combo_id", F.col("args").getItem("p_name").alias("p_name"),
        F.col("args").getItem("r_name").alias("r_name"))


@query("""SELECT c_custkey * (SELECT count(*) FROM nation) + n_nationkey AS combo_id,
                 'Hello ' || n_name || '!' AS prompt FROM customer, nation""")
def grid_name_clash(spark: SparkSession, sf: str) -> DataFrame:
    customer = tables.rename_variable(group(spark, sf, "customer", "c_name"), "c_name", "name")
    nation = tables.rename_variable(group(spark, sf, "nation", "n_name"), "n_name", "name")
    project = Project(spark, {"q": "Hello {{name}}!"}, {"c": customer, "n": nation})
    return g.expand(project).select("combo_id", "prompt")


@query("""SELECT c_custkey AS combo_id, 'card' AS masked_prompt, c_name AS masked_segment,
                 c_acctbal::varchar AS masked_balance, c_mktsegment AS segment FROM customer""")
def grid_masked(spark: SparkSession, sf: str) -> DataFrame:
    customer = group(spark, sf, "customer", "c_name", "c_mktsegment", "c_acctbal").withColumnRenamed("c_name", "_id")
    project = Project(spark, {"card": "{{c_mktsegment}} {{c_acctbal}}"}, {"customer": customer})
    return g.expand(project).select(
        "combo_id", F.col("masked").getItem("prompt").alias("masked_prompt"),
        F.col("masked").getItem("c_mktsegment").alias("masked_segment"),
        F.col("masked").getItem("c_acctbal").alias("masked_balance"),
        F.col("args").getItem("c_mktsegment").alias("segment"))


@query("SELECT c_custkey AS combo_id, 'Dear ' || c_name || ', [!! Missing Variable: city !!]' AS prompt FROM customer")
def grid_missing_marker(spark: SparkSession, sf: str) -> DataFrame:
    project = Project(spark, {"q": "Dear {{c_name}}, {{city}}"}, {"c": group(spark, sf, "customer", "c_name")})
    return g.expand(project, missing="marker").select("combo_id", "prompt")


@query("""
  SELECT doc_id * (SELECT count(*) FROM region) + r_regionkey AS combo_id,
         sha1(text || ' Shorten for ' || r_name || ' in ' || '[!! Missing Variable: tone !!]') AS prompt_hash
  FROM documents, region""")
def grid_template_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = group(spark, sf, "documents", "doc_id", "text").select(
        "_ord", F.col("doc_id").cast("string").alias("prompt_name"),
        F.concat("text", F.lit(" Shorten for {{r_name}} in {{tone}}")).alias("template"))
    return g.expand_templates(rows, {"region": group(spark, sf, "region", "r_name")}).select(
        "combo_id", "prompt_hash")


class _Shout:
    """Upper-case text of one variable, as a prompt function."""

    def variables(self, params):
        return [params[0]]

    def apply(self, calls: DataFrame, texts, params) -> DataFrame:
        return texts[params[0]].select(F.col("key").alias(params[0]), F.upper("text").alias("value"))


@query("""
  SELECT p_partkey * (SELECT count(*) FROM region) + r_regionkey AS combo_id,
         'Sell ' || upper(p_name) || ' / ' || p_name || ' in ' || upper(r_name) AS prompt
  FROM part, region""")
def grid_functions(spark: SparkSession, sf: str) -> DataFrame:
    project = Project(spark, {"q": "Sell {{shout(p_name)}} / {{p_name}} in {{shout( r_name )}}"}, {
        "part": group(spark, sf, "part", "p_name"), "region": group(spark, sf, "region", "r_name")})
    return g.expand(project, functions={"shout": _Shout()}).select("combo_id", "prompt")


@query("""
  SELECT 0::bigint AS combo_id, 'Translate from ' || lang || ' for ' || r_name || ': ' || text AS prompt
  FROM documents, region WHERE doc_id = 3 AND r_regionkey = 2""")
def current_combo(spark: SparkSession, sf: str) -> DataFrame:
    project = Project(spark, {"t": "Translate from {{lang}} for {{r_name}}: {{text}}"}, {
        "docs": group(spark, sf, "documents", "text", "lang"), "region": group(spark, sf, "region", "r_name")})
    return g.current_combo(project, "t", {"docs": 3, "region": 2}).select("combo_id", "prompt")


# --- templates ---------------------------------------------------------------------


def _doc_templates(spark: SparkSession, sf: str) -> DataFrame:
    """One template per document: its text with placeholders around it."""
    return group(spark, sf, "documents", "doc_id", "text", "lang", "source").select(
        "_ord", F.col("doc_id").cast("string").alias("prompt_name"),
        F.concat(F.lit("In {{lang}}: "), "text", F.lit(" {{ask(source,  lang)}}{{"), "lang", F.lit("}}"))
        .alias("template"),
        F.create_map(F.lit("lang"), F.col("lang"), F.lit("en"), F.lit("English")).alias("args"))


@query("""
  SELECT doc_id::varchar AS prompt_name, u.pos, u.placeholder, u.var_name, u.params, u."start", u."end", u.value
  FROM documents, LATERAL (VALUES
    (0, 'lang', 'lang', NULL, 3, 11, lang),
    (1, 'ask(source,  lang)', 'ask', 'source|lang', 14 + length(text), 36 + length(text),
     '[!! Missing Variable: ask !!]'),
    (2, lang, lang, NULL, 36 + length(text), 40 + length(text) + length(lang),
     CASE WHEN lang = 'en' THEN 'English' ELSE '[!! Missing Variable: ' || lang || ' !!]' END)
  ) u(pos, placeholder, var_name, params, "start", "end", value)""")
def placeholder_table(spark: SparkSession, sf: str) -> DataFrame:
    return g.placeholders(_doc_templates(spark, sf), "args").select(
        "prompt_name", "pos", "placeholder", "var_name",
        F.array_join("function_params", "|").alias("params"), "start", "end", "value")


@query("""
  SELECT p_partkey::varchar AS prompt_name, u.pos, u.var_name, u."start", u."end"
  FROM part, LATERAL (VALUES
    (0, 'p_brand', 4, 4 + length(p_brand)),
    (1, 'p_type', 8 + length(p_brand), 8 + length(p_brand) + length(p_type)),
    (2, 'p_brand', 9 + length(p_brand) + length(p_type), 9 + 2 * length(p_brand) + length(p_type))
  ) u(pos, var_name, "start", "end")""")
def highlight_spans(spark: SparkSession, sf: str) -> DataFrame:
    parts = group(spark, sf, "part", "p_partkey", "p_brand", "p_type").select(
        F.col("p_partkey").cast("string").alias("prompt_name"),
        F.lit("The {{p_brand}} is {{p_type}} {{p_brand}}").alias("template"),
        F.create_map(F.lit("p_brand"), "p_brand", F.lit("p_type"), "p_type").alias("args"))
    # the template says " is ", four characters, between the first two values
    return g.highlights(parts, "args")


@query("""
  SELECT doc_id::varchar AS prompt_name, u.var_name
  FROM documents, LATERAL (VALUES ('ask'), (lang)) u(var_name) WHERE u.var_name NOT IN ('lang', 'en')""")
def missing_variables(spark: SparkSession, sf: str) -> DataFrame:
    known = spark.createDataFrame([("lang",), ("en",)], "var_name string")
    return g.missing_in(_doc_templates(spark, sf), known)


@query(r"""
  SELECT doc_id AS _ord, md5(replace(replace(regexp_replace(
           replace(replace('Old {' || lang || '} and {{"k": {source}}} ' || text, '{{', chr(64976)), '}}', chr(64977)),
           '\{([^{}]+)\}', '{{\1}}', 'g'), chr(64976), '{'), chr(64977), '}')) AS template
  FROM documents""")
def template_migration(spark: SparkSession, sf: str) -> DataFrame:
    old = group(spark, sf, "documents", "text", "lang").select(
        "_ord", F.concat(F.lit("Old {"), "lang", F.lit('} and {{"k": {source}}} '), "text").alias("template"))
    return migrate_templates(old).select("_ord", F.md5("template").alias("template"))


@query("""
  SELECT doc_id, u.pos, u.name, u."type", u.description, lang = 'en' AS multiple
  FROM documents, LATERAL (VALUES (0, 'lang', 'string', source || ' or ' || lang),
                                  (1, 'size', 'numeric/logical', n_chars::varchar)) u(pos, name, "type", description)""")
def spec_fields(spark: SparkSession, sf: str) -> DataFrame:
    inner = F.concat(F.lit('\n\t"lang": "<'), "source", F.lit(" or "), "lang", F.lit('>",\n\t"size": <'),
                     F.col("n_chars").cast("string"), F.lit(">\n"))
    plain = F.concat(F.lit("{"), inner, F.lit("}"))
    wrapped = F.concat(F.lit('{\n\t"result": [\n\t{'), inner, F.lit("\t}\n\t]\n}"))
    docs = table(spark, sf, "documents").select("doc_id", F.concat(
        F.regexp_replace("text", '"', "'"), F.lit("\nAnswer:\n"),
        F.when(F.col("lang") == "en", wrapped).otherwise(plain)).alias("template"))
    found = docs.select("doc_id", templates.output_fields(F.col("template")).alias("spec"))
    rows = found.select("doc_id", "spec.multiple", F.posexplode("spec.fields").alias("pos", "f"))
    return rows.select("doc_id", "pos", "f.name", "f.type", "f.description", "multiple")


@query("""
  SELECT c_custkey AS id, c_acctbal::varchar AS plain, (c_acctbal * 1e13)::varchar AS large,
         (c_acctbal / 1e8)::varchar AS small FROM customer""")
def py_number_text(spark: SparkSession, sf: str) -> DataFrame:
    balance = F.col("c_acctbal")
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), double_text(balance).alias("plain"),
        double_text(balance * 1e13).alias("large"), double_text(balance / 1e8).alias("small"))


@query("""SELECT doc_id AS _ord, lang = 'en' AS enabled, doc_id::varchar AS prompt_name FROM documents WHERE lang = 'en'""")
def enabled_prompts(spark: SparkSession, sf: str) -> DataFrame:
    rows = group(spark, sf, "documents", "doc_id", "lang").select(
        "_ord", F.col("doc_id").cast("string").alias("prompt_name"), (F.col("lang") == "en").alias("enabled"))
    return enabled(rows)


@query("""SELECT doc_id::varchar AS "Prompt Name", md5(text) AS "Template" FROM documents WHERE lang = 'en'""")
def report_prompt_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = group(spark, sf, "documents", "doc_id", "text", "lang").select(
        F.col("doc_id").cast("string").alias("prompt_name"), F.col("text").alias("template"),
        (F.col("lang") == "en").alias("enabled"))
    return report_prompts(rows).withColumn("Template", F.md5("Template"))


@query("""SELECT o_orderkey, o_orderpriority AS module_id FROM orders
          WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW')""")
def unknown_modules(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("module_id"))
    known = spark.createDataFrame([("1-URGENT",), ("5-LOW",)], "module_id string")
    return validate_runs(runs, known).select("o_orderkey", "module_id")


@query("""SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || ',"model":"' || event_type || '"}' AS args
          FROM events""")
def secret_args(spark: SparkSession, sf: str) -> DataFrame:
    key = F.get_json_object("props", "$.k")
    args = F.concat(F.lit('{"_api_key":"s'), key, F.lit('","k":'), key, F.lit(',"model":"'), "event_type", F.lit('"}'))
    return table(spark, sf, "events").select("event_id", public_args(args).alias("args"))


# --- work --------------------------------------------------------------------------


@query(f"""
  WITH g AS (
    SELECT p.i * (SELECT count(*) FROM orders) + o_orderkey AS combo_id,
           CASE p.i WHEN 0 THEN 'Handle ' || o_orderpriority ELSE 'Status ' || o_orderstatus || ' of ' || o_orderpriority
           END AS prompt
    FROM (VALUES (0), (1)) p(i), orders),
  d AS (SELECT prompt, min(combo_id) AS combo_id, count(*) AS combos FROM g GROUP BY prompt)
  SELECT combo_id, prompt, sha1(prompt) AS prompt_hash, combos, r.run_hash, r.run_name
  FROM d, (VALUES ({RUN_A_KEY}, 'first'), ({RUN_B_KEY}, 'second')) r(run_hash, run_name)""")
def distinct_work(spark: SparkSession, sf: str) -> DataFrame:
    orders = group(spark, sf, "orders", "o_orderpriority", "o_orderstatus")
    prompts = {"p": "Handle {{o_orderpriority}}", "s": "Status {{o_orderstatus}} of {{o_orderpriority}}"}
    grid = g.expand(Project(spark, prompts, {"orders": orders}))
    return g.distinct_work(grid, [RUN_A, RUN_B]).select(
        "combo_id", "prompt", "prompt_hash", "combos", "run_hash", "run_name")


@query(f"""
  SELECT combo_id, run_name, run_hash, sha1(prompt) AS prompt_hash
  FROM ({SEGMENT_SQL}), (VALUES ({RUN_A_KEY}, 'first'), ({RUN_B_KEY}, 'second')) r(run_hash, run_name)""")
def grid_runs(spark: SparkSession, sf: str) -> DataFrame:
    return g.work(g.expand(_segments(spark, sf)), [RUN_A, RUN_B]).select(
        "combo_id", "run_name", "run_hash", "prompt_hash")


# --- tables ------------------------------------------------------------------------


@query("SELECT p_partkey AS _ord, p_name, p_size FROM part ORDER BY p_partkey LIMIT 1000")
def truncate_group(spark: SparkSession, sf: str) -> DataFrame:
    return tables.truncate(group(spark, sf, "part", "p_name", "p_size"), 1000)


@query("SELECT min(doc_id) AS _ord, lang, md5(text) AS text FROM documents GROUP BY lang, text")
def dedup_group(spark: SparkSession, sf: str) -> DataFrame:
    kept = tables.remove_duplicates(group(spark, sf, "documents", "lang", "text"))
    return kept.withColumn("text", F.md5("text"))


@query("""SELECT row_number() OVER (ORDER BY first) - 1 AS _ord, lang, source
          FROM (SELECT min(doc_id) AS first, lang, source FROM documents GROUP BY lang, source)""")
def dedup_closed(spark: SparkSession, sf: str) -> DataFrame:
    return tables.close_ordinals(tables.remove_duplicates(group(spark, sf, "documents", "lang", "source")))


@query("SELECT doc_id AS _ord, source AS s FROM documents WHERE lang <> 'en'")
def drop_variable(spark: SparkSession, sf: str) -> DataFrame:
    docs = group(spark, sf, "documents", "text", "lang", "source").select(
        "_ord", "text", F.when(F.col("lang") != "en", F.col("source")).alias("s"))
    return tables.drop_variable(docs, "text")


@query("""SELECT doc_id AS _ord, upper(lang) AS lang, length(text) AS chars,
                 len(string_split(text, ' ')) AS words FROM documents""")
def transform_rows(spark: SparkSession, sf: str) -> DataFrame:
    docs = group(spark, sf, "documents", "text", "lang")
    sized = tables.transform_rows(docs, lambda d: {
        "lang": F.upper("lang"), "chars": F.length("text").cast("long")})
    return tables.transform_rows(
        sized, lambda row: {"words": len(row["text"].split(" "))}, "words bigint").drop("text")


@query("""
  SELECT doc_id AS _ord, CASE WHEN length(text) > 50 THEN left(text, 50) || '...' ELSE text END AS text, lang,
         length(text) + length(lang) AS text_length FROM documents""")
def preview_cells(spark: SparkSession, sf: str) -> DataFrame:
    return tables.preview(group(spark, sf, "documents", "text", "lang"), rows=None)


@query("""SELECT row_number() OVER (ORDER BY lang, n_chars DESC, doc_id) - 1 AS _ord, doc_id, lang, n_chars
          FROM documents""")
def ordered_group(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return with_ordinals(docs, "lang", F.desc("n_chars"), "doc_id")


# --- sources -----------------------------------------------------------------------

PARTS_SQL = """
  SELECT d.doc_id, i AS part, substr(text, (i * 2000 + 1)::bigint, 2000) AS piece, n
  FROM (SELECT *, greatest(1, ceil(length(text) / 2000.0))::bigint AS n FROM documents) d,
       LATERAL (SELECT unnest(generate_series(0, n - 1)) AS i) s
"""


@query(f"""SELECT CASE WHEN n > 1 THEN doc_id || '_part_' || lpad(part::varchar, 3, '0') ELSE doc_id::varchar END AS _id,
                  md5(piece) AS document_text, length(piece) AS document_size FROM ({PARTS_SQL})""")
def split_fixed(spark: SparkSession, sf: str) -> DataFrame:
    parts = files.split_fixed(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", 2000)
    return parts.select("_id", F.md5("document_text").alias("document_text"), "document_size")


@query(f"""SELECT 'first' AS kind, doc_id || '_part_' || lpad(part::varchar, 3, '0') AS _id, length(piece) AS document_size
           FROM ({PARTS_SQL}) WHERE n > 1 AND part < 2
           UNION ALL SELECT 'first', doc_id::varchar, length(piece) FROM ({PARTS_SQL}) WHERE n = 1
           UNION ALL SELECT 'last', doc_id || '_part_' || lpad(part::varchar, 3, '0'), length(piece)
           FROM ({PARTS_SQL}) WHERE n > 1 AND part >= n - 3
           UNION ALL SELECT 'last', doc_id::varchar, length(piece) FROM ({PARTS_SQL}) WHERE n = 1""")
def limit_parts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    first = files.split_fixed(docs, "doc_id", "text", 2000, 2).withColumn("kind", F.lit("first"))
    last = files.split_fixed(docs, "doc_id", "text", 2000, -3).withColumn("kind", F.lit("last"))
    return first.unionByName(last).select("kind", "_id", "document_size")


def _sorted(spark: SparkSession, sf: str, name: str, key: str) -> DataFrame:
    """Rows in key order across part files: four at least, and as many as the table has splits."""
    rows = table(spark, sf, name)
    return rows.repartitionByRange(max(4, rows.rdd.getNumPartitions()), key).sortWithinPartitions(key)


@query("SELECT doc_id AS _ord, doc_id::varchar AS id, lang, CASE WHEN lang = 'en' THEN NULL ELSE source END AS source, "
       "md5(text) AS text FROM documents")
def csv_group(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_dir(spark, "csv")
    rows = _sorted(spark, sf, "documents", "doc_id").select(
        F.col("doc_id").alias("id"), "lang",
        F.when(F.col("lang") == "en", "NA").otherwise(F.col("source")).alias("source"), "text")
    rows.write.option("header", True).option("escape", '"').csv(path)
    return files.read_csv_group(spark, path).withColumn("text", F.md5("text"))


@query("SELECT part_no AS _ord, trim(p_name) AS line FROM (SELECT p_partkey AS part_no, p_name FROM part)")
def lines_group(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_dir(spark, "lines")
    _sorted(spark, sf, "part", "p_partkey").select(
        F.concat(F.lit("  "), "p_name", F.lit("\t ")).alias("value")).write.text(path)
    return files.read_lines_group(spark, path, "line")


@query("""SELECT event_id AS _ord, event_id AS id, event_type AS kind, value::varchar AS value, value > 10 AS large
          FROM events""")
def jsonl_group(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_dir(spark, "jsonl")
    _sorted(spark, sf, "events", "event_id").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "value",
        (F.col("value") > 10).alias("large")).write.json(path)
    return files.read_jsonl_group(spark, path).select("_ord", "id", "kind", "value", "large")


@query("""SELECT event_id AS _ord, event_id AS id, event_type AS kind, value::varchar AS value FROM events""")
def json_group(spark: SparkSession, sf: str) -> DataFrame:
    """Files that each hold one array of a block of events."""
    path = shared_dir(spark, "json")
    row = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "value")
    # each block is a file, and a folder holds those of 256 blocks: every reading lists all folders
    block, folder = F.expr("event_id div 2048").alias("block"), F.lpad(F.expr("block div 256").cast("string"), 12, "0")
    # blocks are few bytes: a number of tasks that is asked for is not made smaller
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = table(spark, sf, "events").select(block, row.alias("row")).groupBy("block").agg(
        F.to_json(F.array_sort(F.collect_list("row"))).alias("value")).withColumn("folder", folder)
    blocks.repartition(tasks, "folder").sortWithinPartitions("folder", "block").select("folder", "value").write.partitionBy(
        "folder").option("maxRecordsPerFile", 1).text(path)
    return files.read_json_group(spark, path).select("_ord", "id", "kind", "value")


@query("""SELECT sum(document_size)::bigint AS chars, count(DISTINCT doc_id) AS documents FROM (
            SELECT doc_id, length(text) + 1 AS document_size FROM documents)""")
def directory_group(spark: SparkSession, sf: str) -> DataFrame:
    """Every document is one line of some text file of the folder."""
    path = shared_dir(spark, "folder")
    flat = _sorted(spark, sf, "documents", "doc_id").select(F.replace("text", F.lit("\n"), F.lit(" ")))
    flat.write.text(path)
    parts = files.read_directory_group(spark, path, split_length=10_000)
    lines = F.length("document_text") - F.length(F.replace("document_text", F.lit("\n"), F.lit("")))
    return parts.agg(F.sum("document_size").alias("chars"), F.sum(lines).cast("long").alias("documents"))


@query("""SELECT page_id, md5('[data:image/png;base64,' || to_base64(encode(html)) || ']') AS image,
                 octet_length(encode(html)) AS image_size FROM pages""")
def image_uri(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        "page_id", F.md5(image_text(F.encode("html", "utf-8"), F.lit("PNG"))).alias("image"),
        F.octet_length("html").cast("long").alias("image_size"))


@query("""
  SELECT page_id, 'See [img01] and [img02] then [img01] of ' || url AS prompt, 3 AS n_images,
         md5('data:image/png;base64,' || to_base64(encode(html))) AS first_image FROM pages""")
def image_split(spark: SparkSession, sf: str) -> DataFrame:
    first = image_text(F.encode("html", "utf-8"), F.lit("png"))
    second = image_text(F.encode("url", "utf-8"), F.lit("webp"))
    pages = table(spark, sf, "pages").select("page_id", F.concat(
        F.lit("See "), first, F.lit(" and "), second, F.lit(" then "), first, F.lit(" of "), "url").alias("p"))
    return pages.select(
        "page_id", without_images(F.col("p")).alias("prompt"), F.size(images(F.col("p"))).alias("n_images"),
        F.md5(F.get(images(F.col("p")), F.lit(0))).alias("first_image"))


PASTED = '''name,key
"Hello, dear",h
"Good ""day""",
NA,n
'''


@query("""SELECT i * (SELECT count(*) FROM customer) + c_custkey AS combo_id,
                 coalesce(name, '') || ' ' || c_name || coalesce(key, '') AS prompt
          FROM (VALUES (0, 'Hello, dear', 'h'), (1, 'Good "day"', NULL), (2, NULL, 'n')) p(i, name, key), customer""")
def pasted_group(spark: SparkSession, sf: str) -> DataFrame:
    """Greetings that a user pasted as CSV, for all customers."""
    project = Project(spark, {"p": "{{name}} {{c_name}}{{key}}"}, {
        "pasted": files.group_from_string(spark, PASTED, "csv"), "customer": group(spark, sf, "customer", "c_name")})
    return g.expand(project).select("combo_id", "prompt")


@query("SELECT c_custkey AS _ord, c_name FROM customer")
def capped_group(spark: SparkSession, sf: str) -> DataFrame:
    """All customers, whose number the caller has allowed."""
    customers = with_ordinals(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey").drop("c_custkey")
    return files.require_max_rows(customers, table(spark, sf, "customer").count())


@query("""SELECT o_orderkey AS _ord, o_orderkey // 2000 AS part, 'order ' || o_orderkey || ' of part ' || o_orderkey // 2000 AS name,
                 o_orderpriority AS priority FROM orders""")
def generated_group(spark: SparkSession, sf: str) -> DataFrame:
    """A user's generator, in as many partitions as the orders need, whose rows then meet the orders."""
    total, size = table(spark, sf, "orders").count(), 2000

    def generate(part: int, parts: int):
        for k in range(part * size, min(total, (part + 1) * size)):
            yield {"name": f"order {k} of part {part}", "part": part}

    made = files.group_from_generator(spark, generate, "name string, part bigint", max(2, -(-total // size)))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("_ord"), F.col("o_orderpriority").alias("priority"))
    return made.join(orders, "_ord").select("_ord", "part", "name", "priority")


def _loaded(spark: SparkSession, sf: str) -> Project:
    """A project file whose group holds the regions, written and loaded."""
    path = shared_dir(spark, "project")
    regions = table(spark, sf, "region").agg(F.to_json(F.sort_array(F.collect_list(
        F.struct(F.col("r_regionkey").alias("key"), F.col("r_name").alias("region"))))).alias("rows"))
    head = '{"metadata":{"file_format_version":"2.0"},"prompts":{"a":"{{region}} has key {{key}}","b":"off {{key}}"},'
    regions.select(F.concat(F.lit(head + '"disabled_prompts":["b"],"parameters":{"regions":'), "rows", F.lit("}}"))
                   ).coalesce(1).write.text(path)
    return Project.load(spark, path)


@query("""SELECT c_custkey AS combo_id, c_custkey * 5 + r_regionkey AS pair, r_name || ' has key ' || r_regionkey AS prompt, c_name
          FROM region, customer""")
def project_load(spark: SparkSession, sf: str) -> DataFrame:
    """The prompts of a loaded project, each for all customers."""
    loaded = g.expand(_loaded(spark, sf)).select(F.col("combo_id").alias("at"), "prompt")
    customers = table(spark, sf, "customer").select("c_custkey", "c_name")
    pairs = customers.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(loaded.count() - 1).cast("long"))))
    return pairs.join(loaded, "at").select(
        F.col("c_custkey").alias("combo_id"), (F.col("c_custkey") * 5 + F.col("at")).alias("pair"), "prompt", "c_name")


@query("""SELECT r_regionkey * (SELECT count(*) FROM part) + p_partkey AS combo_id,
                 r_name || ' has key ' || r_regionkey AS prompt, p_name AS part FROM region, part""")
def project_with_group(spark: SparkSession, sf: str) -> DataFrame:
    """The loaded project with a further group of all parts."""
    parts = with_ordinals(table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey").drop("p_partkey")
    grid = g.expand(_loaded(spark, sf).with_group("parts", parts))
    return grid.select("combo_id", "prompt", F.col("args")["p_name"].alias("part"))


@query("""SELECT r_regionkey * (SELECT count(*) FROM part) + p_partkey AS combo_id, r_name || ' sells ' || p_name AS prompt
          FROM region, part""")
def report_project(spark: SparkSession, sf: str) -> DataFrame:
    """A project opened from a report package, with its groups."""
    project = Project(spark, {"p": "{{r_name}} sells {{p_name}}"}, {
        "region": group(spark, sf, "region", "r_name"), "part": group(spark, sf, "part", "p_name")})
    path = shared_dir(spark, "package")
    write_report({"prompts": table(spark, sf, "region")}, path, project=project_json(project), groups=project.groups)
    return g.expand(read_report_project(spark, path)).select("combo_id", "prompt")
