"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Every measure is a Spark expression over one text, so the verdict needs no shuffle and no user
function. A null text counts as empty, has no words and fails the length rule. Repeated rows
each get their own result; extra columns of the input are never read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptframe.llm.registry import BLANKS, NOT_BLANK, query, table, text_or_empty

# Frequent function words of the languages the rules expect.
STOP_WORDS = """
a an and are as at be by for from has have he her his i in is it its not of on or she that the
their they this to was we were which will with you
au aux avec ce ces dans de des du elle en est et il la le les leur mais ne nous on ou par pas pour
que qui se ses son sur un une vous
aber als auch auf aus bei das dem den der die durch ein eine einen er es für hat ich im ist mit
nach nicht sich sie sind und von war wie wird zu zum zur über
al como con del el ella ellos era fue ha las lo los más muy no para pero por sin sobre su sus y
""".split()
#: The languages that the function words are of, in the order of the lines above.
STOP_LANGUAGES = ("en", "fr", "de", "es")
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A text passes while ``low <= measure <= high``; an open side is None."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The base rules: at least 50 words, at most half of them inside repeated three-word windows.
BASE = (Rule("n_words", low=50), Rule("repeat_word_ratio", high=0.5))
#: The further rules of the default table.
RULES = (
    Rule("mean_word_chars", low=1.5, high=30),
    Rule("symbol_ratio", high=0.1),
    Rule("stop_word_ratio", low=0.04),
    Rule("dup_line_ratio", high=0.5),
    Rule("shouted_ratio", high=0.5),
)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep=None) -> DataFrame:
    """``id_col`` (or the columns given as ``keep``) and all measures of each row's text."""
    keep = [F.col(id_col)] if keep is None else keep
    names = [c for c in docs.select(*keep).columns]
    text = docs.select(*keep, text_or_empty(text_col).alias("_t"))
    bare = lambda c: F.translate(c, BLANKS, "")
    split = text.select(
        *names,
        F.array_remove(F.split(F.translate("_t", BLANKS, " " * len(BLANKS)), " "), "").alias("_words"),
        F.filter(F.split("_t", "\n"), lambda x: F.length(bare(x)) > 0).alias("_lines"),
        F.length(bare(F.col("_t"))).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"))
    words = F.col("_words")
    # windows by digest first: a text whose digests all differ repeats nothing
    hashed = split.select(
        "*",
        F.size(words).cast("long").alias("n_words"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.filter(words, lambda w: F.lower(F.regexp_replace(w, r"[.,;:!?]+$", "")).isin(STOP_WORDS)))
        .cast("long").alias("n_stop_words"),
        F.size(F.filter(words, lambda w: (F.upper(w) == w) & (F.lower(w) != w))).cast("long").alias("n_shouted"),
        F.when(F.size(words) >= 3, F.transform(
            F.sequence(F.lit(0), F.size(words) - 3),
            lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).alias("_digests"))
    window = lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    ordered = hashed.select("*", F.when(
        F.size(F.array_distinct("_digests")) < F.size("_digests"),
        F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3),
                                 lambda i: F.struct(window(i).alias("w"), i.alias("i"))))).alias("_ordered"))
    at = lambda k: F.get(F.col("_ordered"), k)["w"]
    found = ordered.select("*", F.sort_array(F.transform(
        F.filter("_ordered", lambda x, k: (x["w"] == at(k - 1)) | F.coalesce(x["w"] == at(k + 1), F.lit(False))),
        lambda x: x["i"])).alias("_found"))
    repeated = F.aggregate(
        F.transform("_found", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_found", k + 1), p + 3) - p)),
        F.lit(0), lambda a, b: a + b)
    counted = found.select("*", F.coalesce(repeated, F.lit(0)).cast("long").alias("n_repeat_words"))
    share = lambda part, whole: F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))
    return counted.select(
        *names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("n_repeat_words", "n_words").alias("repeat_word_ratio"),
        share("word_chars", "n_words").alias("mean_word_chars"),
        share("n_symbols", "n_words").alias("symbol_ratio"),
        share("n_stop_words", "n_words").alias("stop_word_ratio"),
        share("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        share("n_shouted", "n_words").alias("shouted_ratio"))


def passes(rules) -> Column:
    """The conjunction of a rule table over the columns of ``measures``."""
    sides = [F.col(r.measure) >= r.low for r in rules if r.low is not None]
    sides += [F.col(r.measure) <= r.high for r in rules if r.high is not None]
    return reduce(and_, sides, F.lit(True))


def failed_rules(rules) -> Column:
    """Names of the measures that are out of bounds."""
    return F.array_compact(F.array(*[F.when(~passes([r]), F.lit(r.measure)) for r in rules]))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, rules=RULES,
          keep=None) -> DataFrame:
    """Measures of every text with ``base_failed``, ``kept`` and the names of failed rules."""
    out = measures(docs, id_col, text_col, keep).withColumn("base_failed", ~passes(base))
    # a filter on a pure column would be pushed below the projections, which puts every array that
    # they compute once into each place of its use; a row number, always true here, keeps the filter above them
    return out.withColumn("kept", ~F.col("base_failed") & passes(rules) & (F.monotonically_increasing_id() >= 0)).withColumn(
        "failed", failed_rules([*base, *rules]))


def keep_good(docs: DataFrame, text_col: str = "text", base=BASE, rules=RULES, lang_col: str | None = None) -> DataFrame:
    """The rows whose text passes all rules, with the columns they came with.

    With ``lang_col``, rules on stop words hold only for rows of a language that has a list (``en-GB``
    counts as ``en``) and for rows without a language.
    """
    whole = docs.select(F.struct("*").alias("_row"))
    judged = judge(whole.select("_row", F.col(f"_row.`{text_col}`").alias("_text")), text_col="_text",
                   base=base, rules=rules, keep=[F.col("_row")])
    kept = F.col("kept")
    if lang_col is not None:
        language = F.lower(F.regexp_extract(F.col(f"_row.`{lang_col}`").cast("string"), "^[^-_]*", 0))
        listed = F.coalesce(language.isin(*STOP_LANGUAGES), F.lit(True))
        on_stop_words = F.lit("stop_word_ratio")
        kept = F.size(F.when(listed, F.col("failed")).otherwise(F.array_remove("failed", on_stop_words))) == 0
        # see judge: keeps this filter above the projections
        kept = kept & (F.monotonically_increasing_id() >= 0)
    return judged.withColumn("kept", kept).filter("kept").select("_row.*")


_SHARE = "coalesce({} / nullif({}, 0), 0)"
_SQL_RULES = " AND ".join(
    f"{r.measure} {sign} {bound}" for r in RULES
    for sign, bound in ((">=", r.low), ("<=", r.high)) if bound is not None)

SQL = rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{NOT_BLANK}+') AS ws,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '{NOT_BLANK}')] AS ls
  FROM documents),
windows AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM split)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
counted AS (
  SELECT doc_id, len(ws) AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines,
         coalesce(n, 0) AS n_repeat_words,
         len([w FOR w IN ws IF list_contains({STOP_WORDS!r}, lower(regexp_replace(w, '[.,;:!?]+$', '')))]) AS n_stop,
         len([w FOR w IN ws IF upper(w) = w AND lower(w) <> w]) AS n_shouted
  FROM split LEFT JOIN covered USING (doc_id)),
ratios AS (
  SELECT *, {_SHARE.format("n_repeat_words", "n_words")} AS repeat_word_ratio,
         {_SHARE.format("word_chars", "n_words")} AS mean_word_chars,
         {_SHARE.format("n_symbols", "n_words")} AS symbol_ratio,
         {_SHARE.format("n_stop", "n_words")} AS stop_word_ratio,
         {_SHARE.format("n_dup_lines", "n_lines")} AS dup_line_ratio,
         {_SHARE.format("n_shouted", "n_words")} AS shouted_ratio
  FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {_SQL_RULES} AS kept
FROM ratios
"""


@query(SQL)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
