"""Secret scans: spans found by pattern, judged by how widely their values are owned.

Patterns find candidate spans in every whole text. Over the corpus each distinct value is counted
by distinct repositories and owners: a value many owners hold is a copied example, one that a
single owner holds looks live. Long mixed tokens outside the patterns' spans are only reported
when they look random, do not stand inside an address, and a single owner holds them. A token looks
random when its characters change between lower case, upper case and digits (rises to upper case,
and both ways between letters and digits) far more often than in words, paths and identifiers.
With fewer owners than ``example_owners`` in the corpus no value can be an example. Everything is
DataFrame functions.

A null text has no spans; null owners and repositories count as one unknown owner. Repeated rows
(same id and text) are one document whose spans are found once, and each row gets them; rows that
share an id but not a text keep their own spans. Extra columns are never read by ``spans`` and are
kept by ``mask``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptframe.llm.registry import query, table, text_or_empty, written


@dataclass(frozen=True)
class Kind:
    """A pattern; the value is ``group`` and needs ``least`` characters, else the match drops, and
    ``mixed`` changes between kinds of characters for each of its places."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0
    mixed: float = 0.0


# The patterns of the base kinds, in the order that breaks ties of spans.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE = (Kind("assign", ASSIGN, 2, 6), Kind("access", ACCESS), Kind("hex", HEX))
#: Whole runs of 20 and more token characters that mix lower case, upper case and digits, and do not
#: go on from an address; reported only where a single owner holds them.
_RUN = "[A-Za-z0-9+/_-]"
_ADDRESS = "[.:@?&=%~]"
OWNED = Kind("owned", f"(?<!{_RUN}|{_ADDRESS})(?={_RUN}*[0-9])(?={_RUN}*[a-z])(?={_RUN}*[A-Z]){_RUN}{{20,}}", mixed=0.27)
#: The characters of a token by kind, and the changes that count.
_KINDS = ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "l" * 26 + "u" * 26 + "d" * 10)
_CHANGES = ("lu", "ld", "ud", "dl", "du")
#: A value that this many owners hold is a copied example.
EXAMPLE_OWNERS = 3
MASK = "[SECRET]"


def changes(value: Column) -> Column:
    """How often a token changes between kinds of characters, of the changes that count."""
    kinds = F.translate(value, *_KINDS)
    # the two signs of a change differ, so no two matches of it overlap
    found = [(F.length(kinds) - F.length(F.replace(kinds, F.lit(c), F.lit("")))) / 2 for c in _CHANGES]
    return reduce(add, found)


def _matches(text: Column, rank: int, kind: Kind) -> Column:
    """For each match in order: the length of the text since the last one, its own, its value."""
    fixed = F.struct(F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), F.lit(kind.least).alias("least"),
                     F.lit(float(kind.mixed)).alias("mixed"))
    zipped = F.arrays_zip(
        F.transform(F.split(text, kind.pattern, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), F.length).alias("size"),
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group)).alias("value"))
    # the text after the last match has no match of its own
    return F.when(text.rlike(kind.pattern), F.transform(
        F.filter(zipped, lambda m: m["size"].isNotNull()),
        lambda m, k: F.struct(fixed.alias("of"), k.alias("place"), m["gap"].alias("gap"), m["size"].alias("size"),
                              m["value"].alias("value"))))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository: Column | None = None,
               owner: Column | None = None, kinds=BASE, owned: Kind | None = OWNED) -> DataFrame:
    """Candidate spans: id, key, repository, owner, rank, kind, start, end, value.

    ``key`` with the id names the document by its text; places are code points, end exclusive.
    """
    kinds = [*kinds, *([owned] if owned else [])]
    text = F.col("text")
    rows = docs.select(
        docs[id_col].alias("id"), text_or_empty(text_col).alias("text"),
        F.coalesce((F.lit(None) if repository is None else repository).cast("string"), F.lit("")).alias("repository"),
        F.coalesce((F.lit(None) if owner is None else owner).cast("string"), F.lit("")).alias("owner"))
    found = rows.select("id", F.xxhash64(text).alias("key"), "repository", "owner", F.array_compact(F.array(
        *[_matches(text, n, k) for n, k in enumerate(kinds)])).alias("matches"))
    document = ["id", "key", "repository", "owner"]
    found = found.filter(F.size("matches") > 0).dropDuplicates(document)
    one = found.select(*document, F.explode(F.flatten("matches")).alias("m")).select(*document, "m.*")
    so_far = Window.partitionBy(*document, "of").orderBy("place")
    end = F.sum(F.col("gap") + F.col("size")).over(so_far)
    placed = one.withColumn("end", end.cast("long")).filter(F.length("value") >= F.col("of.least"))
    random = changes(F.col("value")) >= F.col("of.mixed") * (F.length("value") - 1)
    placed = placed.filter((F.col("of.mixed") == 0) | random)
    return placed.select(*document, "of.rank", "of.kind", (F.col("end") - F.col("size")).alias("start"), "end", "value")


def judged(spans: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """``spans`` with the repositories and owners that hold the value, and ``status``."""
    hashed = spans.withColumn("value_sha256", F.sha2("value", 256))
    # a value copied by a third of all rows is one row per repository, owner and task here
    held = hashed.groupBy("value_sha256", "repository", "owner").agg(F.count("*").alias("n"))
    owned = held.groupBy("value_sha256").agg(
        F.sum("n").alias("n_spans"), F.count_distinct("repository").alias("n_repositories"),
        F.count_distinct("owner").alias("n_owners"))
    status = F.when(F.col("n_owners") >= example_owners, "example").otherwise("live")
    return hashed.join(owned, "value_sha256").withColumn("status", status)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository: Column | None = None,
         owner: Column | None = None, kinds=BASE, owned: Kind | None = OWNED,
         example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row per span of a document: id, key, rank, kind, start, end, value, the counts of its
    value's holders and status. Spans of ``owned`` have one owner and overlap no other kind."""
    spans = written(candidates(docs, id_col, text_col, repository, owner, kinds, owned), "secret-spans")
    by_doc = Window.partitionBy("id", "key").orderBy("start", "rank")
    of_kind = F.col("rank") < len(kinds)
    before = F.max(F.when(of_kind, F.col("end"))).over(by_doc.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(of_kind, F.col("start"))).over(by_doc.rowsBetween(0, Window.unboundedFollowing))
    free = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    placed = spans.withColumn("free", free)
    every = judged(placed, example_owners)
    return every.filter(of_kind | (F.col("free") & (F.col("n_owners") == 1))).drop("free", "repository", "owner")


def by_document(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id column, and ``spans`` sorted by start and kind."""
    rows = docs.select(docs[id_col].alias(id_col), F.xxhash64(text_or_empty(text_col)).alias("_key"))
    grouped = spans.groupBy(F.col("id").alias("_id"), F.col("key").alias("_of")).agg(F.sort_array(F.collect_set(
        F.struct("start", "rank", "end", "kind", "status", F.length("value").alias("size")))).alias("spans"))
    same = rows[id_col].eqNullSafe(grouped["_id"]) & (rows["_key"] == grouped["_of"])
    return rows.join(grouped, same, "left").select(id_col, F.coalesce("spans", F.array()).alias("spans"))


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository: Column | None = None,
         owner: Column | None = None, kinds=BASE, owned: Kind | None = OWNED,
         example_owners: int = EXAMPLE_OWNERS, put: str = MASK) -> DataFrame:
    """``docs`` with the values of live spans masked in the text; examples stay.

    Only rows with a candidate meet the spans in a join; the others pass as they are.
    """
    live = scan(docs, id_col, text_col, repository, owner, kinds, owned, example_owners).filter("status = 'live'")
    grouped = live.groupBy("id", "key").agg(F.sort_array(F.collect_set(F.struct(
        (F.col("end") - F.length("value")).alias("start"), F.col("end")))).alias("spans"))
    whole = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    hit = F.col("_text").rlike("|".join(f"(?:{k.pattern})" for k in [*kinds, *([owned] if owned else [])]))
    met = whole.filter(hit).withColumn("_key", F.xxhash64("_text"))
    same = met["_id"].eqNullSafe(grouped["id"]) & (met["_key"] == grouped["key"])

    def put_mask(done, span):
        gap = F.substring(F.col("_text"), done["at"] + 1, F.greatest(span["start"] - done["at"], F.lit(0)))
        start = F.struct(span["end"].cast("int").alias("at"), F.concat(done["out"], gap, F.lit(put)).alias("out"))
        inside = F.struct(F.greatest(span["end"].cast("int"), done["at"]).alias("at"), done["out"].alias("out"))
        return F.when(span["start"] >= done["at"], start).otherwise(inside)

    # spans inside the last one are covered by its mask
    spans = F.transform("spans", lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].alias("end")))
    text = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), put_mask,
        lambda done: F.concat(done["out"], F.substring(F.col("_text"), done["at"] + 1, F.length("_text"))))
    masked = met.join(grouped, same, "left").select(
        F.when(F.col("spans").isNull(), F.col("_row")).otherwise(F.col("_row").withField(text_col, text)).alias("_row"))
    return masked.unionByName(whole.filter(~hit).select("_row")).select("_row.*")


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _sql_matches(kind: str, pattern: str, group: int, rank: int, where: str) -> str:
    pattern = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, source, lang, {rank} AS rank, '{kind}' AS kind, e - size AS s, e, value FROM (
    SELECT *, sum(gap + size) OVER (PARTITION BY doc_id ORDER BY place) AS e FROM (
      SELECT doc_id, source, lang, generate_subscripts(ms, 1) AS place, length(unnest(ms)) AS size,
             unnest(vs) AS value, unnest([length(x) FOR x IN string_split_regex(t, '{pattern}')][:len(ms)]) AS gap
      FROM (SELECT doc_id, source, lang, coalesce(text, '') AS t,
                   regexp_extract_all(coalesce(text, ''), '{pattern}') AS ms,
                   regexp_extract_all(coalesce(text, ''), '{pattern}', {group}) AS vs FROM documents)))
  WHERE {where}"""


_SQL_KINDS = f"translate(value, '{_KINDS[0]}', '{_KINDS[1]}')"
_SQL_CHANGES = "(" + " + ".join(f"(length({_SQL_KINDS}) - length(replace({_SQL_KINDS}, '{c}', ''))) / 2" for c in _CHANGES) + ")"

SQL = f"""
WITH spans AS ({" UNION ALL ".join([
    _sql_matches("assign", ASSIGN, 2, 0, "length(value) >= 6"), _sql_matches("access", ACCESS, 0, 1, "true"),
    _sql_matches("hex", HEX, 0, 2, "true"),
    _sql_matches("owned", _ADDRESS + "?" + _RUN + "{20,}", 0, 3, "regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') "
                 f"AND regexp_matches(value, '[A-Z]') AND NOT regexp_matches(value, '^{_ADDRESS}') "
                 f"AND {_SQL_CHANGES} >= {OWNED.mixed} * (length(value) - 1)")])}),
owners AS (SELECT value, count(DISTINCT coalesce(source, '')) AS n_owners FROM spans GROUP BY value),
kept AS (
  SELECT a.*, n_owners FROM spans a JOIN owners USING (value)
  WHERE rank < 3 OR n_owners = 1 AND NOT EXISTS (
    SELECT 1 FROM spans b WHERE b.doc_id = a.doc_id AND b.rank < 3 AND b.s < a.e AND a.s < b.e)),
grouped AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access,
         count(*) FILTER (rank = 2) AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans,
         count(*) FILTER (n_owners < {EXAMPLE_OWNERS}) AS n_live
  FROM kept GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM documents LEFT JOIN grouped USING (doc_id)
"""


@query(SQL)
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; sources are owners, and a source's languages its repositories."""
    docs = table(spark, sf_dir, "documents")
    spans = scan(docs, repository=F.concat_ws("/", "source", "lang"), owner=F.col("source"))
    found = by_document(docs, spans)

    def count(field: str, value) -> Column:
        return F.size(F.filter("spans", lambda s: s[field] == value)).cast("long")

    return found.select(
        "doc_id", *[count("rank", n).alias(f"n_{k.name}") for n, k in enumerate(BASE)],
        F.sha2(_digest(F.filter("spans", lambda s: s["rank"] < len(BASE))), 256).alias("base_sha256"),
        _digest(F.col("spans")).alias("spans"), count("status", "live").alias("n_live"))
