"""Shards of near equal bytes by sampled splitters.

Records are put in one total order: by key, then by the digest of their id, then by row. A sample of
the records, drawn with chances by their size, gives splitters at its quantiles, which cut the order
into many ranges; their true bytes and rows are then counted. A range that is overfull (it holds more
than twice its share of bytes or rows, or the place where a shard has to end with more than the
tolerance around it) is subdivided by a new sample of its own records, and so on until none is left or
a range is a single record. The default key is the digest of the text, so equal texts lie side by
side, and a group of copies that is larger than a range is subdivided by id, and by row where ids are
the same, too. Shards are runs of whole ranges, each ended where its bytes come nearest to its share;
a record's slot is the number of records before its range in the shard, and its place in the range.

Only splitters and counts of ranges reach the driver: ``ranges`` of each shard and one for every
``range_rows`` rows. The records are written once, thin, so that every round sees the same rows.

A null text has the bytes of an empty one, and a null id or key takes part as any other. Repeated
rows are records of their own. A record larger than a shard's share is never cut, so some shards may
stay empty. An empty table has no records. Extra columns are only read where ``keep`` names them.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptframe.llm.registry import query, table, text_or_empty, written


@dataclass(frozen=True)
class Settings:
    """Parameters of the splitters."""

    #: Ranges of a shard, at least.
    ranges: int = 16
    #: Rows that a range shall hold at most.
    range_rows: int = 1_000_000
    #: Records drawn for a range.
    drawn: int = 8
    #: Part of a shard's bytes by which its end may miss its place.
    tolerance: float = 0.002


SETTINGS = Settings()
#: Bytes of a record beside its text.
OVERHEAD = 16
_PLACE = ("_key", "_tie", "_row")


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None,
            keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep``, size, text_crc32 and the place in the order (_key, _tie, _row), written."""
    text = text_or_empty(text_col)
    placed = docs.select(
        *keep, (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.coalesce(F.xxhash64(text) if key is None else key.cast("long"), F.lit(0).cast("long")).alias("_key"),
        F.xxhash64(F.col(id_col)).alias("_tie"), F.monotonically_increasing_id().alias("_row"))
    return written(placed, "shard-records")


def _range_of(splitters: list[tuple[int, int, int]]) -> Column:
    """The number of splitters that a record's place is not before, by bisection."""
    if not splitters:
        return F.lit(0)
    # one constant of the plan: the order of structs is that of tuples
    bounds = F.from_json(F.lit(json.dumps([dict(zip("abc", s, strict=True)) for s in splitters])),
                         "array<struct<a:bigint,b:bigint,c:bigint>>")
    own = F.struct(*[F.col(c).alias(n) for c, n in zip(_PLACE, "abc", strict=True)])
    steps = [1 << k for k in range(len(splitters).bit_length() - 1, -1, -1)]

    def step(at, size):
        return at + F.when(F.get(bounds, at + size - 1) <= own, size).otherwise(0)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def _drawn(rows: DataFrame, rate: Column, draw: int) -> list[tuple[tuple[int, int, int], float]]:
    """Places of records drawn with chance size * rate, in order, each with the bytes it stands for."""
    chance = F.col("size") * rate
    # a digest of the place, not a random number: a task that runs again draws the same records
    luck = F.xxhash64(*_PLACE, F.lit(draw)).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
    drawn = rows.filter(luck < chance).select(*_PLACE, (F.col("size") / F.least(chance, F.lit(1.0))).alias("weight"))
    return sorted(((r["_key"], r["_tie"], r["_row"]), r["weight"]) for r in drawn.collect())


def _quantiles(drawn: list[tuple[tuple[int, int, int], float]], parts: int) -> list[tuple[int, int, int]]:
    """Places that cut the drawn records into at most ``parts`` of equal weight."""
    total, out, so_far = sum(w for _, w in drawn), [], 0.0
    for place, weight in drawn:
        if out and place == out[-1]:
            continue
        if so_far >= (len(out) + 1) * total / parts and len(out) < parts - 1:
            out.append(place)
        so_far += weight
    return out


def _nearest(ends: list[int], goal: float) -> int:
    """The number of ranges whose end (rising) comes nearest to the goal; 0 for none."""
    k = bisect_right(ends, goal)
    below = ends[k - 1] if k else 0
    return k + 1 if k < len(ends) and ends[k] - goal < goal - below else k


@dataclass
class Ranges:
    """Splitters, with what lies in each range between them."""

    splitters: list[tuple[int, int, int]]
    bytes: list[int]
    rows: list[int]
    largest: list[int]


def _counted(rows: DataFrame, splitters: list[tuple[int, int, int]]) -> Ranges:
    """The true contents of every range."""
    counted = {r["_range"]: r for r in rows.groupBy(_range_of(splitters).alias("_range")).agg(
        F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.max("size").alias("largest")).collect()}
    of = lambda name: [counted[k][name] if k in counted else 0 for k in range(len(splitters) + 1)]
    return Ranges(splitters, of("bytes"), of("rows"), of("largest"))


def _overfull(found: Ranges, shards: int, parts: int, settings: Settings) -> dict[int, int]:
    """The ranges to subdivide, each with the number of its parts."""
    total, out, before = sum(found.bytes), {}, 0
    share, least = total / shards, settings.tolerance * total / shards
    for k, (size, n, largest) in enumerate(zip(found.bytes, found.rows, found.largest, strict=True)):
        ends_shard = int((before + size) / share) > int(before / share) and before + size < total
        before += size
        # the largest record stays whole, so only what lies around it can be divided
        if ends_shard and size - largest > least:
            out[k] = min(64, 1 + int(size / least))
        elif size - largest > 2 * total / parts or n > 2 * settings.range_rows:
            out[k] = 1 + int(size * parts / total) + n // settings.range_rows
    return out


def split(rows: DataFrame, shards: int, settings: Settings = SETTINGS) -> Ranges:
    """Ranges of ``records`` that are fine enough to be dealt to shards."""
    found = _counted(rows, [])
    if not found.rows[0]:
        return found
    parts = max(settings.ranges * shards, -(-found.rows[0] // settings.range_rows))
    overfull, draw = {0: parts}, 0
    while overfull:
        # every overfull range has its own rate, by what lies around its largest record
        rates = [0.0] * len(found.bytes)
        for k, n in overfull.items():
            rates[k] = settings.drawn * n / max(1, found.bytes[k] - found.largest[k])
        rate = F.get(F.from_json(F.lit(json.dumps(rates)), "array<double>"), _range_of(found.splitters))
        drawn = _drawn(rows.withColumn("_rate", rate).filter("_rate > 0"), F.col("_rate"), draw)
        new = set(found.splitters)
        for k, n in overfull.items():
            # a range begins at its splitter, which can not cut it again
            low = bisect_right(drawn, (found.splitters[k - 1], float("inf"))) if k else 0
            high = bisect_left(drawn, (found.splitters[k],)) if k < len(found.splitters) else len(drawn)
            own = drawn[low:high]
            new.update(_quantiles(own, n) or [place for place, _ in own[len(own) // 2:len(own) // 2 + 1]])
        if len(new) > len(found.splitters):
            found = _counted(rows, sorted(new))
            overfull = _overfull(found, shards, parts, settings)
        draw += 1
    return found


def assign(rows: DataFrame, shards: int, settings: Settings = SETTINGS) -> DataFrame:
    """``records`` with shard and slot in place of the place in the order."""
    found = split(rows, shards, settings)
    total, ends, before = sum(found.bytes), [], 0
    for size in found.bytes:
        before += size
        ends.append(before)
    cuts = [_nearest(ends, total * s / shards) for s in range(1, shards)]
    shard = [bisect_right(cuts, k) for k in range(len(ends))]
    first, so_far = [], 0
    for k, n in enumerate(found.rows):
        so_far = 0 if k and shard[k] != shard[k - 1] else so_far
        first.append(so_far)
        so_far += n
    told = lambda values, kind: F.get(F.from_json(F.lit(json.dumps(values)), f"array<{kind}>"), F.col("_range"))
    placed = rows.withColumn("_range", _range_of(found.splitters))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*_PLACE))
    return placed.withColumn("_in", inside).select(
        *[c for c in rows.columns if c not in _PLACE], told(shard, "int").alias("shard"),
        (told(first, "bigint") + F.col("_in") - 1).cast("long").alias("slot"))


@query()
def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 40 of near equal bytes, and its slot there."""
    placed = assign(records(table(spark, sf_dir, "documents")), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
