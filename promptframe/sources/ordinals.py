"""Dense row numbers: a parameter table is an ordered list, a DataFrame is not.

Every group carries ``_ord``, 0..n-1 in list order. It is derived from where a row
lies (file, block, position), so no global sort and no single-task window over the
rows is needed: only the per-block row counts are summed up. Places that another reading
could change are written down first.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from promptframe.session import shared_dir

ORD = "_ord"


def dense_ordinals(df: DataFrame, block: list[str], position: str, sizes: DataFrame | None = None) -> DataFrame:
    """Replace block columns and in-block position by ``_ord``.

    Blocks are ordered by their columns; positions of a block are consecutive from any
    start. Both must be values of the data, such as a file's row index or columns of a
    written table: the rows are read once for the counts and again for the result.

    Blocks are sorted by ranges into buckets, one for each shuffle partition: the rows before a bucket
    are a few numbers of the plan, those before a block inside its bucket a window over that bucket.
    A row finds its block by a join on the block's own columns, so any number of files will do.

    ``sizes``, blocks with their rows ``_n`` of positions from 0 on, saves the reading for the counts.
    """
    spark = df.sparkSession
    counts = sizes.select(*block, F.lit(0).cast("long").alias("_first"), "_n") if sizes is not None else df.groupBy(*block).agg(F.min(position).alias("_first"), F.count(F.lit(1)).alias("_n"))
    buckets, path = int(spark.conf.get("spark.sql.shuffle.partitions")), shared_dir(spark, "blocks")
    counts.repartitionByRange(buckets, *block).sortWithinPartitions(*block).withColumn(
        "_bucket", F.spark_partition_id()).write.parquet(path)
    placed = spark.read.schema(counts.schema.add("_bucket", "integer")).parquet(path)
    starts, sums = [0] * buckets, {r["_bucket"]: r["n"] for r in placed.groupBy("_bucket").agg(F.sum("_n").alias("n")).collect()}
    for k in range(1, buckets):
        starts[k] = starts[k - 1] + sums.get(k - 1, 0)
    start = F.get(F.from_json(F.lit(json.dumps(starts)), "array<bigint>"), F.col("_bucket"))
    before = Window.partitionBy("_bucket").orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    shift = start + F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")
    shifts = placed.select(*[F.col(c).alias(f"_of{c}") for c in block], shift.alias("_shift"))
    kept = [c for c in df.columns if c not in (*block, position)]
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of{c}")) for c in block])
    return df.join(shifts, same).select(
        (F.col(position) + F.col("_shift")).alias(ORD), *[F.col(f"`{c}`") for c in kept])


def file_order(path: Column) -> list[Column]:
    """Sort key of a file: folder, number of a Spark part file, name."""
    name = F.element_at(F.split(path, "/"), -1)
    part = F.regexp_extract(name, r"^part-(\d+)", 1)
    return [
        F.substring(path, F.lit(1), F.length(path) - F.length(name)).alias("_dir"),
        F.when(part != "", part.cast("long")).otherwise(-1).alias("_part"),
        name.alias("_name"),
    ]


def scanned_ordinals(scan: DataFrame, columns: list[Column]) -> DataFrame:
    """``_ord`` for rows of a text-like file scan, in file and line order.

    How files are split depends on the cores at hand, which may change between two readings.
    So the rows are written once, with their split and place, and numbered from that table.
    """
    path = shared_dir(scan.sparkSession, "rows")
    scan.select(
        *file_order(F.col("_metadata.file_path")),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
        *columns).write.parquet(path)
    return dense_ordinals(scan.sparkSession.read.parquet(path), ["_dir", "_part", "_name", "_block"], "_at")


def read_parquet_group(spark: SparkSession, path: str) -> DataFrame:
    """Parquet table as a group, rows in file order; no shuffle of the rows."""
    df = spark.read.parquet(path)
    columns = [F.col(f"`{c}`") for c in df.columns if c != ORD]
    at = F.col("_metadata.row_index")
    if len(df.inputFiles()) == 1:
        return df.select(at.alias(ORD), *columns)
    placed = df.select(*file_order(F.col("_metadata.file_path")), at.alias("_at"), *columns)
    return dense_ordinals(placed, ["_dir", "_part", "_name"], "_at")


def with_ordinals(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Any DataFrame as a group, ordered by ``keys``.

    The rows are range-sorted once into a table in the shared folder; their place
    in that table is the ordinal, so it does not change when a task is repeated. Equal
    keys stay in the order they come in, which also lets a frequent key be split.
    """
    spark = df.sparkSession
    path = shared_dir(spark, "ordinals")
    placed = df.withColumn("_tie", F.monotonically_increasing_id())
    placed.orderBy(*keys, "_tie").drop("_tie", ORD).write.parquet(path)
    return read_parquet_group(spark, path)
