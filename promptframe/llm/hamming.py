"""Exact top-k search of binary codes by incremental multi-index hashing.

A vector's code has one bit per dimension (set where the value is above zero), cut into segments of
16 bits. Codes are indexed by every segment. A search looks up, for radius 0, 1, 2, ..., all
segment values at exactly that distance from its own, verifies the codes found, and ends for a
query once its k-th best distance is covered: after radius s in all m segments every code within
m (s + 1) - 1 has been seen. Each round joins the probes of the unfinished queries with the index.

Equal codes are one entry that holds the smallest ids, as many as a result can use. Results are
ordered by distance and then id; a query does not find itself. Rows without an id or without a
vector, and vectors with a null value, are neither queries nor results; vectors of different length
never meet. A table of fewer rows gives shorter lists. Repeated rows are one. Extra columns are
never read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptframe.llm.registry import query, table, written

SEGMENT = 16


def code_of(vector: Column) -> Column:
    """Segments of the sign code, lowest dimension first; null for a null or incomplete vector."""
    bits = F.transform(vector, lambda x, i: F.when(
        x > 0, F.call_function("shiftleft", F.lit(1), (i % SEGMENT).cast("int"))).otherwise(0))
    segments = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(vector) - 1) / SEGMENT).cast("int")),
        lambda s: F.aggregate(F.slice(bits, s * SEGMENT + 1, SEGMENT), F.lit(0), lambda a, b: a + b))
    whole = (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull())
    return F.when(whole, segments)


def _distances(a: str, b: str) -> Column:
    return F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))


def _best(rows: DataFrame, keep: int) -> DataFrame:
    """The first rows of every query by distance and id, thinned before the shuffle."""
    order = Window.partitionBy("query").orderBy("distance", "id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def search(base: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, neighbor_id and distance of the k nearest rows of ``base`` for each query row."""
    coded = lambda df: df.select(
        df[id_col].alias("id"), F.size(df[vector_col]).alias("dims"), code_of(df[vector_col]).alias("code")
    ).filter("id IS NOT NULL AND code IS NOT NULL")
    keep = k + 1  # a query may find itself
    by_code = Window.partitionBy("dims", "code").orderBy("id")
    smallest = coded(base).distinct().withColumn("_n", F.row_number().over(by_code)).filter(F.col("_n") <= keep)
    index = written(smallest.groupBy("dims", "code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "hamming-index")
    postings = index.select("dims", "code", "ids", F.posexplode("code").alias("segment", "value"))
    asked = written(coded(queries).distinct(), "hamming-queries")
    codes = asked.select("dims", "code").distinct().select(
        "dims", F.col("code").alias("query_code"), F.xxhash64("dims", "code").alias("query"))
    open_codes, found, done = codes, None, None
    for radius in range(SEGMENT + 1):
        masks = [sum(1 << b for b in bits) for bits in combinations(range(SEGMENT), radius)]
        probes = open_codes.select("dims", "query", "query_code", F.posexplode("query_code").alias("segment", "_own"))
        probes = probes.withColumn("mask", F.explode(F.array(*map(F.lit, masks)) if len(masks) < 500 else
                                                     F.filter(F.sequence(F.lit(0), F.lit((1 << SEGMENT) - 1)),
                                                              lambda x: F.bit_count(x) == radius)))
        probes = probes.withColumn("value", F.col("_own").bitwiseXOR(F.col("mask"))).drop("mask", "_own")
        # probes are many more than their source's size says: neither side may be broadcast
        met = probes.join(postings.hint("merge"), ["dims", "segment", "value"]).withColumn("_d", _distances("query_code", "code"))
        # a code is new in the first segment of its smallest distance, at that radius
        new = met.filter((F.array_min("_d") == radius) & (F.array_position("_d", radius) == F.col("segment") + 1))
        new = new.select("query", F.aggregate("_d", F.lit(0), lambda a, b: a + b).alias("distance"),
                         F.explode("ids").alias("id"))
        so_far = new if found is None else new.unionByName(found.select("query", "distance", "id"))
        found = written(_best(so_far, keep), "hamming-found")
        state = found.groupBy("query").agg(F.count("*").alias("n"), F.max("distance").alias("worst"))
        state = open_codes.join(state, "query", "left")
        covered = (F.col("n") >= keep) & (F.col("worst") <= F.size("query_code") * (radius + 1) - 1)
        ended = F.lit(True) if radius == SEGMENT else F.coalesce(covered, F.lit(False))
        told = written(state.withColumn("ended", ended).select("dims", "query", "query_code", "ended"), "hamming-open")
        ready = found.join(told.filter("ended").select("query"), "query", "left_semi")
        done = ready if done is None else done.unionByName(ready)
        open_codes = told.filter("NOT ended").drop("ended")
        if open_codes.isEmpty():
            break
        found = found.join(open_codes.select("query"), "query", "left_semi")
    lists = done.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("best"))
    of_query = asked.select("id", F.xxhash64("dims", "code").alias("query")).join(lists, "query")
    others = of_query.select(F.col("id").alias("query_id"), F.slice(
        F.filter("best", lambda x: x["id"] != F.col("id")), 1, k).alias("best"))
    return others.select("query_id", F.posexplode("best").alias("place", "b")).select(
        "query_id", (F.col("place") + 1).cast("long").alias("rank"), F.col("b.id").alias("neighbor_id"),
        F.col("b.distance").cast("long").alias("distance"))


SQL = """
SELECT query_id, rank, neighbor_id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM (
    SELECT q.vec_id AS query_id, b.vec_id AS neighbor_id,
           len([i FOR i IN range(1, len(q.embedding) + 1) IF (q.embedding[i] > 0) <> (b.embedding[i] > 0)]) AS distance
    FROM embeddings q JOIN embeddings b ON q.vec_id % 100 = 0 AND b.vec_id <> q.vec_id))
WHERE rank <= 10
"""


@query(SQL)
def op4_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of every hundredth embedding, by the Hamming distance of their sign codes."""
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter("vec_id % 100 = 0"), k=10)
