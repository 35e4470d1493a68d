import random
import zlib
from collections import defaultdict

import pytest
from edges import documents
from pyspark.sql import functions as F

from promptframe.llm.sharding import Settings, assign, op12_sharding, records


def check(rows, placed, shards, slack):
    """Every record once; shards are runs of one order, near equal; slots have no gaps and follow the order."""
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in placed) == sorted(
        (str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    by_shard = defaultdict(list)
    for r in placed:
        by_shard[r.shard].append(r)
    assert set(by_shard) <= set(range(shards))
    last = None
    for shard in sorted(by_shard):
        own = sorted(by_shard[shard], key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        places = [(r.place, r.tie) for r in own]
        assert places == sorted(places) and (last is None or last <= places[0])
        last = places[-1]
    total = sum(r.size for r in placed)
    sizes = [sum(r.size for r in by_shard[s]) for s in range(shards)]
    largest = max((r.size for r in placed), default=0)
    assert max(abs(s - total / shards) for s in sizes) <= largest + slack * total / shards + 1, sizes


def placed_of(docs, shards, how=Settings(), key=None):
    own = F.xxhash64(F.coalesce("text", F.lit(""))) if key is None else key
    docs = docs.withColumn("place", own).withColumn("tie", F.xxhash64("doc_id"))
    return assign(records(docs, key=key, keep=("doc_id", "place", "tie")), shards, how).collect()


def corpus(n=3000):
    rng = random.Random(8)
    rows = [(k, "copied text " * 5 if k % 3 == 0 else "x" * rng.choice([0, 3, 40, 500])) for k in range(n)]
    return rows + [(7, "copied text " * 5)] * 400 + [(n, "long " * 3000), (n + 1, None), (None, "y")]


@pytest.mark.parametrize("shards,how", [(1, Settings()), (7, Settings()), (40, Settings(range_rows=50)),
                                        (5, Settings(ranges=1, drawn=2, tolerance=0.05)), (40, Settings(ranges=2, drawn=1))])
def test_shards_are_near_equal_runs(spark, shards, how):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check(rows, placed_of(df, shards, how), shards, 2 * how.tolerance)


def test_a_key_of_the_caller(spark):
    rows = corpus(800)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    check(rows, placed_of(df, 6, key=key), 6, 0.01)


def test_edges(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for shards in (1, 3, 40):
        check(rows, placed_of(docs, shards), shards, 0)
    assert placed_of(docs.limit(0), 4) == []
    one = docs.filter("doc_id = 4")
    check([r for r in rows if r[0] == 4], placed_of(one, 40), 40, 40)
    same = spark.createDataFrame([(1, "z")] * 500, "doc_id long, text string")
    check([(1, "z")] * 500, placed_of(same, 10), 10, 0)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    df = op12_sharding(spark, "/root/testdata/sf0.01")
    assert df.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    got = df.collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"}
    sizes = defaultdict(int)
    for r in got:
        sizes[r.shard] += r.size
    largest = max(r.size for r in got)
    assert len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) <= 2 * largest
