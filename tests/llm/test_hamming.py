import random

from promptframe.llm.hamming import search


def brute(rows, queries, k):
    clean = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and None not in v})
    out = []
    for q, a in sorted({(i, tuple(v)) for i, v in queries if i is not None and v and None not in v}):
        found = sorted((sum((x > 0) != (y > 0) for x, y in zip(a, b, strict=True)), i) for i, b in clean
                       if i != q and len(a) == len(b))[:k]
        out += [(q, r + 1, i, d) for r, (d, i) in enumerate(found)]
    return out


def test_search_matches_brute_force(spark):
    rng = random.Random(4)
    hot = [rng.gauss(0, 1) for _ in range(40)]
    rows = [(k, hot if k % 3 == 0 else [rng.gauss(0, 1) for _ in range(40)]) for k in range(150)]
    rows += [(k, [v if rng.random() > 0.05 else -v for v in hot]) for k in range(150, 180)]
    rows += [(200, None), (None, hot), (201, []), (202, [1.0, None, 2.0]), (203, [1.0, -1.0, 0.0]), (204, [1.0, 1.0, 0.0]),
             (0, hot)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = df.filter("vec_id % 10 = 0 OR vec_id > 199")
    got = sorted(tuple(r) for r in search(df, queries, 7).collect())
    assert got == brute(rows, [r for r in rows if r[0] is not None and (r[0] % 10 == 0 or r[0] > 199)], 7)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert search(df, df).count() == 0
