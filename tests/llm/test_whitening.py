import numpy as np
import pytest

from promptframe.llm.whitening import Settings, op11_embedding_whitening, principal, whiten

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(rows):
    """Whole vectors, the fit list's size, covariance and sums, by numpy."""
    kept = [(i, v) for i, v in rows if v and None not in v and np.isfinite(v).all()]
    x = np.floor(256 * np.array([np.array(v, np.float32).astype(float) for _, v in kept])).astype(np.int64)
    own = np.unique(x, axis=0)
    away = own - own.sum(0) / len(own)
    return [i for i, _ in kept], x, len(own), away.T @ away / len(own), own.sum(0)


def check(rows, found, components=4):
    ids, x, n, v, s = expected(rows)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    size = min(components, x.shape[1])
    assert len(found) == len(ids) * size
    deviation = ((n * x - s) ** 2).sum(1)
    for c in range(size):
        own = [r for r in found if r.component == c + 1]
        assert sorted((str(r.vec_id), r.deviation) for r in own) == sorted((str(i), d) for i, d in zip(ids, deviation.tolist()))
        assert {r.n for r in own} == {n} and max(abs(r.explained - values[c] / np.trace(v)) for r in own) < 1e-12
        assert max(r.identity_error for r in own) < 1e-9
        want = (x - s / n) @ vectors[:, c] / np.sqrt(values[c])
        got = np.sort([r.whitened for r in own])
        assert min(np.abs(got - np.sort(want)).max(), np.abs(got - np.sort(-want)).max()) < 1e-8


def table(n=600, d=12, seed=3):
    rng = np.random.default_rng(seed)
    turn = np.linalg.qr(rng.standard_normal((d, d)))[0] * np.linspace(3, 1, d)
    x = rng.standard_normal((n, d)) @ turn + 5
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(x)]
    return rows + [rows[0]] * 200 + [(1000 + k, rows[1][1]) for k in range(50)]


@pytest.mark.parametrize("how", [Settings(), Settings(block=7, partials=1), Settings(start=1, guard=0, largest=8, restart=2)])
def test_components_match_numpy(spark, how):
    rows = table()
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(6)
    check(rows, whiten(df, settings=how).collect())


def test_rows_without_a_usable_vector(spark):
    rows = table(80, 5)
    more = [(None, rows[0][1]), (5001, None), (5002, [1.0, None, 1.0, 1.0, 1.0]), (5003, [float("nan")] * 5),
            (5004, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (5005, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + more], SCHEMA).selectExpr("*", "1 AS x", "2 AS n", "3 AS component")
    check(rows + more[:1], whiten(df).collect())


def test_tables_without_variance(spark):
    make = lambda vs: spark.createDataFrame([(k, v, 0) for k, v in enumerate(vs)], SCHEMA)
    assert whiten(make([])).count() == 0 and whiten(make([None, []])).count() == 0
    one = whiten(make([[1.0, 2.0, 3.0]] * 3)).collect()
    assert len(one) == 9 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, 0.0, 0.0, 0.0)}
    line = whiten(make([[0.0, 0.0], [1.0, 1.0], [2.0, 2.0], [2.0, 2.0]])).collect()
    assert sorted(round(r.whitened, 9) for r in line if r.component == 2) == [0.0] * 4
    assert {round(r.explained, 12) for r in line} == {0.0, 1.0} and max(r.identity_error for r in line) < 1e-12
    with pytest.raises(ValueError, match="entries"):
        whiten(make([[1.0], [1.0, 2.0]]))
    large = whiten(make([[-3e7, 1.0], [3e7, 0.0]]))
    with pytest.raises(Exception):  # the exact sum is beyond a long
        large.collect()


@pytest.mark.parametrize("values", [
    np.r_[5, 5, 5, 5, 5, 1, 1, 1], np.r_[3, 2, np.zeros(30)], np.linspace(1, 1.2, 150), np.zeros(6), np.ones(20),
    np.r_[10, 9.9999999, 9.99, 9, 8, np.ones(60)], np.r_[1e-9, 1e-12], np.r_[1e12, 1, 1e-3, 1e-6, 0], np.r_[7.0]])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_principal_pairs(values, seed):
    d = len(values)
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]
    v = (turn * values) @ turn.T
    found, vectors = principal(lambda b: v @ b, d, 4, Settings(seed=seed))
    want = np.sort(values)[::-1][:4]
    scale = max(want.max(), 1e-300)
    assert np.abs(found - want).max() <= 1e-13 * scale
    assert np.abs(v @ vectors - vectors * found).max() <= 1e-13 * scale
    assert np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max() < 1e-12


def test_query_matches_numpy(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    check(rows, op11_embedding_whitening(spark, "/root/testdata/sf0.001").collect())
