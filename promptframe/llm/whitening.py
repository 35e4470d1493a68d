"""Whitening of vectors on their first principal components, found by block Jacobi-Davidson.

The covariance V is never built: all that is asked of the data are products V B with a few columns,
each one pass of centred rows over the fit list, which is written once as packed blocks. Everything
else is small algebra of one vector's size:

1. Rayleigh-Ritz in the search space gives the best pairs so far and their residuals.
2. Pairs whose residual has reached double precision are locked, the largest first.
3. For the open pairs the correction equation, projected against locked and open vectors, is solved
   by a few steps of MINRES. The steps of all open pairs share their passes.
4. The corrections extend the search space, which restarts from its best vectors when it is full.

After the last pair is locked, the space orthogonal to all of them is searched once more from random
vectors: if it holds a larger value than the last locked one, that one is opened again.

Rows without a usable vector (null, or with null or non-finite entries, or of no entries) are left
out; without any row there is no result. Vectors of different lengths are an error, as are entries
beyond 2**50 after scaling. Repeated vectors count once in the fit list, and every row has its own
results. A vector of fewer entries than components gives fewer components. A component without
variance (few distinct vectors) has the score 0, and is not part of the identity that the error is
measured against. Equal eigenvalues share a space, of which any basis is right. Null ids take part.
Extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptframe.llm.registry import query, table, written


@dataclass(frozen=True)
class Settings:
    """Parameters of the iteration; they change its cost, not its result."""

    #: Vectors of a packed block, and how many partial products are collected at most.
    block: int = 4096
    partials: int = 32
    #: Vectors the search starts with, and those it holds before and after a restart.
    start: int = 12
    largest: int = 48
    restart: int = 16
    #: Pairs followed beside those wanted, and steps of MINRES between two extensions.
    guard: int = 2
    inner: int = 4
    #: A residual has double precision at this many units of the largest eigenvalue's last place.
    units: float = 64
    #: Extensions after which the iteration gives up.
    rounds: int = 500
    seed: int = 11


SETTINGS = Settings()
#: Entries beyond this are not whole numbers of double precision any more once centred.
_MOST = 1 << 50


def entries(vector: Column, scale: int) -> Column:
    """The vector as whole numbers floor(scale * entry); null where it is not usable."""
    numbers = F.transform(vector, lambda x: x.cast("double"))
    usable = (F.size(vector) > 0) & ~F.exists(
        numbers, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(usable, F.transform(numbers, lambda x: F.floor(x * scale).cast("long")))


def _matrix(column: pa.Array) -> np.ndarray:
    """The lists of a column as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def fit_list(vectors: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Packed blocks (n, dims, most, sums, packed) of the distinct vectors of the column ``x``, written.

    ``most`` is the largest absolute entry.
    """
    schema = "n long, dims int, most long, sums array<long>, packed binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = {}, {}

        def block(dims: int) -> pa.RecordBatch:
            x = np.concatenate(held.pop(dims))
            rows.pop(dims)
            most = int(max(x.max(), -x.min()))
            sums = x.sum(0) if most < _MOST else np.zeros(dims, np.int64)
            return pa.RecordBatch.from_pylist(
                [{"n": len(x), "dims": dims, "most": most, "sums": sums.tolist(), "packed": x.astype("<i8").tobytes()}],
                schema=pa.schema([("n", pa.int64()), ("dims", pa.int32()), ("most", pa.int64()),
                                  ("sums", pa.list_(pa.int64())), ("packed", pa.binary())]))

        for batch in batches:
            lengths = np.diff(batch.column(0).offsets.to_numpy())
            for dims in np.unique(lengths).tolist():
                x = _matrix(batch.column(0).filter(pa.array(lengths == dims)))
                for k in range(0, len(x), settings.block):
                    held.setdefault(dims, []).append(x[k:k + settings.block])
                    rows[dims] = rows.get(dims, 0) + len(held[dims][-1])
                    if rows[dims] >= settings.block:
                        yield block(dims)
        for dims in list(held):
            yield block(dims)

    return written(vectors.select("x").distinct().mapInArrow(run, schema), "whitening-fit")


@dataclass
class Fit:
    """The fit list with its size and its exact sums by dimension."""

    blocks: DataFrame
    n: int
    sums: list[int]

    def __post_init__(self) -> None:
        self.mean = np.array([s / self.n for s in self.sums])
        self.tasks = self.blocks.rdd.getNumPartitions()

    def total(self, part: Callable[[np.ndarray], np.ndarray], settings: Settings = SETTINGS) -> np.ndarray:
        """The sum over all blocks of ``part`` of the block's centred rows: one pass.

        Tasks add up their own blocks; beyond ``partials`` tasks they are added in Spark once more.
        """
        mean, dims = self.mean, len(self.sums)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = None
            for batch in batches:
                for data in batch.column(0):
                    x = np.frombuffer(data.as_buffer(), "<i8").reshape(-1, dims)
                    own = part(x - mean)
                    found = own if found is None else found + own
            if found is not None:
                yield pa.RecordBatch.from_pydict({"v": [np.ascontiguousarray(found).tobytes()]})

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = None
            for batch in batches:
                for data in batch.column(0):
                    own = np.frombuffer(data.as_buffer(), np.float64)
                    found = own if found is None else found + own
            if found is not None:
                yield pa.RecordBatch.from_pydict({"v": [found.tobytes()]})

        sums = self.blocks.select("packed").mapInArrow(run, "v binary")
        if self.tasks > settings.partials:
            sums = sums.repartition(settings.partials).mapInArrow(add, "v binary")
        return np.sum([np.frombuffer(r["v"], np.float64) for r in sums.collect()], axis=0)

    def product(self, b: np.ndarray, settings: Settings = SETTINGS) -> np.ndarray:
        """V b, for a matrix b of few columns."""
        return self.total(lambda x: x.T @ (x @ b), settings).reshape(b.shape) / self.n


def fit(vectors: DataFrame, settings: Settings = SETTINGS) -> Fit | None:
    """The fit list of the column ``x``; None without vectors."""
    blocks = fit_list(vectors, settings)
    told = blocks.agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.min("dims").alias("low"),
                      F.max("dims").alias("high")).first()
    if not told["n"]:
        return None
    if told["low"] != told["high"]:
        raise ValueError(f"vectors of {told['low']} and of {told['high']} entries")
    if told["most"] >= _MOST:
        raise ValueError("entries are too large for double precision")
    sums = blocks.select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(
        F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    return Fit(blocks, told["n"], [int(r["s"]) for r in sorted(sums, key=lambda r: r["at"])])


def _orthonormal(new: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The directions of ``new`` outside ``basis``; those that hold nothing new are left out."""
    kept = basis
    for column in new.T:
        size = np.linalg.norm(column)
        for _ in range(3):
            column = column - kept @ (kept.T @ column)
        left = np.linalg.norm(column)
        if size > 0 and left > 1e-10 * size:
            column = column / left
            column = column - kept @ (kept.T @ column)
            kept = np.column_stack([kept, column / np.linalg.norm(column)])
    return kept[:, basis.shape[1]:]


class _Minres:
    """MINRES for one projected correction equation, which waits for its products.

    ``ask`` is the vector whose product the next step needs, ``step`` takes the product.
    """

    def __init__(self, right: np.ndarray):
        self.x = np.zeros_like(right)
        self.beta = np.linalg.norm(right)
        self.v, self.before = right / self.beta if self.beta else right, np.zeros_like(right)
        self.w = self.w_before = np.zeros_like(right)
        self.eta, self.c, self.c_before, self.s, self.s_before = self.beta, 1.0, 1.0, 0.0, 0.0
        self.done, self.goal, self.last = self.beta == 0, 0.05 * self.beta, 0.0

    @property
    def ask(self) -> np.ndarray:
        return self.v

    def step(self, product: np.ndarray) -> None:
        alpha = self.v @ product
        u = product - alpha * self.v - self.last * self.before
        beta = np.linalg.norm(u)
        delta = self.c * alpha - self.c_before * self.s * self.last
        rho = np.hypot(delta, beta)
        if rho == 0:
            self.done = True
            return
        second, third = self.s * alpha + self.c_before * self.c * self.last, self.s_before * self.last
        w = (self.v - third * self.w_before - second * self.w) / rho
        self.c_before, self.s_before = self.c, self.s
        self.c, self.s = delta / rho, beta / rho
        self.x = self.x + self.c * self.eta * w
        self.eta *= -self.s
        self.w_before, self.w = self.w, w
        self.before, self.last = self.v, beta
        self.done = beta <= 1e-14 * abs(alpha) or abs(self.eta) <= self.goal
        self.v = u / beta if beta else u


def _corrections(product: Callable[[np.ndarray], np.ndarray], kept: np.ndarray, vectors: np.ndarray,
                 values: np.ndarray, residuals: np.ndarray, steps: int) -> np.ndarray:
    """A correction of every open pair, orthogonal to the locked (``kept``) and the open vectors."""
    against = np.column_stack([kept, vectors])
    outside = lambda b: b - against @ (against.T @ b)
    solvers = [_Minres(-outside(r)) for r in residuals.T]
    for _ in range(steps):
        waiting = [k for k, s in enumerate(solvers) if not s.done]
        if not waiting:
            break
        asked = np.column_stack([solvers[k].ask for k in waiting])
        got = outside(product(asked) - asked * values[waiting])
        for k, column in zip(waiting, got.T, strict=True):
            solvers[k].step(column)
    return np.column_stack([outside(s.x) for s in solvers])


def principal(product: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int,
              settings: Settings = SETTINGS) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors of a symmetric operator."""
    wanted = min(wanted, dims)
    luck = np.random.default_rng(settings.seed)
    values, kept = np.zeros(0), np.zeros((dims, 0))
    basis = _orthonormal(luck.standard_normal((dims, min(settings.start, dims))), kept)
    image = product(basis)
    checked, stuck, best = False, 0, np.inf
    for _ in range(settings.rounds):
        # the search space stays orthogonal to what is locked
        small = basis.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        scale = max(np.abs(np.concatenate([values, theta, np.zeros(1)])))
        enough = settings.units * np.finfo(float).eps * scale
        full = basis.shape[1] == dims - kept.shape[1]
        if len(values) == wanted:
            if (checked or full) and (not len(theta) or theta[0] <= values[-1] + enough):
                return values, kept
            if len(theta) and theta[0] > values[-1] + enough:  # a larger pair was missed: open the last one
                basis, values = np.column_stack([basis, kept[:, -1:]]), values[:-1]
                kept = kept[:, :-1]
                image, checked = product(basis), False
                continue
        count = min(wanted - len(values) + settings.guard, len(theta)) if len(values) < wanted else min(2, len(theta))
        if not count:
            return values, kept
        vectors, images = basis @ turn[:, :count], image @ turn[:, :count]
        away = images - vectors * theta[:count]
        away -= kept @ (kept.T @ away)
        sizes = np.linalg.norm(away, axis=0)
        if len(values) < wanted:
            if sizes[0] < 0.5 * best:
                best, stuck = sizes[0], 0
            else:
                stuck += 1
            # rounding of the products may be above the goal: then no residual gets smaller any more
            reached = sizes[0] <= enough or (stuck >= 6 or full) and sizes[0] <= 1e4 * enough
            if reached:
                # a fresh product, not the one carried along through restarts
                own = product(vectors[:, :1])[:, 0]
                value = vectors[:, 0] @ own
                true = np.linalg.norm(own - value * vectors[:, 0])
                if true <= max(2 * enough, 2 * sizes[0]):
                    values, kept = np.append(values, value), np.column_stack([kept, vectors[:, 0]])
                    order = np.argsort(-values, kind="stable")
                    values, kept = values[order], kept[:, order]
                    basis, image = basis @ turn[:, 1:], image @ turn[:, 1:]
                    image -= kept @ (kept.T @ image)
                    best, stuck = np.inf, 0
                    if len(values) == wanted:
                        # what is orthogonal to all of them: random vectors may show a larger pair
                        fresh = luck.standard_normal((dims, settings.guard + 2))
                        fresh = _orthonormal(fresh, np.column_stack([kept, basis]))
                        if fresh.shape[1]:
                            basis, image = np.column_stack([basis, fresh]), np.column_stack([image, product(fresh)])
                    continue
                image = product(basis)  # the products carried along have lost their precision
                continue
        if basis.shape[1] + count > settings.largest and not full:
            basis, image = basis @ turn[:, :settings.restart], image @ turn[:, :settings.restart]
        new = _orthonormal(
            _corrections(product, kept, vectors, theta[:count], away, settings.inner), np.column_stack([kept, basis]))
        if not new.shape[1] and not full:
            new = _orthonormal(luck.standard_normal((dims, 2)), np.column_stack([kept, basis]))
        if new.shape[1]:
            basis, image = np.column_stack([basis, new]), np.column_stack([image, product(new)])
        if len(values) == wanted:
            checked = True
    raise RuntimeError("the components did not converge")


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4,
           scale: int = 256, settings: Settings = SETTINGS) -> DataFrame:
    """The id column, component, n, deviation, whitened, explained, identity_error of every row and component."""
    usable = rows.select(rows[id_col].alias(id_col), entries(rows[vector_col], scale).alias("x")).filter("x IS NOT NULL")
    long, double = T.LongType(), T.DoubleType()
    schema = T.StructType([usable.schema[0]] + [T.StructField(n, t) for n, t in (
        ("component", T.IntegerType()), ("n", long), ("deviation", long), ("whitened", double), ("explained", double),
        ("identity_error", double))])
    found = fit(usable, settings)
    if found is None:
        return rows.sparkSession.createDataFrame([], schema)
    n, sums, mean = found.n, found.sums, found.mean
    trace = float(found.total(lambda x: np.array([np.square(x).sum()]), settings)[0]) / n
    values, vectors = principal(lambda b: found.product(b, settings), len(sums), components, settings)
    there = values > settings.units * np.finfo(float).eps * max(trace, np.finfo(float).tiny)
    turn = np.where(there, vectors / np.sqrt(np.where(there, values, 1)), 0)
    size = len(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = x @ turn
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    told = found.total(moments, settings) / n
    gram = told[size:].reshape(size, size) - np.outer(told[:size], told[:size])
    error = float(np.abs(gram - np.diag(there.astype(float))).max())
    explained = np.where(there, values, 0) / (trace or 1)
    # n * x - S squared and summed, in 64 bits where these are sure to hold it
    most = found.blocks.agg(F.max("most")).first()[0]
    exact = np.int64 if len(sums) * (2 * n * max(1, most)) ** 2 < 1 << 63 else object

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.array(sums, exact)
        for batch in batches:
            x = _matrix(batch.column(1))
            if not len(x):
                continue
            deviation = np.square(n * x.astype(exact) - s).sum(1)
            at = np.repeat(np.arange(len(x)), size)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(x))),
                 pa.array(np.full(len(at), n)), pa.array(deviation[at].tolist(), pa.int64()),
                 pa.array(((x - mean) @ turn).ravel()), pa.array(np.tile(explained, len(x))),
                 pa.array(np.full(len(at), error))], names=schema.names)

    return usable.mapInArrow(run, schema)


@query()
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every embedding."""
    return whiten(table(spark, sf_dir, "embeddings"))
