"""Exact self-join of texts by the Jaccard distance of their word shingles, and its components.

Two texts link when 100 * intersection >= ``percent`` * union of their shingle sets. The distance
is a metric, which the join uses in three steps; r is the largest distance of a link.

1. Every shingle is a pivot, under one order of all shingles (frequent ones last, else by digest).
   A set lies in the region of its first shingle. A text within r lacks at most r of the set, so
   its region is among the first shingles of the set: these regions are the window into which the
   set is replicated. Windows are made longer by ``longer`` of the set, whereby linked sets share
   not one but many regions; a set that shares too few regions with any other has no link and
   leaves exactly here, before any set moves.
2. Regions that meet are named by a pivot document, the smallest of their members. A set leaves
   the pivots it shares least with, as long as it could not miss a link by that.
3. A region of several members is a Voronoi diagram of ``pivots`` of its sets: every set belongs to the
   cell of the nearest one. A link of two sets is found in the cell of either, if the other is copied
   there; by the triangle inequality it is copied to all cells whose pivot is at most 2 r farther
   than its nearest. Sets within r of a cell's pivot link to it and so need no links among each other:
   what is left of a cell are the sets that do not, with all that their distances to the pivot admit
   within r of them. That is a region again, which is cut in the same way, on and on. A region that
   fits into a task goes on there; a larger one takes its step spread over tasks. A region that does
   not get smaller, where all sets lie about as far from each other, is joined pair by pair of blocks.

Only a connecting part of the links is kept, a star for each connected part of a region, and the
components come from these stars. Texts of equal word sequences are one text from the start.

Shingles and texts are named by 64-bit digests. A null text, or one without words, has no shingles
and links with nothing. Repeated rows are equal texts. Null ids take part, but name a component
only if it has no other id. Extra columns are never read by ``components_of`` and kept by
``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptframe.llm.registry import NOT_BLANK, query, table, text_or_empty, written
from promptframe.llm.tokens import chunks, mixed, ragged
from promptframe.llm.words import shingle_sets


@dataclass(frozen=True)
class Settings:
    """Parameters of the join; only ``words`` and ``percent`` change its result."""

    words: int = 5
    percent: int = 75
    #: Share of a set by which its window is longer than the least that is exact.
    longer: float = 0.15
    #: Shingles of a region that one task joins, and of the blocks of a larger region.
    region_shingles: int = 1_000_000
    #: Sets that a region is divided by, and those of a region that is not divided any more.
    pivots: int = 8
    leaf: int = 24
    #: A step must leave at most this share of a region in a cell, else it is joined pair by pair.
    shrink: float = 0.7
    #: One in so many documents is looked at to put frequent shingles last, of which at most
    #: ``frequent`` are known: the order changes what the join costs, not what it finds.
    sample: int = 64
    frequent: int = 50_000
    #: Parts of the region of a frequent shingle.
    salts: int = 64

    def least(self, n: np.ndarray) -> np.ndarray:
        """The least intersection of a set of ``n`` shingles with any linked one."""
        return -(-self.percent * n // 100)

    def window(self, n: int) -> int:
        return n - int(self.least(n)) + 1 + int(self.longer * n)

    def needed(self, n: np.ndarray) -> np.ndarray:
        """Regions that a set shares at least with any linked one, whose size is at least ``least``."""
        return 1 + (self.longer * self.least(n)).astype(np.int64)


SETTINGS = Settings()
#: Texts a task remembers to send their regions once; beyond it the memory starts anew.
_SEEN = 500_000
#: Pairs that a task holds before it deals them out, and buckets for each shuffle partition.
_HELD = 1 << 19
_BUCKETS = 4
#: Kinds of rows of the tables of pairs: texts, pairs, frequent shingles, pairs of these.
_TEXT, _PAIRS, _NAMES, _OFTEN = range(4)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[str]]]:
    texts = batch.column(column).to_pylist()
    for a, b in chunks(texts):
        yield a, texts[a:b]


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("digest"), text.alias("text"))


def _buckets(df: DataFrame) -> int:
    return _BUCKETS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _one_of(found: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which of ``found`` are among the sorted ``names``."""
    if not len(names):
        return np.zeros(len(found), bool)
    return names[np.minimum(np.searchsorted(names, found), len(names) - 1)] == found


def _blob(column: pa.Array, dtype) -> np.ndarray:
    """The numbers of all rows of a binary column, one after the other."""
    parts = [np.frombuffer(x.as_buffer(), dtype) for x in column if x.is_valid]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def _row(schema: pa.Schema, **values) -> pa.Table:
    """Rows of some columns as a table of ``schema``, the others null."""
    n = len(next(iter(values.values())))
    return pa.table([pa.array(values[f.name], f.type) if f.name in values else pa.nulls(n, f.type) for f in schema], schema=schema)


class Dealt:
    """Pairs of 64-bit numbers, dealt to buckets: a row for each bucket that has any."""

    def __init__(self, buckets: int):
        self.buckets, self.held, self.size = buckets, [], 0

    def add(self, bucket: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        self.held.append((bucket % np.uint64(self.buckets), a, b))
        self.size += len(a)

    def rows(self, least: int = 1) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
        """(bucket, a, b) of all pairs held, if they are not under ``least``."""
        if self.size < least:
            return
        bucket, a, b = (np.concatenate(c) for c in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        # few buckets are sorted by their digits
        order = np.argsort(bucket.astype(np.uint16 if self.buckets <= 1 << 16 else np.int64), kind="stable")
        bucket = bucket[order]
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        ends = pa.py_buffer((np.append(cuts, len(bucket)) * 8).astype(np.int32))
        yield pa.array(bucket[cuts].astype(np.int32)), *[pa.Array.from_buffers(
            pa.binary(), len(cuts), [None, ends, pa.py_buffer(np.ascontiguousarray(x[order]))]) for x in (a, b)]


def _shingled(rows: DataFrame, settings: Settings, frequent: np.ndarray) -> DataFrame:
    """Every row with its key (digest of its words) and n (shingles), and the pairs (shingle, key) of the windows
    of every text a task meets first, dealt by shingles; frequent shingles are dealt by parts."""
    kind, buckets = rows.schema["id"], _buckets(rows)
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), kind, T.StructField("digest", T.LongType()),
                           T.StructField("key", T.LongType()), T.StructField("n", T.LongType()),
                           T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        dealt, id_type = Dealt(buckets), None
        for batch in batches:
            id_type, all_keys, n = batch.column(0).type, [np.zeros(0, np.uint64)], []
            for _, texts in _texts(batch, "text"):
                sets, sequence = shingle_sets(texts, settings.words)
                all_keys.append(sequence)
                sizes = [len(found) for found in sets]
                n += sizes
                often, keys, windows, begin = _one_of(np.concatenate(sets), frequent), [], [], 0
                for found, size, key in zip(sets, sizes, sequence.view(np.int64).tolist(), strict=True):
                    last, begin = often[begin:begin + size], begin + size
                    if not size or key in seen:
                        continue
                    if len(seen) > _SEEN:
                        seen.clear()
                    seen.add(key)
                    if last.any():
                        found = np.concatenate([found[~last], found[last]])
                    windows.append(found[:settings.window(size)])
                    keys.append(key)
                if windows:
                    s, key = np.concatenate(windows), np.repeat(np.array(keys, np.int64), [len(w) for w in windows])
                    dealt.add(_by_shingle(s, key, frequent, settings), s, key)
            key = np.concatenate(all_keys)
            yield pa.RecordBatch.from_arrays(
                [batch.column(3), batch.column(0), batch.column(1),
                 pa.array(key.view(np.int64)), pa.array(n, pa.int64()), pa.nulls(len(n), pa.binary()),
                 pa.nulls(len(n), pa.binary())], names=schema.names)
            for found in dealt.rows(_HELD):
                yield _pairs_of(found, id_type)
        for found in dealt.rows():
            yield _pairs_of(found, id_type)

    def _pairs_of(found, id_type) -> pa.RecordBatch:
        none = [pa.nulls(len(found[0]), t) for t in (id_type, pa.int64(), pa.int64(), pa.int64())]
        return pa.RecordBatch.from_arrays([found[0], *none, *found[1:]], names=schema.names)

    # rows of texts only pass through, so those of equal texts need not meet
    place = F.pmod(F.xxhash64("id", "digest"), F.lit(buckets)).cast("int").alias("place")
    return rows.select("id", "digest", "text", place).mapInArrow(run, schema)


def _by_shingle(s: np.ndarray, key: np.ndarray, frequent: np.ndarray, settings: Settings) -> np.ndarray:
    """The number a pair (shingle, key) is dealt by: that of the shingle, or of a part if it is frequent."""
    part = np.where(_one_of(s, frequent), key.view(np.uint64) % np.uint64(settings.salts), np.uint64(0))
    return mixed(s ^ (part * _STEP))


def _frequent(rows: DataFrame, settings: Settings) -> np.ndarray:
    """The most frequent shingles of a sample of the documents, sorted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _texts(batch, "text"):
                sets, sequence = shingle_sets(texts, settings.words)
                first = np.unique(sequence, return_index=True)[1]
                found = np.concatenate([sets[k] for k in first.tolist()]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found)], names=["s"])

    sample = rows.filter(F.pmod(F.xxhash64("id", "digest"), F.lit(settings.sample)) == 0)
    counted = sample.mapInArrow(run, "s long").groupBy("s").count().filter("count >= 4")
    top = counted.orderBy(F.desc("count"), "s").limit(settings.frequent).collect()
    return np.sort(np.array([r["s"] for r in top], np.int64).view(np.uint64))


def _runs(names: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The values sorted by names, where a run of one name begins, and its length."""
    order = np.argsort(names)
    names = names[order]
    begin = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if len(names) else np.zeros(0, np.int64)
    return names, *[v[order] for v in values], begin, np.diff(np.append(begin, len(names)))


def _met(dealt: DataFrame, id_field: T.StructField, settings: Settings, frequent: np.ndarray, named: bool) -> DataFrame:
    """Of pairs (shingle a, key b) those whose shingle several texts have; rows of texts stay as they are.

    With ``named``, pairs (key a, pivot b) instead, the pivot being the least key. Of a frequent shingle a task
    sees a part only: its pairs all stay, with the least and the last key of the part beside them.
    """
    schema = T.StructType([T.StructField("kind", T.IntegerType()), id_field, T.StructField("digest", T.LongType()),
                           T.StructField("key", T.LongType()), T.StructField("n", T.LongType()),
                           *[T.StructField(c, T.BinaryType()) for c in "abc"]])

    def join(group: pa.Table) -> pa.Table:
        text = group.filter(group.column("key").is_valid())
        types = pa.schema([("kind", pa.int32()), ("id", group.schema.field("id").type), *[(c, pa.int64()) for c in ("digest", "key", "n")],
                           *[(c, pa.binary()) for c in "abc"]])
        out = [_row(types, kind=np.full(len(text), _TEXT), **{c: text.column(c).combine_chunks() for c in ("id", "digest", "key", "n")})]
        s, key, begin, length = _runs(_blob(group.column("a"), np.uint64), _blob(group.column("b"), np.int64))
        if len(s):
            least, last = np.minimum.reduceat(key, begin), np.maximum.reduceat(key, begin)
            often = _one_of(s[begin], frequent)
            stay = np.repeat(~often & (least != last), length)
            one, other = (key[stay], np.repeat(least, length)[stay]) if named else (s[stay], key[stay])
            hot = np.repeat(often, length)
            out += [_row(types, kind=[k], **{c: [v.tobytes()] for c, v in zip("abc", values)}) for k, values in (
                (_PAIRS, (one, other)), (_OFTEN, (s[hot], key[hot])), (_NAMES, (s[begin][often], least[often], last[often])))
                if len(values[0])]
        return pa.concat_tables(out)

    return dealt.groupBy("bucket").applyInArrow(join, schema)


def _hot_names(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles that several texts have, sorted, and the pivots of their regions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_blob(c, np.int64)) for c in batch.columns], names=["s", "least", "last"])

    # one row per frequent shingle, of which ``frequent`` bounds the number, so every task holds them
    parts = table.filter(F.col("kind") == _NAMES).select("a", "b", "c").mapInArrow(run, "s long, least long, last long")
    found = parts.groupBy("s").agg(F.min("least").alias("least"), F.max("last").alias("last")).filter("least <> last").collect()
    names, pivots = (np.array([r[c] for r in found], np.int64) for c in ("s", "least"))
    order = np.argsort(names.view(np.uint64))
    return names[order].view(np.uint64), pivots[order]


_DEALT = "bucket int, own boolean, a binary, b binary"


def _by_key(table: DataFrame, settings: Settings, hot: tuple[np.ndarray, np.ndarray], named: bool) -> DataFrame:
    """The pairs of a table (shingle, or with ``named`` pivot, as a, and key as b) dealt by key, with what a text needs
    (``own``, as a). Frequent shingles that one text has leave here, others have their pivots by now."""
    buckets, (names, pivots) = _buckets(table), hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt = {own: Dealt(buckets) for own in (False, True)}

        def rows(least: int) -> Iterator[pa.RecordBatch]:
            for own, part in dealt.items():
                for bucket, a, b in part.rows(least):
                    yield pa.RecordBatch.from_arrays([bucket, pa.array([own] * len(bucket), pa.bool_()), a, b], names=["bucket", "own", "a", "b"])

        for batch in batches:
            kind = np.array(batch.column("kind"))
            for k in np.unique(kind).tolist():
                part = batch.filter(pa.array(kind == k))
                if k == _TEXT:
                    key, n = (np.array(part.column(c), np.int64) for c in ("key", "n"))
                    key, a = key[n > 0], settings.needed(n[n > 0])
                elif k == _PAIRS:
                    a, key = (_blob(part.column(c), np.int64) for c in ("ba" if named else "ab"))
                elif k == _OFTEN:
                    a, key = _blob(part.column("a"), np.uint64), _blob(part.column("b"), np.int64)
                    met = _one_of(a, names)
                    a, key = a[met], key[met]
                    if named and len(a):
                        a = pivots[np.searchsorted(names, a)]
                else:
                    continue
                dealt[k == _TEXT].add(mixed(key.view(np.uint64)), a.view(np.int64), key)
            yield from rows(_HELD)
        yield from rows(1)

    return table.select("kind", "key", "n", "a", "b").mapInArrow(run, _DEALT)


def _of_keys(group: pa.Table) -> tuple[np.ndarray, ...]:
    """Pairs (key, other) of a group sorted by key, where each key begins and its length, and what it needs."""
    own = group.column("own")
    asked, pairs = group.filter(own), group.filter(pc.invert(own))
    texts, first = np.unique(_blob(asked.column("b"), np.int64), return_index=True)
    needed = _blob(asked.column("a"), np.int64)[first]
    key, other = _blob(pairs.column("b"), np.int64), _blob(pairs.column("a"), np.int64)
    order = np.lexsort((other, key))
    key, other = key[order], other[order]
    return key, other, texts, needed


def _edges(table: DataFrame, settings: Settings, frequent: np.ndarray) -> DataFrame:
    """(key, pivot): the regions by pivot document in which each text has to be joined."""
    id_field, buckets = table.schema["id"], _buckets(table)

    def alive(group: pa.Table) -> pa.Table:
        key, s, texts, needed = _of_keys(group)
        if len(key):
            once = np.r_[True, (key[1:] != key[:-1]) | (s[1:] != s[:-1])]
            key, s = key[once], s[once]
            key, s, _, length = _runs(key, s)
            begin = np.cumsum(length) - length
            stay = np.repeat(length >= needed[np.searchsorted(texts, key[begin])], length)
            key, s = key[stay], s[stay]
        return pa.table({"a": [s.tobytes()], "b": [key.tobytes()]}, schema=pa.schema([("a", pa.binary()), ("b", pa.binary())]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt = Dealt(buckets)
        for batch in batches:
            s, key = _blob(batch.column(0), np.uint64), _blob(batch.column(1), np.int64)
            dealt.add(_by_shingle(s, key, frequent, settings), s, key)
            for found in dealt.rows(_HELD):
                yield pa.RecordBatch.from_arrays(list(found), names=["bucket", "a", "b"])
        for found in dealt.rows():
            yield pa.RecordBatch.from_arrays(list(found), names=["bucket", "a", "b"])

    def kept(group: pa.Table) -> pa.Table:
        key, pivot, texts, needed = _of_keys(group)
        if len(key):
            begin = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (pivot[1:] != pivot[:-1])])
            key, pivot, met = key[begin], pivot[begin], np.diff(np.append(begin, len(key)))
            order = np.lexsort((pivot, met, key))
            key, pivot, met = key[order], pivot[order], met[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            so_far = np.cumsum(met)
            so_far -= np.repeat((so_far - met)[first], np.diff(np.append(first, len(key))))
            # linked texts share as many regions as either needs, so each may leave under half of its need
            stay = so_far > (needed[np.searchsorted(texts, key)] - 1) // 2
            key, pivot = key[stay], pivot[stay]
        return pa.table([pa.array(key), pa.array(pivot)], names=["key", "pivot"])

    shared = _by_key(table, settings, _hot_names(table), False).groupBy("bucket").applyInArrow(alive, "a binary, b binary")
    left = shared.mapInArrow(deal, "bucket int, a binary, b binary")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("id", id_field.dataType), ("digest", "long"), ("key", "long"), ("n", "long"))]
    met = written(_met(left.select("bucket", *none, "a", "b"), id_field, settings, frequent, True), "jaccard-shared")
    every = met.unionByName(table.filter(F.col("kind") == _TEXT))
    return written(_by_key(every, settings, _hot_names(met), True).groupBy("bucket").applyInArrow(
        kept, "key long, pivot long"), "jaccard-edges")


class Parts:
    """Union of numbered nodes, with the smallest as the root."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, nodes: np.ndarray) -> None:
        roots = np.unique(self.of[nodes])
        self.of[np.isin(self.of, roots)] = roots[0]


class Sets:
    """Sets side by side, to intersect one with many.

    Members that lie in one set only can not be shared, so they count in ``length`` and are not held.
    Those that lie in many sets are columns of bits, others have a list of their sets: either way one set
    against all takes about a 64th of what all sets hold.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.length = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        names, self.flat = np.unique(every, return_inverse=True)
        self.owner = np.repeat(np.arange(len(sets)), self.length)
        self._hold(np.bincount(self.flat, minlength=len(names)))

    def _hold(self, count: np.ndarray) -> None:
        stay = (count > 1)[self.flat]
        self.owner, self.flat, self.count = self.owner[stay], (np.cumsum(count > 1) - 1)[self.flat[stay]], count[count > 1]
        self.held = np.bincount(self.owner, minlength=len(self.length))
        self.start = np.cumsum(self.held) - self.held

    def possible(self, percent: int) -> np.ndarray:
        """Sets that share enough with all others together to link with one; the rest is held no longer.

        What leaves takes its members along, which may leave others alone with theirs, so this goes on while
        many leave.
        """
        least = np.maximum(1, -(-percent * self.length // 100))
        while True:
            stay = (self.held >= least)[self.owner]
            gone, before = int((~stay).sum()), len(stay)
            if gone:
                self.owner, self.flat = self.owner[stay], self.flat[stay]
                self._hold(np.bincount(self.flat, minlength=len(self.count)))
            if gone * 16 <= before:
                break
        alive = np.flatnonzero(self.held >= least)
        many = self.count * 64 > len(alive)
        column = np.where(many, np.cumsum(many) - 1, 0)
        self.mark = np.zeros(len(self.count), bool)
        self.bits = np.zeros((len(self.length), -(-int(many.sum()) // 64)), np.uint64)
        inside = many[self.flat]
        places = column[self.flat[inside]]
        np.bitwise_or.at(self.bits, (self.owner[inside], places >> 6), np.uint64(1) << (places & 63).astype(np.uint64))
        # the lists of sets of the other members
        self.listed, few = ~many, np.flatnonzero(~inside)
        self.lists = self.owner[few[np.argsort(self.flat[few], kind="stable")]]
        self.list_length = np.where(many, 0, self.count)
        self.list_start = np.cumsum(self.list_length) - self.list_length
        return alive

    def shared(self, k: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of ``k`` with the others."""
        own = self.flat[self.start[k]:self.start[k] + self.held[k]]
        if len(others) * 64 < len(self.length):
            self.mark[own] = True
            hit = np.zeros(int(self.held[others].sum()) + 1, np.int64)
            np.cumsum(self.mark[ragged(self.flat, self.start, self.held, others)], out=hit[1:])
            self.mark[own] = False
            ends = np.cumsum(self.held[others])
            return hit[ends] - hit[ends - self.held[others]]
        both = np.bitwise_count(self.bits[others] & self.bits[k]).sum(1, dtype=np.int64)
        met = ragged(self.lists, self.list_start, self.list_length, own[self.listed[own]])
        return both + np.bincount(met, minlength=len(self.length))[others]

    def linked(self, k: int, others: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the others link with ``k``, and their distances to it."""
        both = np.where(others == k, self.length[k], self.shared(k, others))
        union = self.length[k] + self.length[others] - both
        return 100 * both >= percent * union, 1 - both / union


def _pairwise(region: Sets, parts: Parts, members: np.ndarray, others: np.ndarray, percent: int,
              home: np.ndarray | None = None) -> None:
    """Links of ``others`` with ``members``, of those whose sizes and distances to one of them admit any.

    With ``home``, only links of which one side is marked there.
    """
    radius = 1 - percent / 100 + 1e-9
    _, distance = region.linked(members[0], members, percent)
    length = region.length[members]
    far = dict(zip(members.tolist(), distance.tolist(), strict=True))
    for k in others.tolist():
        n = region.length[k]
        near = (parts.of[members] != parts.of[k]) & (100 * np.minimum(n, length) >= percent * np.maximum(n, length))
        near &= np.abs(distance - far[k]) <= radius
        if home is not None and not home[k]:
            near &= home[members]
        found = members[near]
        if len(found):
            linked, _ = region.linked(k, found, percent)
            if linked.any():
                parts.join(np.append(found[linked], k))


def join_region(sets: list[np.ndarray], percent: int, first: np.ndarray | None = None,
                settings: Settings = SETTINGS) -> np.ndarray:
    """The connected part (its smallest member) of each set under the links of a region.

    ``first`` restricts the links that are looked for to those of these sets.
    """
    parts = Parts(len(sets))
    if len(sets) < 2:
        return parts.of
    region, radius = Sets(sets), 1 - percent / 100 + 1e-9
    every = region.possible(percent)

    def cut(members: np.ndarray, others: np.ndarray) -> None:
        if not len(others) or len(members) < 2:
            return
        if len(members) <= max(settings.leaf, settings.pivots):
            return _pairwise(region, parts, members, others, percent)
        pivots = members[np.linspace(0, len(members) - 1, settings.pivots).astype(np.int64)]
        told = [region.linked(p, members, percent) for p in pivots.tolist()]
        for p, (linked, _) in zip(pivots.tolist(), told, strict=True):
            if linked.any():
                parts.join(np.append(members[linked], p))
        far = np.array([d for _, d in told])
        cell, nearest = far.argmin(0), far.min(0)
        other = np.isin(members, others)
        for c, (linked, distance) in enumerate(told):
            home = other & (cell == c)
            inside = distance <= nearest + 2 * radius
            left = inside & ~linked
            if not home.any() or not left.any():
                continue
            kept = left | inside & (distance >= distance[left].min() - radius)
            # what links to the pivot is connected already, so one of a pair does not
            asked = kept & (left | home & ~linked)
            if kept.sum() > settings.shrink * len(members):
                # links of two sets that are at home elsewhere are found there
                at_home = np.zeros(len(sets), bool)
                at_home[members[home]] = True
                _pairwise(region, parts, members[kept], members[asked], percent, at_home)
            else:
                cut(members[kept], members[asked])

    cut(every, every if first is None else np.intersect1d(every, first))
    return parts.of


def _region_sets(rows: DataFrame, members: DataFrame, edges: DataFrame, settings: Settings) -> DataFrame:
    """(pivot, key, n, set, large): the sets of the texts of every region with several members."""
    sized = edges.join(members.groupBy("key").agg(F.first("n").alias("n")), "key")
    regions = sized.groupBy("pivot").agg(F.count("*").alias("texts"), F.sum("n").alias("shingles")).filter("texts > 1")
    large = (F.col("shingles") > settings.region_shingles).alias("large")
    of_text = edges.join(regions.select("pivot", large), "pivot").groupBy("key").agg(
        F.collect_list(F.struct("pivot", "large")).alias("regions"))
    # one row stands for all of equal words
    stand = members.groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("m"))
    wanted = of_text.join(stand, "key").select("key", "regions", F.col("m.id").alias("id"), F.col("m.digest").alias("d"))
    same = rows["id"].eqNullSafe(wanted["id"]) & (rows["digest"] == wanted["d"])
    texts = rows.join(wanted, same).select("key", "regions", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, regions = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, part in _texts(batch, "text"):
                out = [(r["pivot"], keys[a + k], len(found), found.tobytes(), r["large"])
                       for k, found in enumerate(shingle_sets(part, settings.words)[0]) for r in regions[a + k]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (
                        pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()), strict=True)],
                    names=["pivot", "key", "n", "set", "large"])

    return written(texts.mapInArrow(run, "pivot long, key long, n long, set binary, large boolean"), "jaccard-sets")


_STAR = "a long, b long"


def _stars(keys: np.ndarray, part: np.ndarray) -> pa.Table:
    """An edge from every node to the root of its part."""
    far = np.flatnonzero(part != np.arange(len(part)))
    return pa.table([pa.array(keys[far]), pa.array(keys[part[far]])], names=["a", "b"])


def _unpacked(group: pa.Table) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct keys of a group, their sets, and the row of each."""
    keys, rows = np.unique(np.array(group.column("key")), return_index=True)
    data = group.column("set").combine_chunks()
    return keys, [np.frombuffer(data[r].as_buffer(), np.uint64) for r in rows.tolist()], rows


def _small_links(sets: DataFrame, settings: Settings) -> DataFrame:
    percent = settings.percent

    def join(group: pa.Table) -> pa.Table:
        keys, found, _ = _unpacked(group)
        return _stars(keys, join_region(found, percent, settings=settings))

    return sets.filter("NOT large").select("pivot", "key", "set").groupBy("pivot").applyInArrow(join, _STAR)


def _measured(rows: DataFrame, settings: Settings, salt: int) -> DataFrame:
    """Rows (region, key, n, other) of large regions with ``firsts``, the region's pivots, and the distance
    to each (``far``) and whether it links with it (``linked``)."""
    percent = settings.percent
    order = Window.partitionBy("region").orderBy(F.xxhash64("key", F.lit(salt)), "key")
    firsts = rows.select("region", "key", "set").withColumn("_k", F.row_number().over(order)).filter(
        F.col("_k") <= settings.pivots).groupBy("region").agg(F.sort_array(F.collect_list(F.struct("key", "set"))).alias("f"))
    pairs = rows.join(firsts, "region").select("region", "key", "n", "other", "set", "f.key", "f.set").toDF(
        "region", "key", "n", "other", "set", "firsts", "first_sets")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            far, linked = [], []
            sets, firsts = batch.column(4), batch.column(6)
            for k, region in enumerate(batch.column(0).to_pylist()):
                own = np.frombuffer(sets[k].as_buffer(), np.uint64)
                if region != last:
                    last, held = region, [np.frombuffer(x.as_buffer(), np.uint64).copy() for x in firsts[k].values]
                both = [int((p[np.minimum(np.searchsorted(p, own), len(p) - 1)] == own).sum()) for p in held]
                union = [len(own) + len(p) - n for p, n in zip(held, both, strict=True)]
                far.append([1 - n / u for n, u in zip(both, union, strict=True)])
                linked.append([100 * n >= percent * u for n, u in zip(both, union, strict=True)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], batch.column(5), pa.array(far, pa.list_(pa.float64())), pa.array(linked, pa.list_(pa.bool_()))],
                names=["region", "key", "n", "other", "firsts", "far", "linked"])

    return written(pairs.mapInArrow(
        measure, "region long, key long, n long, other boolean, firsts array<long>, far array<double>, linked array<boolean>"),
        "jaccard-measured")


def _large_links(sets: DataFrame, settings: Settings) -> DataFrame:
    """Links in regions beyond one task: cell by cell, until a cell fits into a task or gets no smaller."""
    percent, radius = settings.percent, 1 - settings.percent / 100 + 1e-9
    large = sets.filter("large").select(F.col("pivot").alias("region"), "key", "n", "set").dropDuplicates(["region", "key"])
    of_key = large.select("key", "set").dropDuplicates(["key"])
    rows, out, salt = large.withColumn("other", F.lit(True)), None, 0
    size = large.groupBy("region").agg(F.count("*").alias("size"))

    def join(group: pa.Table) -> pa.Table:
        keys, found, at = _unpacked(group)
        other = np.array(group.column("other"))[at]
        return _stars(keys, join_region(found, percent, np.flatnonzero(other), settings))

    while not rows.isEmpty():
        told = _measured(rows, settings, salt)
        each = told.select("region", "key", "n", "other", F.array_min("far").alias("least"), F.expr(
            "array_position(far, array_min(far)) - 1").alias("cell"), F.posexplode(F.arrays_zip("firsts", "far", "linked")).alias("c", "p"))
        stars = each.filter("p.linked AND key <> p.firsts").select(F.col("key").alias("a"), F.col("p.firsts").alias("b"))
        inside = each.filter(F.col("p.far") <= F.col("least") + 2 * radius).select(
            F.xxhash64("region", "c", F.lit(salt)).alias("next"), "region", "key", "n", F.col("p.far").alias("far"),
            F.col("p.linked").alias("linked"), (F.col("other") & (F.col("cell") == F.col("c"))).alias("home"))
        # sets that link with the pivot are connected; what is left are pairs of which one does not
        cells = inside.groupBy("next").agg(
            F.min(F.when(~F.col("linked"), F.col("far"))).alias("from"), F.bool_or("home").alias("asked")).filter(
            "asked AND from IS NOT NULL")
        kept = written(inside.join(cells.select("next", "from"), "next").filter(
            ~F.col("linked") | (F.col("far") >= F.col("from") - radius)).select(
            "next", "region", "key", "n", (~F.col("linked")).alias("other")), "jaccard-cells")
        now = kept.groupBy("next", "region").agg(
            F.count("*").alias("size"), F.sum("n").alias("shingles"), F.sum(F.when(F.col("other"), F.col("n"))).alias("others"))
        fate = now.join(size.withColumnRenamed("size", "before"), "region").select(
            "next", "size", F.ceil(F.col("shingles") / settings.region_shingles).alias("n_member"),
            F.ceil(F.col("others") / settings.region_shingles).alias("n_other"),
            F.when(F.col("shingles") <= settings.region_shingles, "fits")
            .when(F.col("size") <= settings.shrink * F.col("before"), "cut").otherwise("blocks").alias("fate"))
        fate = written(fate, "jaccard-fates")
        placed = kept.join(fate, "next").select("next", "key", "n", "other", "fate", "n_member", "n_other")
        fits = placed.filter("fate = 'fits'").select("next", "key", "other").join(of_key, "key")
        links = stars.unionByName(fits.groupBy("next").applyInArrow(join, _STAR)).unionByName(
            _block_links(placed.filter("fate = 'blocks'"), of_key, join))
        out = links if out is None else out.unionByName(links)
        size = fate.filter("fate = 'cut'").select(F.col("next").alias("region"), "size")
        rows = written(placed.filter("fate = 'cut'").join(of_key, "key").select(
            F.col("next").alias("region"), "key", "n", "set", "other"), "jaccard-rows")
        salt += 1
    return sets.sparkSession.createDataFrame([], _STAR) if out is None else out


def _block_links(rows: DataFrame, of_key: DataFrame, join) -> DataFrame:
    """Links of the others of a region with all of its sets, dealt in blocks of both."""
    deal = lambda n: F.pmod(F.xxhash64("key"), F.col(n))
    over = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    as_other = rows.filter("other").select(
        "next", "key", deal("n_other").alias("o"), over("n_member").alias("m"), F.lit(True).alias("other"))
    as_member = rows.select(
        "next", "key", over("n_other").alias("o"), deal("n_member").alias("m"), F.lit(False).alias("other"))
    dealt = as_other.unionByName(as_member).groupBy("next", "key", "o", "m").agg(F.max("other").alias("other"))
    return dealt.join(of_key, "key").groupBy("next", "o", "m").applyInArrow(join, _STAR)


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge (a, b): the smallest node it is connected with.

    Rounds of large and small stars; each round is written, so lineage stays short.
    """
    now = written(edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("root").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("root"))
        small = large.join(least, "a")
        small = small.select("a", F.col("root").alias("b")).unionByName(
            small.select(F.col("b").alias("a"), F.col("root").alias("b")))
        now = written(small.filter("a <> b").distinct(), "star")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(new) == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = tuple(new)


def _rooted(docs: DataFrame, id_col: str, text_col: str, settings: Settings) -> DataFrame:
    """id, digest, key, n and root (of the component; null without shingles) of every row."""
    rows = _documents(docs, id_col, text_col)
    frequent = _frequent(rows, settings)
    found = written(_met(_shingled(rows, settings, frequent), rows.schema["id"], settings, frequent, False), "jaccard-windows")
    members = found.filter(F.col("kind") == _TEXT).select("id", "digest", "key", "n")
    sets = _region_sets(rows, members.filter("n > 0"), _edges(found, settings, frequent), settings)
    links = written(_small_links(sets, settings).unionByName(_large_links(sets, settings)), "jaccard-links")
    roots = connected(links)
    return members.join(roots, members["key"] == roots["node"], "left").select(
        "id", "digest", "key", "n", F.when(F.col("n") > 0, F.coalesce("root", "key")).alias("root"))


def components_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  settings: Settings = SETTINGS) -> DataFrame:
    """The id column, n_shingles and component_id (the smallest id it is linked with) of every row."""
    rooted = written(_rooted(docs, id_col, text_col, settings), "jaccard-roots")
    names = rooted.filter("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("least"), F.count("*").alias("rows"))
    named = rooted.join(names.filter("rows > 1"), "root", "left")
    return named.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                        F.coalesce("least", "id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         settings: Settings = SETTINGS) -> DataFrame:
    """One row of each component, the one of the smallest id; rows without words all stay."""
    rooted = _rooted(docs, id_col, text_col, settings).filter("root IS NOT NULL")
    kept = rooted.groupBy("root").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("m"))
    kept = kept.select(F.col("m.id").alias("_id"), F.col("m.digest").alias("_digest"))
    text = text_or_empty(text_col)
    whole = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_i"), F.xxhash64(text).alias("_d"),
                        text.rlike(NOT_BLANK).alias("_words"))
    same = whole["_i"].eqNullSafe(kept["_id"]) & (whole["_d"] == kept["_digest"])
    found = whole.filter("_words").join(kept, same, "left_semi")
    # repeated rows have the same id and text: one of them stays, the same in every run
    order = F.xxhash64(F.to_json("_row"))
    first = found.withColumn("_k", F.row_number().over(Window.partitionBy("_i", "_d").orderBy(order))).filter("_k = 1")
    return first.select("_row.*").unionByName(whole.filter("NOT _words").select("_row.*"))


@query()
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of five-word shingles."""
    return components_of(table(spark, sf_dir, "documents"))
