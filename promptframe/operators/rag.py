"""Passages of a document that fit a query, to be put into a prompt.

Nearest chunks are found block by block: a document's chunks and its queries are cut
into blocks of bounded size, each pair of blocks is one small matrix problem that
returns at most ``k`` rows per query, and those are merged. Pairs of a query with a
chunk never become rows, and a document of any size is spread over many tasks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from promptframe.functions.keys import doc_hash
from promptframe.functions.text import let, strip
from promptframe.session import path_exists, shared_dir

CHUNK_SIZE = 500
CHUNK_OVERLAP = 50
TOP_K = 5
MODEL = "hashed-words-64"
# Where a text may be cut, coarsest first.
SEPARATORS = ("\n\n", "\n", " ", "")
# up to these settings long paragraphs are cut by patterns, which grow with them
PATTERN_SIZE = 4096
PATTERN_OVERLAP = 256

# rows of one block: a task holds one block of chunks and one of queries
CHUNK_BLOCK = 4096
QUERY_BLOCK = 1024
# a side of a document has this many blocks at the most, unless they would be larger than a task can hold: every
# block of one side is copied to all blocks of the other, so their number must not grow with the rows
MOST_BLOCKS = 8
LARGEST_BLOCK = 65_536
# queries of one matrix product, and its cells
ROWS_AT_ONCE = 256
CELLS_AT_ONCE = 1 << 22


# --- chunks -----------------------------------------------------------------------


def _runs(separator: str, size: int) -> str:
    """Pattern of a piece of at least ``size`` characters, or of all shorter pieces in a row."""
    long = rf"(?:{separator}[^{separator}]{{{size - 1},}}+|\A[^{separator}]{{{size},}}+)"
    return rf"{long}|(?:(?!{long})(?:{separator}[^{separator}]*+|\A[^{separator}]++))++"


def _windows(separator: str, size: int, overlap: int) -> str:
    """Pattern whose first group is a chunk of whole pieces, each shorter than ``size``, and whose matches
    end where the next chunk starts.

    The next chunk starts ``r`` characters before the end of this one, for the largest ``r`` up to
    ``overlap`` that is a place between pieces and leaves room for the piece behind this chunk. Looking back
    from the end, the empty group of that ``r`` is set, and only its way to the start is gone.
    """
    end, head = (rf"(?={separator}|\z)", f"(?={separator})") if separator else ("", "")
    back = range(min(overlap, size - 1), 0, -1)
    found = "".join(rf"(?<={head}(?=.{{{r + 1},{size}}}{end}).{{{r}}})()|" for r in back)
    ways = "".join(rf"\{group}(?>.{{1,{size - r}}}{head}(?=.{{{r}}}{end}))|" for group, r in enumerate(back, 2))
    # a character beyond 16 bits, in a way that is never gone, makes Java look back by whole characters
    return rf"(?s)(?=(.{{1,{size}}}{end})(?:{found}))(?:.{{1,{size}}}+\z|{ways}.{{1,{size}}}{end}|(?!)" + "\U0001f600)"


def _cut(text: Column, size: int, overlap: int, level: int) -> Column:
    """Chunks of a text at one separator of a character or none, in order: a piece that is too long is cut at
    the next separator, those between are packed. Patterns run over the text, so words never are values."""
    separator = SEPARATORS[level]
    packed = lambda run: F.regexp_extract_all(run, F.lit(_windows(separator, size, overlap)), F.lit(1))
    if not separator:
        return packed(text)
    runs = F.regexp_extract_all(text, F.lit(_runs(separator, size)), F.lit(0))
    long = lambda run: (F.length(run) >= size) & (F.locate(separator, run, 2) == 0)
    return F.flatten(F.transform(runs, lambda run: F.when(
        long(run), _cut(run, size, overlap, level + 1)).otherwise(packed(run))))


def _leaves(text: Column, size: int, overlap: int, level: int = 0) -> Column:
    """Pieces of a text shorter than ``size``, or chunks of longer ones, in order, as struct(text, first).

    A text is cut at one separator, which stays at the head of the piece it starts, and pieces that are
    too long are cut at the next; ``first`` marks a piece that is not packed with the one before.
    """
    separator = SEPARATORS[level]
    if level and size <= PATTERN_SIZE and overlap <= PATTERN_OVERLAP:
        return F.transform(_cut(text, size, overlap, level), lambda c: F.struct(c.alias("text"), F.lit(True).alias("first")))
    if not separator:
        return F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)),
                           lambda p, k: F.struct(p.alias("text"), (k == 0).alias("first")))
    parts = F.transform(F.split(text, re.escape(separator), -1), lambda p, k: F.when(k == 0, p).otherwise(
        F.concat(F.lit(separator), p)))

    def cut(pieces: Column) -> Column:
        def leaf(p: Column, k: Column) -> Column:
            first = (k == 0) | (F.length(F.get(pieces, k - 1)) >= size)
            return F.when(F.length(p) < size, F.array(F.struct(p.alias("text"), first.alias("first")))).otherwise(
                _leaves(p, size, overlap, level + 1))

        return F.flatten(F.transform(pieces, leaf))

    return let(F.filter(parts, lambda p: p != ""), cut)


def _packed(leaves: Column, size: int, overlap: int) -> Column:
    """Chunks of at most ``size`` from leaves: a chunk starts with up to ``overlap`` characters of
    whole pieces from the end of the one before.

    One fold over the leaves that holds numbers only: the next leaf, the first one of the open chunk, its
    width, and the ranges of leaves that are chunks.
    """
    def state(at: Column, first: Column, width: Column, out: Column) -> Column:
        return F.struct(at.alias("at"), first.alias("first"), width.alias("width"), out.alias("out"))

    def closed(a: Column) -> Column:
        made = F.struct(a["first"].alias("first"), a["at"].alias("end"))
        return F.when(a["at"] > a["first"], F.array_append(a["out"], made)).otherwise(a["out"])

    def pack(found: Column) -> Column:
        def step(a: Column, leaf: Column) -> Column:
            n = F.length(leaf["text"])

            def dropped(d: Column, held: Column) -> Column:
                over = (d["width"] > overlap) | (d["width"] + n > size)
                return F.when(over, F.struct((d["width"] - F.length(held["text"])).alias("width"), (d["k"] + 1).alias("k"))).otherwise(d)

            held = F.slice(found, a["first"] + 1, a["at"] - a["first"])
            drop = F.aggregate(held, F.struct(a["width"].alias("width"), F.lit(0).alias("k")), dropped)
            full = (a["width"] + n > size) & (a["at"] > a["first"])
            return F.when(leaf["first"], state(a["at"] + 1, a["at"], n, closed(a))).when(
                full, let(drop, lambda d: state(a["at"] + 1, a["first"] + d["k"], d["width"] + n, closed(a)))).otherwise(
                state(a["at"] + 1, a["first"], a["width"] + n, a["out"]))

        none = F.array().cast("array<struct<first:int,end:int>>")
        ranges = F.aggregate(found, state(F.lit(0), F.lit(0), F.lit(0), none), step, closed)
        texts = F.transform(ranges, lambda r: strip(F.array_join(
            F.transform(F.slice(found, r["first"] + 1, r["end"] - r["first"]), lambda x: x["text"]), "")))
        return F.filter(texts, lambda c: c != "")

    return let(leaves, pack)


def chunk(df: DataFrame, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunks of each row's text: the other columns, ``chunk_id`` and ``chunk``.

    The recursive split as columns: cut at the coarsest separator, pack small pieces, and cut
    pieces that are too long at the next separator.
    """
    if size < 2:
        raise ValueError("chunks need a size of two characters at least")
    kept = [F.col(f"`{c}`") for c in df.columns if c != text]
    chunks = _packed(_leaves(F.coalesce(F.col(text), F.lit("")), size, overlap), size, overlap)
    # the inner form would compute the chunks twice, to look for rows without any
    rows = df.select(*kept, F.posexplode_outer(chunks).alias("chunk_id", "chunk"))
    return rows.filter("chunk_id IS NOT NULL").withColumn("chunk_id", F.col("chunk_id").cast("long"))


def fixed_chunks(df: DataFrame, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Fixed windows of ``size`` characters, each starting ``size - overlap`` after the
    last; plain columns, linear in the text."""
    if overlap * 2 > size:
        raise ValueError("overlap may be at most half of the size")
    step = size - overlap
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    cut = df.withColumn("_pieces", pieces)
    windows = F.transform("_pieces", lambda p, i: F.concat(
        p, F.substring(F.coalesce(F.get("_pieces", i + 1), F.lit("")), 1, overlap)))
    # a last piece that the window before already holds is no window of its own
    n = F.size("_pieces")
    inside = (n > 1) & (F.length(F.get("_pieces", n - 1)) <= overlap)
    wanted = F.slice(windows, F.lit(1), F.when(inside, n - 1).otherwise(n))
    kept = [F.col(f"`{c}`") for c in df.columns if c != text]
    # the inner form would compute the windows twice, to look for rows without any
    rows = cut.select(*kept, F.posexplode_outer(wanted).alias("chunk_id", "chunk"))
    return rows.filter("chunk_id IS NOT NULL").withColumn("chunk_id", F.col("chunk_id").cast("long"))


# --- vectors ----------------------------------------------------------------------


def hashed_words(texts: pd.Series, width: int = 64) -> pd.Series:
    """Unit vector of hashed word counts: the same text gives the same vector."""
    out = []
    for text in texts:
        v = np.zeros(width)
        for word in re.findall(r"\w+", (text or "").lower()):
            v[zlib.crc32(word.encode()) % width] += 1.0
        norm = np.sqrt((v * v).sum())
        out.append((v / norm if norm else v).astype("float32"))
    return pd.Series(out)


def embed(df: DataFrame, text: str, fn: Callable[[pd.Series], pd.Series] = hashed_words) -> DataFrame:
    """Add ``embedding``; ``fn`` maps a series of texts to a series of vectors."""
    @F.pandas_udf("array<float>")
    def vectors(s: pd.Series) -> pd.Series:
        return fn(s)

    return df.withColumn("embedding", vectors(F.col(text)))


def new_documents(docs: DataFrame, text: str, index: DataFrame | None, size: int = CHUNK_SIZE,
                  overlap: int = CHUNK_OVERLAP, model: str = MODEL, key: str | None = None) -> DataFrame:
    """Distinct documents that are not indexed with these settings: ``doc_hash``, text.

    Documents that are distinct already, with their hash in ``key``, are not compared again.
    """
    if key is not None:
        distinct = docs.select(F.col(key).alias("doc_hash"), F.col(text).alias("text"))
    else:
        distinct = docs.select(doc_hash(F.col(text)).alias("doc_hash"), F.col(text).alias("text")
                               ).dropDuplicates(["doc_hash"])
    if index is None:
        return distinct
    same = index.filter((F.col("chunk_size") == size) & (F.col("chunk_overlap") == overlap)
                        & (F.col("model") == model)).select("doc_hash").distinct()
    return distinct.join(same, "doc_hash", "left_anti")


def index_documents(docs: DataFrame, text: str, path: str, size: int = CHUNK_SIZE,
                    overlap: int = CHUNK_OVERLAP, model: str = MODEL,
                    fn: Callable[[pd.Series], pd.Series] = hashed_words,
                    index: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """Append chunks of new documents to the index at ``path`` and return its chunks for
    these settings. Vectors cost money, so they are written once and read back."""
    fresh = new_documents(docs, text, index, size, overlap, model, key)
    rows = embed(chunk(fresh, "text", size, overlap), "chunk", fn).withColumns({
        "chunk_size": F.lit(size), "chunk_overlap": F.lit(overlap), "model": F.lit(model)})
    rows.write.mode("append").parquet(path)
    everything = docs.sparkSession.read.parquet(path)
    return everything.filter((F.col("chunk_size") == size) & (F.col("chunk_overlap") == overlap)
                             & (F.col("model") == model))


def embed_queries(queries: DataFrame, text: str, cache: DataFrame | None = None,
                  fn: Callable[[pd.Series], pd.Series] = hashed_words) -> DataFrame:
    """``query_hash``, ``embedding`` of each distinct query; only unseen ones are embedded."""
    distinct = queries.select(doc_hash(F.col(text)).alias("query_hash"), F.col(text).alias("query")
                              ).dropDuplicates(["query_hash"])
    if cache is None:
        return embed(distinct, "query", fn).select("query_hash", "embedding")
    fresh = distinct.join(cache.select("query_hash"), "query_hash", "left_anti")
    known = cache.join(distinct.select("query_hash"), "query_hash", "left_semi")
    return embed(fresh, "query", fn).select("query_hash", "embedding").unionByName(
        known.select("query_hash", "embedding"))


def cached_queries(queries: DataFrame, text: str, path: str, model: str = MODEL,
                   fn: Callable[[pd.Series], pd.Series] = hashed_words) -> DataFrame:
    """``query_hash``, ``embedding`` of each distinct query, kept in the cache at ``path``: only
    queries it does not hold yet are embedded, and appended to it."""
    spark = queries.sparkSession
    asked = queries.select(doc_hash(F.col(text)).alias("query_hash"), F.col(text).alias("query")).dropDuplicates(["query_hash"])

    def kept() -> DataFrame:
        return spark.read.parquet(path).filter(F.col("model") == model)

    fresh = asked
    if path_exists(spark, f"{path}/_SUCCESS"):
        fresh = asked.join(kept().select("query_hash"), "query_hash", "left_anti")
    embed(fresh, "query", fn).select("query_hash", "embedding", F.lit(model).alias("model")).write.mode("append").parquet(path)
    # two writers at once may both have embedded a query
    return kept().join(asked.select("query_hash"), "query_hash", "left_semi").dropDuplicates(["query_hash"]).select(
        "query_hash", "embedding")


# --- nearest chunks ---------------------------------------------------------------


def _nearest(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    out = pa.schema([("doc_hash", pa.string()), ("query_hash", pa.string()),
                     ("chunk_id", pa.int64()), ("distance", pa.float64())])

    def matrix(table: pa.Table) -> np.ndarray:
        flat = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(table.num_rows, -1)

    def by_document(table: pa.Table) -> tuple[pa.Table, dict[str, slice]]:
        ordered = table.sort_by("doc_hash")
        names = np.array(ordered.column("doc_hash").to_pylist(), dtype=object)
        starts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
        return ordered, {names[a]: slice(a, b) for a, b in zip(starts, [*starts[1:], len(names)])}

    def solve(queries: pa.Table, chunks: pa.Table) -> pa.Table:
        if not queries.num_rows or not chunks.num_rows:
            return out.empty_table()
        queries, asked = by_document(queries)
        chunks, held = by_document(chunks)
        vectors, points = matrix(queries), matrix(chunks)
        names, ids = queries.column("query_hash").to_pylist(), chunks.column("chunk_id").to_numpy()
        found: dict[str, list] = {n: [] for n in out.names}
        for doc, rows in asked.items():
            if doc not in held:
                continue
            # an index that two writers added a document to holds its chunks twice
            numbers, once = np.unique(ids[held[doc]], return_index=True)
            here = points[held[doc]][once].astype("float64")
            length = (here * here).sum(axis=1)
            at_once = max(1, min(ROWS_AT_ONCE, CELLS_AT_ONCE // len(numbers)))
            for start in range(rows.start, rows.stop, at_once):
                stop = min(start + at_once, rows.stop)
                asked_here = vectors[start:stop].astype("float64")
                # one matrix product finds who can be near; only those are measured exactly
                rough = length - 2 * asked_here @ here.T + (asked_here * asked_here).sum(axis=1)[:, None]
                if len(numbers) > k:
                    bound = np.partition(rough, k - 1, axis=1)[:, k - 1:k]
                    row, near = np.nonzero(rough <= bound + 1e-9 * (1 + np.abs(bound)))
                else:
                    row, near = np.divmod(np.arange(rough.size), len(numbers))
                distance = ((here[near] - asked_here[row]) ** 2).sum(axis=1)
                order = np.lexsort((numbers[near], distance, row))
                row, near, distance = row[order], near[order], distance[order]
                kept = np.arange(len(row)) - np.searchsorted(row, row) < k
                found["doc_hash"].extend([doc] * int(kept.sum()))
                found["query_hash"].extend(names[start + r] for r in row[kept].tolist())
                found["chunk_id"].extend(numbers[near[kept]].tolist())
                found["distance"].extend(distance[kept].tolist())
        return pa.table(found, schema=out)

    return solve


def _block_count(rows: Column, least: int) -> Column:
    """Blocks of one side of a document: of ``least`` rows or of more."""
    return F.least(F.ceil(rows / least), F.greatest(F.lit(MOST_BLOCKS), F.ceil(rows / LARGEST_BLOCK))).cast("int")


def retrieve(queries: DataFrame, chunks: DataFrame, k: int = TOP_K, chunk_block: int = CHUNK_BLOCK,
             query_block: int = QUERY_BLOCK, rows: tuple[int, int] | None = None) -> DataFrame:
    """The ``k`` chunks of its document nearest to each query (squared distance).

    ``queries``: ``doc_hash, query_hash, embedding``, distinct; ``chunks``: ``doc_hash,
    chunk_id`` (any numbers, one for each chunk; copies of a chunk count once), ``embedding``; documents
    without queries may be among them. Ties go to the lower id.

    A document of one block shares its task with other small ones; a larger one gets a
    task per pair of a chunk block and a query block. Blocks grow with the document from the given
    sizes on, since their number is how often a row is copied. The counts of chunks and queries,
    ``rows`` if they are known, only size those shared tasks.
    """
    n_chunks, n_queries = rows or (chunks.count(), queries.count())
    shared = max(1, -(-n_chunks // chunk_block), -(-n_queries // query_block))
    # both sides may come from one table: give their columns identities of their own
    queries = queries.select(*[F.col(c).alias(c) for c in ("doc_hash", "query_hash", "embedding")])
    chunks = chunks.select(*[F.col(c).alias(c) for c in ("doc_hash", "chunk_id", "embedding")])
    chunk_blocks = chunks.groupBy("doc_hash").agg(
        _block_count(F.count(F.lit(1)), chunk_block).alias("_chunk_blocks"))
    query_blocks = queries.groupBy("doc_hash").agg(
        _block_count(F.count(F.lit(1)), query_block).alias("_query_blocks"))
    blocks = chunk_blocks.join(query_blocks, "doc_hash")

    def numbers(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), n - 1))

    task = F.when(
        (F.col("_chunk_blocks") == 1) & (F.col("_query_blocks") == 1),
        F.concat(F.lit("small/"), F.pmod(F.xxhash64("doc_hash"), F.lit(shared)).cast("string"))
    ).otherwise(F.concat_ws("/", "doc_hash", F.col("_cb").cast("string"), F.col("_qb").cast("string")))
    asked = queries.join(blocks, "doc_hash").select(
        "*", F.pmod(F.xxhash64("query_hash"), F.col("_query_blocks")).cast("int").alias("_qb"),
        numbers(F.col("_chunk_blocks")).alias("_cb")
    ).select(task.alias("_task"), "doc_hash", "query_hash", "embedding")
    held = chunks.withColumn("chunk_id", F.col("chunk_id").cast("long")).join(blocks, "doc_hash").select(
        "*", F.pmod(F.xxhash64("chunk_id"), F.col("_chunk_blocks")).cast("int").alias("_cb"),
        numbers(F.col("_query_blocks")).alias("_qb")
    ).select(task.alias("_task"), "doc_hash", "chunk_id", "embedding")
    partial = asked.groupBy("_task").cogroup(held.groupBy("_task")).applyInArrow(
        _nearest(k), "doc_hash string, query_hash string, chunk_id bigint, distance double")
    best = Window.partitionBy("doc_hash", "query_hash").orderBy("distance", "chunk_id")
    return partial.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def passages(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Texts of the found chunks."""
    return hits.join(chunks.select("doc_hash", "chunk_id", "chunk"), ["doc_hash", "chunk_id"])


def format_passages(queries: DataFrame, found: DataFrame, fmt: str | None = None) -> DataFrame:
    """``doc_hash, query_hash, value``: passages of each query in rank order.

    ``text`` joins them with a rule, or says ``(empty)``; ``json`` and no format give a
    JSON array, indented for ``json``. At most the retrieved number is held per query. A
    passage that was found in two copies of its chunk counts once.
    """
    if fmt not in (None, "text", "json"):
        raise ValueError(f"unknown format {fmt!r}")
    keys = ["doc_hash", "query_hash"]
    listed = found.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("rank", "chunk"))).alias("_found"))
    rows = queries.select(*keys).distinct().join(listed, keys, "left")
    texts = F.transform(F.coalesce(F.col("_found"), F.array().cast("array<struct<rank:int,chunk:string>>")),
                        lambda r: r["chunk"])
    if fmt == "text":
        value = F.when(F.size(texts) == 0, "(empty)").otherwise(F.array_join(texts, "----\n"))
    elif fmt == "json":
        quoted = F.transform(texts, lambda t: F.substring(
            F.to_json(F.array(t)), F.lit(2), F.length(F.to_json(F.array(t))) - 2))
        value = F.when(F.size(texts) == 0, "[]").otherwise(
            F.concat(F.lit("[\n  "), F.array_join(quoted, ",\n  "), F.lit("\n]")))
    else:
        value = F.to_json(texts)
    return rows.select(*keys, value.alias("value"))


class PassageFunction:
    """``{{document(query)}}``: passages of this combination's document for its query.

    With ``index``, a folder, chunk vectors are kept there by document, settings and model, and query
    vectors by text and model: a document or query that is asked for again is not embedded again.
    """

    def __init__(self, document: str, chunk_size: int = CHUNK_SIZE, chunk_overlap: int = CHUNK_OVERLAP,
                 return_format: str | None = None, model_name: str = MODEL, k: int = TOP_K,
                 fn: Callable[[pd.Series], pd.Series] = hashed_words, index: str | None = None):
        self.document, self.size, self.overlap = document, chunk_size, chunk_overlap
        self.fmt, self.model, self.k, self.fn, self.index = return_format, model_name, k, fn, index

    def variables(self, params: Sequence[str]) -> list[str]:
        if not params:
            raise ValueError("a passage call needs the name of the query variable")
        return list(dict.fromkeys([self.document, params[0]]))

    def apply(self, calls: DataFrame, texts: Mapping[str, DataFrame], params: Sequence[str]) -> DataFrame:
        spark, query = calls.sparkSession, params[0]
        folder = self.index.rstrip("/") if self.index else shared_dir(spark, "index")
        # the keys come from whole texts, and several steps below read them
        path = shared_dir(spark, "calls")
        calls.select(F.col(self.document).alias("doc_hash"), F.col(query).alias("query_hash")).write.parquet(path)
        pairs = spark.read.parquet(path)
        known = spark.read.parquet(f"{folder}/chunks") if path_exists(spark, f"{folder}/chunks/_SUCCESS") else None
        # the index may hold documents that nobody asks for here, and two writers may both have added one
        chunks = index_documents(texts[self.document], "text", f"{folder}/chunks", self.size, self.overlap, self.model,
                                 self.fn, known, "key")
        vectors = cached_queries(texts[query], "text", f"{folder}/queries", self.model, self.fn)
        queries = pairs.join(vectors, "query_hash")
        found = passages(retrieve(queries, chunks, self.k, rows=(chunks.count(), pairs.count())), chunks)
        return format_passages(pairs, found, self.fmt).select(
            F.col("doc_hash").alias(self.document),
            *([F.col("query_hash").alias(query)] if query != self.document else []), "value")


def passage_functions(rag: dict, index: str | None = None,
                      fn: Callable[[pd.Series], pd.Series] = hashed_words) -> dict[str, PassageFunction]:
    """Prompt functions of a project's retrieval settings, each with its own settings, on one index."""
    known = ("chunk_size", "chunk_overlap", "return_format", "model_name")
    return {name: PassageFunction(name, **{k: v for k, v in conf.items() if k in known}, fn=fn, index=index)
            for name, conf in rag.items()}
