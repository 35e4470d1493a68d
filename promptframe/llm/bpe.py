"""Byte-level BPE over a corpus: every distinct pre-token is encoded once, by a shuffle on words.

Tasks split their documents into pre-tokens and gather them in blocks. A block's document is the
sequence of its pre-tokens' numbers in the block; a block's distinct words are dealt to buckets by
digest, so that the occurrences of a word over the corpus meet in one task, which encodes it once.
Words are compared as a whole wherever their digests meet, so two different ones never share ids.
The ids go back to their blocks, where each document is put together by position. Rows of a scan keep
their partition and order, so both readings of the texts give the same blocks; where they do not,
the query fails instead of giving wrong ids. Only numbers and distinct words move, packed and compressed, never exploded rows of single occurrences. Decoding is
a lookup in the table of token bytes, which has one row per rank and so a fixed size.

A null text counts as empty and has no ids. Repeated rows are encoded each by itself; a text of any
length stays whole in its block. Extra columns of the input are never read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptframe.llm.registry import query, table, text_or_empty
from promptframe.llm.tokens import Names, chunks, mixed, pretokens, ragged, vocabulary

#: Characters of a block; one longer text is a block of its own.
BLOCK_CHARS = 8_000_000
#: Words whose ids a task remembers; beyond it the memory starts anew, which changes no result.
KEEP_WORDS = 500_000
_LAYOUT, _DOCUMENT = -1, -2


def _packed(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers with equal bytes side by side, compressed."""
    import zstandard

    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(planes.tobytes(), 3)


def _unpacked(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _pack_words(words: list[bytes]) -> bytes:
    import zstandard

    lengths = _packed(np.array([len(w) for w in words]))
    return struct.pack("<I", len(lengths)) + lengths + zstandard.compress(b"".join(words), 3)


def _unpack_words(data: bytes) -> list[bytes]:
    import zstandard

    n = struct.unpack_from("<I", data)[0]
    ends = np.cumsum(_unpacked(data[4:4 + n]).astype(np.int64)).tolist()
    every = zstandard.decompress(data[4 + n:])
    return [every[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def _blocks(rows: DataFrame, buckets: int, block_chars: int, want_words: bool) -> DataFrame:
    """Rows (block, bucket, id, packed) of the words, or of the documents and the block itself.

    Of each bucket the block's words in it by rank; or of a document its pre-tokens as ranks by
    frequency in the block, and of a block the bucket of every rank.
    """
    id_field = rows.schema[0]
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()),
                           T.StructField("id", id_field.dataType), T.StructField("packed", T.BinaryType())])

    def block_rows(number: int, names: list, digests: list, ends: list, words: Names, id_type) -> pa.RecordBatch:
        digest = np.concatenate(digests) if digests else np.zeros(0, np.uint64)
        unique, which, count = np.unique(digest, return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        unique = unique[order]
        bucket = (mixed(unique) % np.uint64(buckets)).astype(np.int64)
        out, start = [], 0
        if want_words:
            by_bucket = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[by_bucket])) + 1
            for ranks in np.split(by_bucket, cuts) if len(by_bucket) else []:
                out.append((int(bucket[ranks[0]]), None, _pack_words([words.words[d].encode("utf-8", "replace") for d in unique[ranks].tolist()])))
        else:
            out.append((_LAYOUT, None, _packed(bucket)))
            for name, end in zip(names, ends, strict=True):
                out.append((_DOCUMENT, name, _packed(rank[which[start:end]])))
                start = end
        if not out:
            return pa.RecordBatch.from_pylist([], schema=pa.schema(
                [("block", pa.int64()), ("bucket", pa.int32()), ("id", id_type), ("packed", pa.binary())]))
        kinds, names, data = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([number] * len(out), pa.int64()), pa.array(kinds, pa.int32()), pa.array(names, id_type),
             pa.array(data, pa.binary())], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        names, digests, ends, words, chars, total, id_type = [], [], [], Names(), 0, 0, None
        for batch in batches:
            id_type = batch.column(0).type
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                if names and chars + sum(map(len, texts[a:b])) > block_chars:
                    yield block_rows(number, names, digests, ends, words, id_type)
                    names, digests, ends, words, chars, total = [], [], [], Names(), 0, 0
                    number += 1
                joined, begin, end, digest, before = pretokens(texts[a:b], words)
                unique, where = np.unique(digest, return_index=True) if want_words else (digest[:0], [])
                for d, s, e in zip(unique.tolist(), begin[where].tolist(), end[where].tolist(), strict=True):
                    words.words.setdefault(d, joined[s:e])
                names += ids[a:b]
                digests.append(digest)
                ends += (total + before[1:]).tolist()
                total += len(digest)
                chars += len(joined)
        if names:
            yield block_rows(number, names, digests, ends, words, id_type)

    return rows.mapInArrow(run, schema)


def _with_ids(rows: DataFrame, path: str) -> DataFrame:
    """The rows of words with ids in place of the words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, known = vocabulary(path).piece, {}
        for batch in batches:
            out = []
            for data in batch.column(3).to_pylist():
                if len(known) > KEEP_WORDS:
                    known.clear()
                flat, lengths = [], []
                for word in _unpack_words(data):
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = piece(word)
                    flat += ids
                    lengths.append(len(ids))
                head = _packed(np.array(lengths))
                out.append(struct.pack("<I", len(head)) + head + _packed(np.array(flat)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())],
                                             names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def _assembled(rows: DataFrame, id_col: str) -> DataFrame:
    """Documents from the rows of their block: numbers replaced by ids, in the order of the text."""
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType),
                           T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def block(group: pa.Table) -> pa.Table:
        kinds, data = np.array(group.column("bucket")), group.column("packed").to_pylist()
        layouts = np.flatnonzero(kinds == _LAYOUT)
        if len(layouts) != 1:
            raise ValueError("the rows of a block come from different splits of the input")
        bucket = _unpacked(data[layouts[0]])
        length, start = np.full(len(bucket), -1, np.int64), np.zeros(len(bucket), np.int64)
        flat, first = [], 0
        for k in np.flatnonzero(kinds >= 0).tolist():
            n = struct.unpack_from("<I", data[k])[0]
            lengths, ids = _unpacked(data[k][4:4 + n]).astype(np.int64), _unpacked(data[k][4 + n:])
            at = np.flatnonzero(bucket == kinds[k])
            length[at] = lengths
            start[at] = first + np.cumsum(lengths) - lengths
            flat.append(ids)
            first += len(ids)
        if (length < 0).any():
            raise ValueError("the rows of a block come from different splits of the input")
        flat = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
        documents = np.flatnonzero(kinds == _DOCUMENT)
        out = [ragged(flat, start, length, _unpacked(data[k])) for k in documents.tolist()]
        ends = np.zeros(len(out) + 1, np.int32)
        np.cumsum([len(x) for x in out], out=ends[1:])
        ids = np.concatenate(out).astype(np.int32) if out else np.zeros(0, np.int32)
        return pa.table([group.column("id").combine_chunks().take(pa.array(documents)),
                         pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], names=schema.names)

    return rows.groupBy("block").applyInArrow(block, schema)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
           block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The id column and the token ids (array of int) of every text, by the ranks at ``path``."""
    rows = docs.select(docs[id_col].alias(id_col), text_or_empty(text_col).alias("text"))
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the texts are split once for their words and once for their documents: splitting again is
    # cheaper than moving the documents along with the words
    words = _blocks(rows, buckets, block_chars, True).repartition(buckets, "bucket")
    documents = _blocks(rows, buckets, block_chars, False)
    return _assembled(documents.unionByName(_with_ids(words, path)), id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id column, the ids as little-endian unsigned 32-bit bytes, and the bytes they stand for.

    Null ids count as none; an id without a token raises an error.
    """
    rows = encoded.select(encoded[id_col].alias(id_col), encoded[ids_col].cast("array<int>").alias("ids"))
    schema = T.StructType([rows.schema[0], T.StructField("ids_bytes", T.BinaryType()),
                           T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(path)
        for batch in batches:
            raw, decoded = [], []
            for k in range(batch.num_rows):
                ids = batch.column(1)[k].values
                ids = np.zeros(0, np.uint32) if ids is None else ids.to_numpy().astype("<u4")
                raw.append(ids.tobytes())
                decoded.append(tokens.decode(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(raw, pa.binary()), pa.array(decoded, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


@query()
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, and its ids decoded again."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    decoded = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return decoded.select(
        "doc_id", (F.length("ids_bytes") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids_bytes", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
