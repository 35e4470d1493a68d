"""Packing of token sequences into windows of a fixed length.

Every task packs the documents of its partition on its own, so nothing is shuffled. Documents are
placed online by the sum-of-squares rule: of all fill levels (and a new window) the one is taken
that leaves the smallest sum of squared counts of partially filled windows. The counts live in one
array by level. At the end of a partition the windows still open are closed by cutting: pieces of
the emptiest fill the gaps of the fullest, so that at most one padded window per partition is left.

Added tokens of a JSON vocabulary that a text spells out become their own ids, as in the tokenizers
library. A null or empty text is the single end id. Repeated rows are packed each by itself. A document of
any length is cut into whole windows and a rest. Extra columns of the input are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from promptframe.llm.registry import query, table, text_or_empty
from promptframe.llm.tokens import TextEncoder

#: Open windows a task keeps before it closes them by cutting; bounds its memory.
MAX_OPEN = 4096


class Window:
    """A sequence being filled: its pieces are (document, start, ids)."""

    def __init__(self, number: int):
        self.number, self.fill, self.pieces = number, 0, []

    def add(self, piece) -> None:
        self.pieces.append(piece)
        self.fill += len(piece[2])


class SumOfSquares:
    """Online packing into windows of ``size``, with the number of open windows by fill level."""

    def __init__(self, size: int, first_number: int = 0, max_open: int = MAX_OPEN):
        self.size, self.next, self.max_open = size, first_number, max_open
        self.count = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[Window]] = {}
        self.n_open = 0

    def _new(self) -> Window:
        self.next += 1
        return Window(self.next - 1)

    def level_for(self, length: int) -> int:
        """The level to place ``length`` into; 0 is a new window."""
        count, room = self.count, self.size - length
        # moving a window from h to h + length changes the sum by 2 (N[h + length] - N[h]) + 2,
        # filling it up by 1 - 2 N[h], opening one by 2 N[length] + 1
        change = 2 * (count[length + 1:] - count[1:room + 1]) + 2
        change[-1] = 1 - 2 * count[room]
        change[count[1:room + 1] == 0] = np.iinfo(np.int64).max
        best = room - int(np.argmin(change[::-1]))  # the fullest of equals
        return best if change[best - 1] <= 2 * count[length] + 1 else 0

    def place(self, piece) -> Iterator[Window]:
        """Put a piece of at most ``size`` ids; yields windows that are complete."""
        length = len(piece[2])
        level = self.level_for(length) if length < self.size else 0
        if level:
            window = self.open[level].pop()
            self.count[level] -= 1
            self.n_open -= 1
        else:
            window = self._new()
        window.add(piece)
        if window.fill == self.size:
            yield window
            return
        self.open.setdefault(window.fill, []).append(window)
        self.count[window.fill] += 1
        self.n_open += 1
        if self.n_open > self.max_open:
            yield from self.close()

    def close(self) -> Iterator[Window]:
        """Complete all open windows by cutting pieces; only the last one is not full."""
        rest = sorted((w for ws in self.open.values() for w in ws), key=lambda w: (-w.fill, w.number))
        self.open, self.n_open = {}, 0
        self.count[:] = 0
        i, j = 0, len(rest) - 1
        while i < j:
            target, source = rest[i], rest[j]
            doc, start, ids = source.pieces.pop()
            gap = min(self.size - target.fill, len(ids))
            target.add((doc, start, ids[:gap]))
            source.fill -= len(ids)
            if gap < len(ids):
                source.add((doc, start + gap, ids[gap:]))
            if not source.pieces:
                j -= 1
            if target.fill == self.size:
                yield target
                i += 1
        if i == j:
            yield rest[i]


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048,
         end_id: int = 1, max_open: int = MAX_OPEN) -> DataFrame:
    """Pieces of all documents: the id column, start, length, ids (array), doc_tokens,
    sequence_id and offset in the sequence."""
    rows = docs.select(docs[id_col].alias(id_col), text_or_empty(text_col).alias("text"))
    long, array = T.LongType(), T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField(id_col, rows.schema[0].dataType)] + [
        T.StructField(n, t) for n, t in (("start", long), ("length", long), ("ids", array), ("ids_crc32", long),
                                         ("doc_tokens", long), ("sequence_id", long), ("offset", long))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = TextEncoder(path, added=True)
        packer = SumOfSquares(size, TaskContext.get().partitionId() << 32, max_open)
        end = np.array([end_id], np.uint32)
        id_type, out, held = None, [], 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            arrays = [pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:3])]
            flat = np.concatenate(columns[3]).astype(np.int32)
            ends = np.zeros(len(out) + 1, np.int32)
            np.cumsum(columns[2], out=ends[1:])
            arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            arrays += [pa.array(c, pa.int64()) for c in columns[4:]]
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        def pieces() -> Iterator[Window]:
            nonlocal id_type
            for batch in batches:
                id_type = batch.column(0).type
                names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for name, ids in zip(names, encoder.encode(texts), strict=True):
                    ids = np.concatenate([ids, end])
                    for at in range(0, len(ids), size):
                        yield from packer.place(((name, len(ids)), at, ids[at:at + size].copy()))
            yield from packer.close()

        for window in pieces():
            offset = 0
            for (name, tokens), start, ids in window.pieces:
                out.append((name, start, len(ids), ids, zlib.crc32(ids.astype("<u4").tobytes()), tokens,
                            window.number, offset))
                offset += len(ids)
            held += window.fill
            if held > 1 << 20:
                yield flush()
                out, held = [], 0
        if out:
            yield flush()

    return rows.mapInArrow(run, schema)


@query()
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into windows of 2,048 tokens."""
    import public_tokenizers

    packed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
