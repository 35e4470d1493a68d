import zlib

import numpy as np
import public_tokenizers
from edges import bit_texts, documents
from tokenizers import Tokenizer

from promptframe.llm.packing import SumOfSquares, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_pieces_cover_every_id_once(spark):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    docs = documents(spark).filter("doc_id IS NULL OR doc_id <> 3").repartition(2, "doc_id")
    ids = {r.doc_id: np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
           for r in docs.collect()}
    pieces = pack(docs, PATH, size=64, max_open=3).collect()
    covered, sequences = {}, {}
    for r in pieces:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and list(r.ids) == own[r.start:r.start + r.length].tolist()
        assert r.ids_crc32 == zlib.crc32(own[r.start:r.start + r.length].tobytes())
        covered.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, own in ids.items():
        at = 0
        for start, length in sorted(covered[doc]):
            assert start == at
            at += length
        assert at == len(own)
    fills = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        fills.append(at)
    assert max(fills) <= 64 and sum(f < 64 for f in fills) <= 2


def test_repeated_rows_and_empty_tables(spark):
    docs = documents(spark)
    assert pack(docs, PATH).filter("doc_id = 3").selectExpr("sum(length)").first()[0] == 2 * pack(
        docs, PATH).filter("doc_id = 3").first().doc_tokens
    assert pack(docs.limit(0), PATH).count() == 0


def test_added_tokens_in_texts_are_those_of_the_library(spark):
    tokenizer, eot = Tokenizer.from_file(PATH), "<|endoftext|>"
    texts = [f"a {eot} b", eot, eot * 3, f"{eot}x", f"x  \n{eot}  \n y {eot}", f"it{eot}'s", "<|endof", "text|> é",
             f"<|endof{eot}text|>", f"1{eot}2 " * 700, "plain", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {}
    for r in pack(docs, PATH, size=64).collect():
        got.setdefault(r.doc_id, []).append((r.start, list(r.ids), r.doc_tokens, r.ids_crc32))
    for k, text in enumerate(texts):
        want = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        assert [i for p in sorted(got[k]) for i in p[1]] == want and {p[2] for p in got[k]} == {len(want)}
        assert all(p[3] == zlib.crc32(np.array(p[1], "<u4").tobytes()) for p in got[k])
    assert got[0][0][1][:4] == [64, 220, 50256, 275]


def test_texts_of_equal_polynomial_sums(spark):
    texts = bit_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    tokenizer = Tokenizer.from_file(PATH)
    got = {r.doc_id: list(r.ids)[:-1] for r in pack(docs, PATH).collect()}
    assert got == {k: tokenizer.encode(t, add_special_tokens=False).ids for k, t in enumerate(texts)}


def test_the_level_has_the_smallest_sum_of_squares():
    rng = np.random.default_rng(4)
    for _ in range(60):
        size = int(rng.integers(4, 14))
        packer = SumOfSquares(size)
        for _ in range(80):
            length = int(rng.integers(1, size))
            levels = [0, *[h for h in range(1, size - length + 1) if packer.count[h]]]

            def after(h):
                count = packer.count.copy()
                count[h] -= h > 0
                count[h + length] += h + length < size
                return int((count[1:size] ** 2).sum())

            best = packer.level_for(length)
            assert best in levels and after(best) == min(map(after, levels))
            list(packer.place((0, 0, np.zeros(length, np.uint32))))
