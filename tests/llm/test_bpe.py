import public_tokenizers
from edges import bit_texts, documents
from test_tokens import library

from promptframe.llm.bpe import decode, encode

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_ids_of_edges_in_small_blocks(spark):
    docs = documents(spark)
    want = library()
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1]))
    expected = sorted(((r.doc_id, want.encode_ordinary(r.text or "")) for r in docs.collect()), key=key)
    for chars in (30, 16_000_000):
        encoded = encode(docs, PATH, block_chars=chars)
        assert sorted(((r[0], list(r[1])) for r in encoded.collect()), key=key) == expected
    back = decode(encoded, PATH).collect()
    assert sorted(str(bytes(r.decoded).decode()) for r in back) == sorted(r.text or "" for r in docs.collect())
    assert encode(docs.limit(0), PATH).count() == 0


def test_null_ids_decode_to_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {bytes(r.decoded) for r in decode(df, PATH).collect()} == {b""}


def test_texts_of_equal_polynomial_sums(spark):
    texts = bit_texts()
    docs = spark.createDataFrame(list(enumerate([*texts, " ".join(texts)])), "doc_id long, text string").coalesce(1)
    got = {r[0]: list(r[1]) for r in encode(docs, PATH).collect()}
    assert got == {k: library().encode_ordinary(t) for k, t in enumerate([*texts, " ".join(texts)])}
