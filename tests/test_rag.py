import json
import random
import re
import sys
from collections import deque

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from hypothesis import given, settings, strategies as st

from promptframe.operators import rag
from promptframe.operators.grid import expand
from promptframe.sources.files import group_from_rows
from promptframe.sources.project import Project


cloudpickle.register_pickle_by_value(sys.modules[__name__])


# --- the split as plain Python, which the columns must agree with ---


def _cut(text, separator):
    """Pieces of a text; a separator stays at the head of the piece it starts."""
    if not separator:
        return list(text)
    head, *rest = text.split(separator)
    return [p for p in (head, *(separator + r for r in rest)) if p]


def _join(pieces, size, overlap):
    """Pack pieces into chunks of at most ``size``; a chunk starts with up to
    ``overlap`` characters of whole pieces from the end of the one before."""
    held = deque()
    width = 0
    for piece in pieces:
        if width + len(piece) > size:
            if held:
                yield "".join(held).strip()
            while held and (width > overlap or width + len(piece) > size):
                width -= len(held.popleft())
        held.append(piece)
        width += len(piece)
    if held:
        yield "".join(held).strip()


def split_text(text, size, overlap, separators=rag.SEPARATORS):
    """Recursive split: cut at the coarsest separator present, pack small pieces, and
    cut pieces that are too long at the next separator."""
    at = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    finer = separators[at + 1:]
    out, small = [], []
    for piece in _cut(text, separators[at]):
        if len(piece) < size:
            small.append(piece)
            continue
        out.extend(_join(small, size, overlap))
        small = []
        out.extend(split_text(piece, size, overlap, finer) if finer else [piece])
    out.extend(_join(small, size, overlap))
    return [c for c in out if c]


def test_split_examples():
    assert split_text("a b c", 10, 0) == ["a b c"]
    assert split_text("", 10, 0) == [] and split_text("  \n ", 10, 0) == []
    assert split_text("aaaa bbbb cccc", 9, 0) == ["aaaa bbbb", "cccc"]
    assert split_text("aaaa bbbb cccc dddd", 10, 5) == ["aaaa bbbb", "bbbb cccc", "cccc dddd"]
    # a separator opens the piece it stands before, and counts for its length
    assert split_text("one\n\ntwo three\n\nfour", 12, 0) == ["one", "two three", "four"]
    assert split_text("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é\n.", max_size=200), st.integers(4, 30), st.integers(0, 3))
def test_split_keeps_the_text(text, size, overlap):
    chunks = split_text(text, size, overlap)
    assert all(0 < len(c) <= size and c in text for c in chunks)
    bare = "".join("".join(split_text(text, size, 0)).split())
    assert bare == "".join(text.split())  # nothing but space is lost


@pytest.mark.parametrize("size,overlap", [(2, 0), (5, 1), (12, 5), (30, 29), (500, 50)])
def test_chunks_agree_with_the_plain_split(spark, size, overlap):
    rng = random.Random(size)
    pieces = ["word", "a", " ", "  ", "\n", "\n\n", "\n\n\n", "é😀", ".", "verylongwordwithoutanyblank", "\t", "\u2003x"]
    texts = ["", None, " \n\n ", "x" * 1200] + ["".join(rng.choices(pieces, k=rng.randint(0, 120))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {}
    for r in rag.chunk(df, "t", size, overlap).orderBy("k", "chunk_id").collect():
        got.setdefault(r["k"], []).append(r["chunk"])
    for k, t in enumerate(texts):
        assert got.get(k, []) == split_text(t or "", size, overlap), t
    assert "Python" not in rag.chunk(df, "t")._jdf.queryExecution().toString()


@pytest.mark.parametrize("size,overlap,kinds", [
    (500, 50, "words"), (40, 39, "words"), (40, 200, "words"), (500, 50, "lines"), (12, 5, "spaces"), (7, 6, "faces"), (3, 1, "faces")])
@pytest.mark.parametrize("patterns", [True, False])
def test_long_paragraphs_agree_with_the_plain_split(spark, monkeypatch, size, overlap, kinds, patterns):
    """By patterns, and by the fold that settings beyond them take."""
    if not patterns:
        monkeypatch.setattr(rag, "PATTERN_SIZE", 0)
    rng = random.Random(size + overlap)
    drawn = {
        "words": lambda: rng.choice("ab é") * rng.choice([1, 3, 7, 30, 60]) + rng.choice([" ", "  ", "\n"]),
        "lines": lambda: "x" * rng.choice([1, 90, 200, 480, 498, 499, 500, 501, 1300]) + rng.choice(["\n", "\n", "\n\n", "\n\n\n", " "]),
        "spaces": lambda: rng.choice([" ", "\n", "\n\n", "a", "\t", "\u2003"]) * rng.randint(1, 4),
        "faces": lambda: rng.choice(["😀", "é", "a😀", " ", "\n", "😀 😀"]) * rng.randint(1, 5)}[kinds]
    texts = ["".join(drawn() for _ in range(rng.randint(1, 60))) for _ in range(150)]
    got = {}
    for r in rag.chunk(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "t", size, overlap).orderBy("k", "chunk_id").collect():
        got.setdefault(r["k"], []).append(r["chunk"])
    for k, t in enumerate(texts):
        assert got.get(k, []) == split_text(t, size, overlap), t


def test_words_of_long_paragraphs_are_no_values(spark):
    """The fold over a text meets a chunk of a long paragraph once, not each of its words."""
    df = spark.createDataFrame([("some words " * 3000,), ("a line of words\n" * 2000,), ("x" * 30_000,)], "t string")
    sizes = [r[0] for r in df.select(F.size(rag._leaves(F.col("t"), 500, 50))).collect()]
    assert sizes == [len(split_text(t, 500, 50)) for t in ("some words " * 3000, "a line of words\n" * 2000, "x" * 30_000)]
    assert max(sizes) < 100


@pytest.mark.parametrize("size,overlap", [(10, 0), (10, 3), (10, 5), (7, 2)])
def test_fixed_windows(spark, size, overlap):
    texts = ["", "abc", "a" * 10, "é😀" * 9, "0123456789" * 7 + "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {}
    for r in rag.fixed_chunks(df, "t", size, overlap).orderBy("k", "chunk_id").collect():
        got.setdefault(r["k"], []).append(r["chunk"])
    step = size - overlap
    for i, t in enumerate(texts):
        want = [t[a:a + size] for a in range(0, len(t), step)]
        while len(want) > 1 and len(want[-1]) <= overlap:
            want.pop()
        assert got.get(i, []) == want


def test_chunk_rows(spark):
    df = spark.createDataFrame([(1, "word " * 300), (2, None), (3, "x")], "k int, t string")
    rows = rag.chunk(df, "t", 100, 10).orderBy("k", "chunk_id").collect()
    assert [r["chunk"] for r in rows if r["k"] == 1] == split_text("word " * 300, 100, 10)
    assert [r["chunk"] for r in rows if r["k"] == 3] == ["x"] and not [r for r in rows if r["k"] == 2]


@pytest.mark.parametrize("chunk_block,query_block", [(4, 3), (7, 1000), (1000, 2), (1000, 1000)])
def test_nearest_against_brute_force(spark, chunk_block, query_block):
    rng = np.random.default_rng(1)
    # one document holds a third of everything; small integers make many equal distances
    docs = {"hot": (60, 20), "b": (40, 9), "c": (3, 30), "lonely": (9, 0), "empty": (0, 4)}
    vec = lambda: [float(x) for x in rng.integers(0, 3, 4)]
    chunks = [(d, i, vec()) for d, (n, _) in docs.items() for i in range(n)]
    queries = [(d, f"{d}{i}", vec()) for d, (_, n) in docs.items() for i in range(n)]
    got = rag.retrieve(
        spark.createDataFrame(queries, "doc_hash string, query_hash string, embedding array<float>"),
        spark.createDataFrame(chunks, "doc_hash string, chunk_id bigint, embedding array<float>").repartition(5),
        5, chunk_block, query_block).collect()
    want = set()
    for d, q, v in queries:
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, e)), i) for dd, i, e in chunks if dd == d)[:5]
        want |= {(d, q, rank, i, dist) for rank, (dist, i) in enumerate(near, 1)}
    assert {(r["doc_hash"], r["query_hash"], r["rank"], r["chunk_id"], r["distance"]) for r in got} == want
    assert len(got) == len(want)


def test_copies_of_a_row_do_not_grow_with_its_document(spark, monkeypatch):
    """The blocks of one side are the copies of every row of the other."""
    counts = spark.createDataFrame([(n,) for n in (1, 64, 65, 1000, 60_000, 10**6)], "n bigint")
    assert [r[0] for r in counts.select(rag._block_count(F.col("n"), 64)).collect()] == [1, 1, 2, 8, 8, 16]
    monkeypatch.setattr(rag, "MOST_BLOCKS", 2)
    monkeypatch.setattr(rag, "CELLS_AT_ONCE", 30)
    test_nearest_against_brute_force(spark, 1, 1)


def test_formats(spark):
    queries = spark.createDataFrame([("d", "q"), ("d", "none")], "doc_hash string, query_hash string")
    found = spark.createDataFrame([("d", "q", 2, 'b "é"'), ("d", "q", 1, "a\n")], "doc_hash string, query_hash string, rank int, chunk string")

    def value(fmt):
        return {r["query_hash"]: r["value"] for r in rag.format_passages(queries, found, fmt).collect()}

    assert value("text") == {"q": 'a\n----\nb "é"', "none": "(empty)"}
    assert value("json") == {"q": json.dumps(["a\n", 'b "é"'], indent=2, ensure_ascii=False), "none": "[]"}
    assert json.loads(value(None)["q"]) == ["a\n", 'b "é"'] and value(None)["none"] == "[]"
    with pytest.raises(ValueError):
        rag.format_passages(queries, found, "xml")


def test_index_skips_known_documents(spark, tmp_path):
    docs = spark.createDataFrame([("one two",), ("three",), ("one two",)], "t string")
    path = str(tmp_path / "index")
    first = rag.index_documents(docs, "t", path, 5, 0)
    assert first.count() == 3 and first.select("doc_hash").distinct().count() == 2
    index = spark.read.parquet(path)
    again = rag.index_documents(docs.union(spark.createDataFrame([("new",)], "t string")), "t", path, 5, 0, index=index)
    assert again.count() == 4
    other = rag.index_documents(docs, "t", path, 100, 0, index=spark.read.parquet(path))
    assert other.count() == 2  # other settings are another index


def test_query_cache(spark):
    def refuse_known(texts):
        assert "a" not in set(texts)
        return rag.hashed_words(texts)

    queries = spark.createDataFrame([("a",), ("b",), ("a",)], "q string")
    cache = rag.embed_queries(queries.filter("q = 'a'"), "q")
    got = rag.embed_queries(queries, "q", cache, refuse_known)
    assert got.select("query_hash").distinct().count() == 2 == got.count()


def test_passages_in_prompts(spark):
    docs = ["the cat sat on the mat. " * 3 + "dogs bark loudly at night", "rain falls in spring"]
    project = Project(
        spark, {"ask": "{{question}}: {{body(question)}}"},
        {"d": group_from_rows(spark, [{"body": d} for d in docs]),
         "q": group_from_rows(spark, [{"question": "dogs bark"}, {"question": "rain"}])},
        rag={"body": {"chunk_size": 30, "chunk_overlap": 0, "return_format": "text", "model_name": "m"}})
    rows = expand(project, functions=rag.passage_functions(dict(project.rag))).orderBy("combo_id").collect()
    assert len(rows) == 4
    assert rows[0]["prompt"].startswith("dogs bark: ") and "dogs bark" in rows[0]["prompt"].split(": ")[1].split("----")[0]
    assert rows[3]["prompt"] == "rain: rain falls in spring"


def test_index_and_queries_are_embedded_once(spark, tmp_path, rows):
    log = tmp_path / "embedded"

    def counted(texts):
        with open(log, "a") as f:
            f.writelines(t.replace("\n", " ") + "\n" for t in texts)
        return rag.hashed_words(texts)

    def grid(docs, questions, size=20):
        project = Project(spark, {"p": "{{doc(q)}}|{{q}}"}, {
            "d": group_from_rows(spark, [{"doc": d} for d in docs]), "q": group_from_rows(spark, [{"q": q} for q in questions])})
        functions = {"doc": rag.PassageFunction("doc", size, 0, "text", fn=counted, index=str(tmp_path / "index"))}
        return rows(expand(project, functions=functions).select("prompt"))

    def embedded():
        lines = log.read_text().splitlines() if log.exists() else []
        log.write_text("")
        return sorted(lines)

    docs = ["red fox jumps over it", "blue sea and the sky"]
    first = grid(docs, ["fox", "sea"])
    assert embedded() == sorted(["red fox jumps over", "it", "blue sea and the sky", "fox", "sea"])
    assert grid(docs, ["fox", "sea"]) == first and embedded() == []
    more = grid([*docs, "a new one"], ["fox", "new"])
    assert embedded() == ["a new one", "new"] and len(more) == 6
    assert [p for p in more if p[0].endswith("|fox")][:2] and set(first) & set(more)
    # other settings are another index
    grid(docs, ["fox"], size=10)
    assert "fox" not in embedded()


def test_chunks_that_two_writers_added_count_once(spark, tmp_path, rows):
    docs = ["red fox jumps over it all day long", "blue sea and the sky"]
    project = Project(spark, {"p": "{{doc(q)}}|{{q}}"}, {
        "d": group_from_rows(spark, [{"doc": d} for d in docs]), "q": group_from_rows(spark, [{"q": q} for q in ("fox", "sea")])})
    functions = {"doc": rag.PassageFunction("doc", 10, 0, "text", k=2, index=str(tmp_path / "index"))}
    first = rows(expand(project, functions=functions).select("prompt"))
    written = spark.read.parquet(str(tmp_path / "index/chunks"))
    written.write.parquet(str(tmp_path / "copy"))
    spark.read.parquet(str(tmp_path / "copy")).write.mode("append").parquet(str(tmp_path / "index/chunks"))
    assert rows(expand(project, functions=functions).select("prompt")) == first


def test_passages_read_the_texts_of_calls_once(spark, tmp_path):
    """The plan of a grid with passages reads the group for the grid itself; calls come from a table of keys."""
    spark.createDataFrame([(i, f"text {i}") for i in range(20)], "_ord bigint, doc string").write.parquet(str(tmp_path / "docs"))
    project = Project(spark, {"p": "{{doc(q)}}"}, {
        "d": spark.read.parquet(str(tmp_path / "docs")), "q": group_from_rows(spark, [{"q": "text"}])})
    grid = expand(project, functions={"doc": rag.PassageFunction("doc", index=str(tmp_path / "index"))}).select("prompt")
    assert len(re.findall(r"Relation \[_ord#\d+L,doc#\d+\]", grid._jdf.queryExecution().optimizedPlan().toString())) == 1
