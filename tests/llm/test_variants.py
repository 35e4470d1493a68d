import random
import re
import zlib
from collections import Counter

import pytest
from edges import LONG, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from promptframe.llm.variants import FIRST, LAST, Grams, Settings, corpus_words, group_variants, near_pairs
from promptframe.llm.variants import op13_spelling_variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def words_of(rows):
    """Words by their definition, in plain Python."""
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 2}


def brute(count):
    out, form = {}, {}
    for w, n in count.items():
        others = [x for x in count if near(w, x)]
        best = min(((-count[x], x) for x in others), default=None)
        if best and -best[0] >= 10 * n:
            form[w] = best[1]
        out[w] = (n, len(others))
    def root(w):
        return root(form[w]) if w in form else w
    return sorted((w, n, k, form.get(w), count.get(form.get(w)), root(w)) for w, (n, k) in out.items())


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


def vocabulary():
    rng = random.Random(5)
    parts = ["ing", "tion", "the", "an", "er", "ció", "é", "st", "ou", "x", "zz", "abab"]
    words = Counter()
    for _ in range(150):
        word = "".join(rng.choices(parts, k=rng.randint(3, 6)))
        words[word] += rng.choice([2, 30, 400, 5000])
        for _ in range(rng.randint(0, 5)):
            k = rng.randrange(len(word))
            words[rng.choice([word[:k] + word[k + 1:], word[:k] + "q" + word[k:], word[:k] + "\U0001f600" + word[k + 1:]])] += 3
    return {w: n for w, n in words.items() if len(w) >= 7}


@pytest.mark.parametrize("how", [Settings(), Settings(frequent=0.02), Settings(frequent=0.3), Settings(2, 3, 0.01),
                                 Settings(3, 4, 0.02), Settings(2, 2, 1)])
def test_groups_match_brute_force(spark, how):
    count = vocabulary()
    df = spark.createDataFrame(list(count.items()), "word string, n long")
    assert rows_of(group_variants(df, settings=how)) == brute(count)


def test_chains_end_at_their_root(spark):
    count = {"aaaaaaaa": 1, "aaaaaaab": 10, "aaaaaabb": 100, "aaaaabbb": 1000, "aaaabbbb": 10_000, "aaabbbbb": 100_000}
    df = spark.createDataFrame(list(count.items()), "word string, n long")
    got = rows_of(group_variants(df))
    assert got == brute(count) and {r[5] for r in got} == {"aaabbbbb"}


WORD = st.text(st.sampled_from("abcé"), min_size=6, max_size=12)


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text(st.sampled_from(FIRST + "abcé"), min_size=2, max_size=3)), WORD, st.integers(0, 40), st.sampled_from("abz"),
       st.sampled_from("dis"))
def test_bounds_hold_for_every_edit(frequent, word, at, letter, kind):
    frequent = frozenset(g for g in frequent if all(g[:k] in frequent for k in range(2, len(g))))
    grams = Grams(frequent)
    at %= len(word) + (kind == "i")
    other = word[:at] + (letter if kind != "d" else "") + word[at + (kind != "i"):]
    if len(other) < 6 or other == word:
        return
    (bound, keys, levels), (other_bound, other_keys, other_levels) = grams.keys(word), grams.keys(other)
    assert bound >= 1 and other_bound >= 1
    level = max(bound, other_bound)
    assert {k for k, n in zip(keys, levels) if n == level} & {k for k, n in zip(other_keys, other_levels) if n == level}
    marked = FIRST + word + LAST
    assert all(marked[a:b] for a, b in grams.split(marked))


def test_words_of_edges(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    more = [(k, "Straße GRÖSSER größer Zeitung×zeitung déjàvuxx " * 3 + LONG[:500]) for k in range(200)]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = {r.word: r.n for r in corpus_words(both).collect()}
    assert got == words_of(rows + more) and len(got) > 4
    assert group_variants(corpus_words(docs.limit(0))).count() == 0
    with pytest.raises(Exception, match="words need 6"):
        near_pairs(spark.createDataFrame([("abc", 2)], "word string, n long")).count()


def test_query_on_whole_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert rows_of(op13_spelling_variants(spark, "/root/testdata/sf0.001")) == brute(words_of(rows))
