import re
from collections import Counter

import pytest
from edges import CLASHES, PROSE, documents

from promptframe.llm.quality import BASE, RULES, Rule, judge, keep_good

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))


TEXTS = ["", "a b c a b c", "a b a b a b", "x\nx\n\ny\nx", "# $ a|b <c>", "a b c d e a b c", "one two", "é ü é ü é ü é",
         "A B C\x0bA B C\x0cd", "w " * 300, " ".join(str(i % 7) for i in range(90))]


def test_measures_match_brute_force(spark):
    df = spark.createDataFrame(list(enumerate([None, *TEXTS])), "doc_id long, text string")
    got = {r[0]: tuple(r)[1:6] for r in judge(df).collect()}
    assert got == {k: brute(t) for k, t in enumerate([None, *TEXTS])}


def test_edges_and_clashing_names(spark):
    docs = documents(spark)
    judged = judge(docs).collect()
    assert len(judged) == docs.count()
    assert {r.doc_id for r in judged if r.kept} == {3, 6, None}
    assert {r.doc_id for r in judged if "n_words" in r.failed} == {1, 2, 5, 7, 8, 9}
    kept = keep_good(docs)
    assert kept.columns == docs.columns and sorted(kept.columns)[-1] == "window"
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 3), (False, 3), (False, 6), (True, None)]
    assert kept.first()[CLASHES[0]] == 0
    assert keep_good(docs.limit(0)).count() == 0


@pytest.mark.parametrize("rules, kept", [((), {1, 2}), ((Rule("n_symbols", high=0),), {1}), ((Rule("n_symbols", low=1),), {2})])
def test_rules_are_a_parameter(spark, rules, kept):
    df = spark.createDataFrame([(1, "a b"), (2, "a | b")], "doc_id long, text string")
    assert {r.doc_id for r in keep_good(df, base=(), rules=rules).collect()} == kept


def test_default_table():
    assert [r.measure for r in (*BASE, *RULES)][:2] == ["n_words", "repeat_word_ratio"]


def test_stop_words_count_only_in_languages_with_a_list(spark):
    import corpus_pipeline

    clean = " ".join(f"slovo{chr(97 + i // 10)}{chr(97 + i % 10)}" for i in range(60))
    rows = [(1, clean, "cs"), (2, clean, "en"), (3, clean, "en-GB"), (4, clean, None), (5, "# " * 60 + clean, "cs"),
            (6, clean[:90], "cs"), (7, None, "cs"), (8, PROSE, "en"), (9, clean, "Es_mx"), (1, clean, "cs")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.quality_stage(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 1, 8]
    assert {r.doc_id for r in keep_good(docs).collect()} == {8}
