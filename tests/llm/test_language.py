import random
import zlib

import numpy as np
import pytest
from edges import documents

from promptframe.llm.language import MAX_LANGUAGES, Network, Settings, held_out, identify, keep_known, learn, padded

SMALL = Settings(per_language=60, windows=2, window=48, epochs=4, batch=32)


def invented(spark, n=240):
    rng = random.Random(5)
    parts = {"en": ["the", "and", "ing", "tion", "er"], "de": ["sch", "ung", "ein", "keit", "ö"],
             "es": ["ción", "mente", "ado", "ñ", "ue"]}
    rows = []
    for k in range(n):
        lang = rng.choice(list(parts))
        text = " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(5, 40)))
        rows.append((k, text, lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark):
    docs = invented(spark)
    got = identify(docs, learn(docs, settings=SMALL)).join(docs, "doc_id").filter("held_out").collect()
    assert len(got) > 30
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_held_out_labels_are_not_read(spark):
    docs = invented(spark, 120)
    from pyspark.sql import functions as F
    hidden = docs.withColumn("lang", F.when(held_out(), "zz").otherwise(F.col("lang")))
    assert "zz" not in learn(hidden, settings=SMALL).languages


def test_gradients_match_differences():
    net = Network(["a", "b", "c"], Settings(hidden=3))
    for part in (net.ahead.params, net.back.params, net.out):
        for k in part:
            part[k] = part[k].astype(np.float64)
    steps, here = padded([b"hello", b"ab", b"xyzzy w"], 7)
    label = np.array([0, 1, 2])
    _, grads = net.gradients(steps, here, label)
    for key, g in grads.items():
        p = net.parameter(key)
        for at in map(tuple, np.argwhere(np.abs(g) > 1e-4)[:4]):
            kept, values = p[at], []
            for move in (1e-4, -1e-4):
                p[at] = kept + move
                values.append(net.gradients(steps, here, label)[0])
            p[at] = kept
            assert abs((values[0] - values[1]) / 2e-4 - g[at]) < 1e-6


def test_fast_sums_equal_the_network():
    net = Network(["a", "b"], Settings())
    steps, here = padded([b"some text", b"x", b"a longer text of bytes"], 30)
    p, _ = net.positions(steps, here)
    assert np.allclose((p * here[:, :, None]).sum(0), net.window_sums(steps, here), atol=1e-4)


def test_edges(spark):
    docs = documents(spark)
    net = learn(invented(spark, 90), settings=SMALL)
    got = identify(docs, net).collect()
    assert len(got) == docs.count()
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {1, 2, 5, 7}
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    kept = keep_known(docs, net, min_score=0.0)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4
    nothing = learn(docs.limit(0), settings=SMALL)
    assert {r.lang_pred for r in identify(docs, nothing).collect()} == {"und"}
    assert identify(docs.limit(0), net).count() == 0


def test_every_labelled_language_is_learned(spark):
    # the last language is the least frequent; its letters are its own
    rows = [(100 * k + j, " ".join(3 * chr(0x4E00 + 40 * k + i) for i in range(j % 3, 12)), f"l{k:02}")
            for k in range(70) for j in range(12 if k < 69 else 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = learn(docs, settings=Settings(per_language=12, windows=2, window=48, epochs=1))
    assert net.languages == [f"l{k:02}" for k in range(70)]
    # groups of windows that are smaller for many languages change no result
    texts = [t.encode() for _, t, _ in rows[::9]]
    assert np.allclose(net.pooled(texts), net.pooled(texts, 3), atol=1e-5)


def test_labels_that_are_no_languages_are_an_error(spark):
    docs = spark.range(2 * MAX_LANGUAGES).selectExpr("id AS doc_id", "'a text' AS text", "string(id) AS lang")
    with pytest.raises(ValueError, match="no languages"):
        learn(docs, settings=SMALL)


def test_a_repeated_id_is_one_document_of_the_sample(spark, monkeypatch):
    docs = invented(spark, 120)
    rare = [(1000 + k, f"{k} äöü çñé", "zz") for k in range(8)]
    # the rows of one id count as one document, however many they are
    hot = spark.range(5000).selectExpr("cast(1003 AS long) AS doc_id", "'hot çñé äöü' AS text", "'zz' AS lang")
    every = docs.unionByName(spark.createDataFrame(rare, docs.schema)).unionByName(hot)
    seen = {}
    monkeypatch.setattr(Network, "train", lambda self, windows, labels, settings: seen.update(
        n=np.bincount(labels, minlength=len(self.languages)).tolist(), languages=self.languages))
    learn(every, settings=Settings(per_language=6, windows=1, window=48))
    assert seen["languages"] == ["de", "en", "es", "zz"]
    assert seen["n"] == [6, 6, 6, min(6, sum(1 for k, _, _ in rare if zlib.crc32(str(k).encode()) % 4 != 2))]
