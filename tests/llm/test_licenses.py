import random

from edges import documents

from promptframe.llm.licenses import TEMPLATES, Index, Settings, align, matches, scan, word_spans


def longest(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(best[j + 1], row[j], best[j] + (x == y)))
        best = row
    return best[-1]


def test_a_wide_band_finds_the_longest_common_words():
    rng = random.Random(8)
    for _ in range(60):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randint(1, 14))] for _ in range(2))
        x, y = word_spans([" ".join(a)])[2], word_spans([" ".join(b)])[2]
        n, first, last = align(x, y, 0, 30)
        assert n == longest(a, b)
        assert n == 0 or longest(a, b[first:last + 1]) == n


def test_words_of_many_texts():
    texts = ["A b", "", "c-D é9", "end"]
    begin, end, _, before, bounds = word_spans(texts)
    joined = "".join(texts)
    words = [joined[s:e] for s, e in zip(begin, end, strict=True)]
    assert [words[before[k]:before[k + 1]] for k in range(4)] == [["A", "b"], [], ["c", "D", "é9"], ["end"]]


def test_notices_whole_edited_and_twice(spark):
    words = " ".join(TEMPLATES["MIT-terms"].split())
    edited = words.replace("free of charge", "gratis").replace("publish, ", "")
    rows = [(1, f"x {TEMPLATES['MIT']} y\n{TEMPLATES['MIT']}"), (2, edited), (3, "the License under MIT"), (4, words[:200])]
    got = scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text = dict(rows)
    assert sorted((r.doc_id, r.license) for r in got) == [(1, "MIT"), (1, "MIT"), (2, "MIT-terms")]
    for r in got:
        part = text[r.doc_id][r.start:r.end]
        assert part == TEMPLATES["MIT"][:-1] if r.doc_id == 1 else part.startswith("Permission") and r.coverage > 0.9


def test_every_template_finds_itself():
    index = Index(TEMPLATES, Settings())
    assert all(len(w) >= 5 for w in index.words) and set(index.template.tolist()) == set(range(len(index.names)))


def test_edges(spark):
    docs = documents(spark)
    assert scan(docs).count() == 0 and scan(docs.limit(0)).count() == 0
    assert scan(docs, {"fox": "the quick brown fox"}).count() == 6000


def test_edits_of_every_template_are_found_as_by_alignment_without_the_index():
    index, around = Index(TEMPLATES, Settings()), [f"w{k}" for k in range(20)]
    expected = 0
    for t, name in enumerate(index.names):
        begin, end, digest = word_spans([TEMPLATES[name]])[:3]
        own = [TEMPLATES[name][b:e] for b, e in zip(begin, end, strict=True)]
        for k in range(len(own)):
            for edited in (own[:k] + ["zzz"] + own[k + 1:], own[:k] + own[k + 1:], own[:k] + ["zzz"] + own[k:]):
                words = word_spans([" ".join(around + edited + around)])[2]
                band = min(index.settings.band, len(own) // 2)
                whole = align(digest, words, len(around), band)[0]
                if whole / len(own) >= index.settings.coverage:
                    expected += 1
                    assert [(m[0], m[1]) for m in matches(index, words)] == [(t, whole)], (name, edited)
    assert expected > 3 * len(index.names)


def test_templates_of_fewer_words_than_a_fingerprint():
    for template in ("public", "public domain", "the public domain"):
        index = Index({"short": template}, Settings())
        assert [m[:2] for m in matches(index, word_spans([f"it is {template} now"])[2])] == [(0, len(template.split()))]
