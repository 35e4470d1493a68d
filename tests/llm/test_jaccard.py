import random
import re
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pytest
from edges import bit_texts, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from promptframe.llm import jaccard
from promptframe.llm.jaccard import SETTINGS, components_of, connected, drop_near_duplicates, join_region
from promptframe.llm.words import shingle_sets


def shingles(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[k:k + 5]) for k in range(len(words) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    inverted, parent = defaultdict(list), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in enumerate(sets):
        for x in s:
            inverted[x].append(k)
    for k, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in inverted[x] if j < k).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[find(k)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = min(least.get(r, i), i, key=lambda x: (x is None, x or 0))
    return [(i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows)]


def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(400)]
    line = " ".join(rng.choices(vocabulary, k=30))
    hot = rng.choices(vocabulary, k=120)
    rows = []
    for k in range(260):
        words = list(hot) if k % 3 == 0 else rng.choices(vocabulary, k=rng.randint(1, 150))
        for _ in range(rng.randint(0, 9) if k % 3 == 0 else 0):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((k, " ".join(words) + (f" {line}" if k % 4 == 0 else "")))
    for k in range(260, 320):  # chains of ever more edits
        words = rows[rng.randrange(k)][1].split()
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((k, " ".join(words).upper() if k % 5 == 0 else " ".join(words)))
    return rows + [(320, ""), (321, None), (322, "A b"), (323, "a B"), (324, "a")]


def key(r):
    return tuple((x is None, x or 0) for x in r)


@pytest.mark.parametrize("change", [{}, {"region_shingles": 400, "sample": 2}, {"longer": 0.0, "region_shingles": 2500},
                                    {"frequent": 0, "salts": 1},
                                    {"region_shingles": 150, "pivots": 3, "leaf": 2},
                                    {"region_shingles": 300, "pivots": 2, "leaf": 2, "shrink": 0.95}])
def test_components_match_brute_force(spark, change):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in components_of(df, settings=replace(SETTINGS, **change)).collect()), key=key)
    assert got == sorted(brute(rows), key=key)


def test_edges_and_the_one_that_stays(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in components_of(docs).collect()), key=key)
    assert got == sorted(brute(rows), key=key)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5, 7, 8, 9]
    assert components_of(docs.limit(0)).count() == 0 and drop_near_duplicates(docs.limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), min_size=1, max_size=12), min_size=1, max_size=25),
       st.sampled_from([SETTINGS, replace(SETTINGS, pivots=2, leaf=2, shrink=0.99), replace(SETTINGS, pivots=4, leaf=3)]))
def test_a_region_joins_exactly(sets, how):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    part = join_region(arrays, 75, settings=how).tolist()
    reach = list(range(len(sets)))
    for _ in sets:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if 100 * len(x & y) >= 75 * len(x | y):
                    reach[a] = reach[b] = min(reach[a], reach[b])
    assert [part.index(p) for p in part] == [reach.index(r) for r in reach]


def test_shingles_of_joined_texts():
    texts = ["a b c d e f", "", "A B", "f\x0bg", "a b c d e f", "x " * 50]
    sets, names = shingle_sets(texts)
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert names[0] == names[4] and len(set(names.tolist())) == 5


def test_connected(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(25)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}
    for _ in parent:
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in parent.items() if k not in alone}


def test_texts_of_equal_polynomial_sums_stay_apart(spark):
    docs = spark.createDataFrame(list(enumerate(bit_texts())), "doc_id long, text string")
    assert sorted(map(tuple, components_of(docs).collect())) == [(0, 1, 0), (1, 1, 1)]
    assert drop_near_duplicates(docs).count() == 2


def test_of_repeated_rows_the_same_one_stays(spark):
    rows = [(1, "a b c d e f", k) for k in range(40)]
    kept = {drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, x int").repartition(n)).first().x
            for n in (1, 3, 7)}
    assert len(kept) == 1


def cluster(n, size, seed):
    """Sets around a common one, with ever more members of their own, some of which a few others have."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        own = int(size * 0.6 * k / n)
        few, alone = rng.integers(1000, 1000 + 4 * n, own // 2), 10**6 + k * size + np.arange(own - own // 2)
        out.append(np.unique(np.concatenate([rng.permutation(size)[own:], few, alone])).astype(np.uint64))
    return [out[k] for k in rng.permutation(n)]


@pytest.mark.parametrize("how", [SETTINGS, replace(SETTINGS, pivots=3, leaf=4), replace(SETTINGS, pivots=2, leaf=2, shrink=0.99)])
def test_regions_of_many_sets_join_exactly(how):
    rng = np.random.default_rng(5)
    sets = cluster(220, 40, 1) + [s + np.uint64(10**9) for s in cluster(60, 12, 2)]
    sets += [np.unique(rng.integers(0, 60, rng.integers(1, 30))).astype(np.uint64) for _ in range(120)]
    links = [(a, b) for a, x in enumerate(sets) for b, y in enumerate(sets[:a])
             if 100 * (n := len(np.intersect1d(x, y, True))) >= 75 * (len(x) + len(y) - n)]
    asked = np.flatnonzero(rng.random(len(sets)) < 0.4)
    for first in (None, asked):
        part = join_region(sets, 75, first, how)
        reach = np.arange(len(sets))
        for a, b in links:
            if first is None or a in first or b in first:
                reach[reach == reach[a]] = reach[b]
        if first is None:
            assert len(set(zip(part.tolist(), reach.tolist(), strict=True))) == len(set(part.tolist())) == len(set(reach.tolist()))
        else:
            # the links asked for are found, and nothing but links
            assert all(part[a] == part[b] for a, b in links if a in first or b in first)
            whole = join_region(sets, 75, None, how)
            assert all(whole[k] == whole[p] for k, p in enumerate(part.tolist()))


def test_a_set_is_not_gathered_against_all_of_its_cluster(monkeypatch):
    """Members of many sets are bits, sets that share too little with all others leave first."""
    sets, gathered, before = cluster(600, 100, 3), [], jaccard.ragged
    monkeypatch.setattr(jaccard, "ragged", lambda *a: gathered.append(len(x := before(*a))) or x)
    join_region(sets, 75)
    assert sum(gathered) < 600 * 600 * 100 // 20


def test_windows_move_as_packed_pairs(spark, monkeypatch):
    """A row of a text and some rows for a bucket, not a row for each shingle of a window."""
    rows, counts, write = corpus(), {}, jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, purpose: counts.setdefault(purpose, write(df, purpose)))
    components_of(spark.createDataFrame(rows, "doc_id long, text string")).count()
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert counts["jaccard-windows"].count() <= len(rows) + 3 * buckets
    assert counts["jaccard-shared"].count() <= 3 * buckets


def test_pairs_are_dealt_bit_by_bit(spark, monkeypatch):
    """What a task holds before it deals changes nothing, whatever the number of buckets."""
    monkeypatch.setattr(jaccard, "_HELD", 50)
    monkeypatch.setattr(jaccard, "_BUCKETS", 1)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((tuple(r) for r in components_of(df, settings=replace(SETTINGS, sample=2, salts=3)).collect()), key=key)
    assert got == sorted(brute(rows), key=key)
