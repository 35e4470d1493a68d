import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from promptframe.llm.packing import SumOfSquares
from promptframe.llm import tokens
from promptframe.llm.tokens import Names, TextEncoder, pretokens, vocabulary

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ALPHABET = "ab's re'll't've'd'm sS1² \t\n\r  　!#é中́ᵽ8\U0001d54f\U0001f600’lvdtm'"


def library():
    v = vocabulary(RANKS)
    ranks = {bytes(v.token_bytes[s:s + n]): k
             for k, (s, n) in enumerate(zip(v.token_start.tolist(), v.token_length.tolist(), strict=True))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def split(texts):
    joined, begin, end, _, before = pretokens(texts, Names())
    words = [joined[s:e] for s, e in zip(begin, end, strict=True)]
    return [words[before[k]:before[k + 1]] for k in range(len(texts))]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from(ALPHABET), max_size=25), max_size=6))
def test_pretokens_are_the_matches_of_the_pattern(texts):
    assert split(texts) == [regex.findall(public_tokenizers.PATTERN, t) for t in texts]


def test_pretokens_of_every_code_point():
    rng = random.Random(1)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rng.shuffle(points)
    texts = ["".join(chr(c) + rng.choice(["", " ", "a", "'s", "\n", "1", "  "]) for c in points[k:k + 997])
             for k in range(0, len(points), 997)]
    assert split(texts) == [regex.findall(public_tokenizers.PATTERN, t) for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json"])
def test_ids_are_those_of_the_library(name):
    rng = random.Random(2)
    words = ["Don't", "hello", " world", "\n\n", "  ", "café", "\U0001f600", "1234", "!!", "ß" * 9, "<|endoftext|>"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(300)] + ["", "x" * 5000]
    encoder = TextEncoder(public_tokenizers.path(name))
    encoder.KEEP = 5
    want = library()
    got = list(encoder.encode(texts))
    assert [g.tolist() for g in got] == [want.encode_ordinary(t) for t in texts]
    assert [vocabulary(RANKS).decode(g) for g in got] == [t.encode() for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120), st.integers(1, 20))
def test_windows_are_whole_and_one_at_most_is_padded_when_closed(lengths, max_open):
    packer = SumOfSquares(64, 7, max_open)
    done = []
    for k, n in enumerate(lengths):
        done += packer.place((k, 0, np.arange(n)))
        assert sum(packer.count) == packer.n_open <= max_open
    closed = list(packer.close())
    assert sum(w.fill < 64 for w in closed) <= 1
    seen = {}
    for w in done + closed:
        assert w.fill == sum(len(p[2]) for p in w.pieces) <= 64
        for doc, start, ids in w.pieces:
            assert ids[0] == start
            seen.setdefault(doc, []).extend(ids.tolist())
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(n)) for k, n in enumerate(lengths)}
    assert len({w.number for w in done + closed}) == len(done + closed)


def test_the_level_minimises_the_sum_of_squares():
    rng = random.Random(3)
    packer = SumOfSquares(32)
    for k in range(400):
        n = rng.randrange(1, 32)
        options = {}
        for level in [0, *[h for h in range(1, 33 - n) if packer.count[h]]]:
            after = packer.count.copy()
            if level:
                after[level] -= 1
            if level + n < 32:
                after[level + n] += 1
            options[level] = int((after[:32] ** 2).sum())
        assert options[packer.level_for(n)] == min(options.values())
        list(packer.place((k, 0, np.arange(n))))


def test_words_whose_digests_meet_keep_their_own_ids(monkeypatch):
    monkeypatch.setattr(tokens, "span_digests", lambda p, b, e: (e - b).astype(np.uint64) % np.uint64(3) | tokens._HIGH)
    texts = ["the cat sat on the mat and the dog ran to the cat", "", "a b c aa bb cc aaa the dog", " x", "1 22 é中"] * 2
    encoder, want = TextEncoder(RANKS), library()
    assert [ids.tolist() for ids in encoder.encode(texts)] == [want.encode_ordinary(t) for t in texts]


def test_digests_of_short_words_are_the_words():
    texts = ["", "a", "\0", "\0\0", "abcdefgh", "abcdefg", "bcdefgh", "é", "ab é", "abcdefghi"]
    spans = [(0, len(t)) for t in texts]
    found = []
    for t, (b, e) in zip(texts, spans, strict=True):
        points = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        found.append(int(tokens.span_digests(points, np.array([b]), np.array([e]))[0]))
    assert len(set(found)) == len(texts)
    assert [d < 1 << 57 for d in found] == [True] * 7 + [False] * 3
