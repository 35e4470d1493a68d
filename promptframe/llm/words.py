"""Word vectors of many texts at once: words by ASCII white space, and digests of their shingles."""

from __future__ import annotations

import numpy as np

from promptframe.llm.tokens import code_points, mixed, span_digests, strong_digest

_STEP = np.uint64(0xD6E8FEB86659FD93)
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def word_digests(texts: list[str], fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all words (A-Z lowered if ``fold``), and the number of words before each text."""
    _, points, bounds = code_points(texts)
    if fold:
        points = np.where((points >= 65) & (points <= 90), points + np.uint32(32), points)
    inside = ~_BLANK[np.minimum(points, 255)]
    begin, end = inside.copy(), inside.copy()
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(points))]
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    begin[cuts] = inside[cuts]
    end[cuts - 1] = inside[cuts - 1]
    begin = np.flatnonzero(begin)
    return mixed(span_digests(points, begin, np.flatnonzero(end) + 1)), np.searchsorted(begin, bounds)


def shingle_sets(texts: list[str], k: int = 5) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted digests of each text's distinct ``k``-word shingles, and a digest of its words.

    With fewer words the whole sequence is one shingle; without words there is none.
    """
    words, before = word_digests(texts)
    sequence = np.array([strong_digest(words[s:e].tobytes()) for s, e in zip(before[:-1], before[1:], strict=True)], np.uint64)
    digest = np.full(max(0, len(words) - k + 1), k, np.uint64)
    for j in range(k):
        digest = mixed(digest * _STEP + words[j:len(digest) + j])
    out = []
    for s, e in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if e - s >= k:
            found = np.sort(digest[s:e - k + 1])
            out.append(found[np.flatnonzero(np.r_[True, found[1:] != found[:-1]])])
        elif e > s:
            whole = np.full(1, e - s, np.uint64)
            for w in words[s:e]:
                whole = mixed(whole * _STEP + w)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out, sequence
