"""Vectors of pre-tokens: where they start in many texts at once, their digests, their ids.

A byte-level BPE vocabulary first splits a text by a pattern (contractions, runs of letters, of
numbers, of other signs, each with one leading space, and white space). The split depends only on
the class of neighbouring characters, so it is computed for a whole chunk of texts with array
operations. A pre-token is named by a 64-bit digest of its characters, and by another where two
different ones would meet.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np

LETTER, NUMBER, OTHER, SPACE = range(4)
#: Characters handled at once; one longer text is a chunk of its own.
CHUNK_CHARS = 1 << 18
#: Spans of more characters have a cryptographic digest.
LONG_SPAN = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)
_HIGH = np.uint64(1 << 63)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


@cache
def char_classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every = "".join(map(chr, points))
    classes = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            classes[points[m.start()]:points[m.end() - 1] + 1] = kind
    classes[0xD800:0xE000] = OTHER
    return classes


def token_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A mask of the characters that begin a pre-token.

    ``points`` holds the code points of many texts one after the other; ``first`` marks the first
    character of each text.
    """
    kind = char_classes()[points]
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    starts = run.copy()
    # the last white space before a run is split off; a plain space then joins the run
    after = np.flatnonzero(run[1:] & ~first[1:] & (kind[:-1] == SPACE)) + 1
    starts[after - 1] = True
    starts[after[points[after - 1] == 32]] = False
    quotes = np.flatnonzero((points == 39) & starts)
    if len(quotes):
        def ahead(k: int) -> np.ndarray:
            at = np.minimum(quotes + k, len(points) - 1)
            inside = quotes + k < len(points)
            for j in range(1, k + 1):
                inside &= ~first[np.minimum(quotes + j, len(points) - 1)]
            return np.where(inside, points[at], 0)

        one, two, three = ahead(1), ahead(2), ahead(3)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        starts[quotes[short | long] + 1] = False
        for hit, size, follow in ((short, 2, two), (long, 3, three)):
            more = hit & (follow > 0) & (char_classes()[follow] == LETTER)
            starts[quotes[more] + size] = True
    return starts


def chunks(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters."""
    begin = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield begin, k
            begin, size = k, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def span_digests(points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit digests of the spans ``points[begin:end]``, equal wherever the spans lie.

    Up to eight ASCII characters are their own digest, below 2**57. Others have the highest bit; their
    characters are mixed in one after the other, which leaves no pattern by which spans of one length
    meet, and long spans have a cryptographic digest.
    """
    size = end - begin
    beyond = np.zeros(len(points) + 1, np.int64)
    np.cumsum(points > 127, out=beyond[1:])
    short = (size <= 8) & (beyond[end] == beyond[begin])
    out = np.empty(len(size), np.uint64)
    for own in (np.flatnonzero(short), np.flatnonzero(~short)):
        order = own[np.argsort(-size[own], kind="stable")]
        start, fall = begin[order], -size[order]
        packs = len(own) > 0 and short[own[0]]
        x = np.ones(len(order), np.uint64) if packs else -fall.astype(np.uint64) * _STEP
        for k in range(min(int(-fall.min(initial=0)), LONG_SPAN)):
            # spans that have a k-th character, which are the first ones
            n = int(np.searchsorted(fall, -k))
            character = points[start[:n] + k]
            if packs:
                x[:n] = (x[:n] << np.uint64(7)) | character
            else:
                part = (x[:n] ^ character) * _MIX
                x[:n] = part ^ (part >> np.uint64(32))
        out[order] = x if packs else mixed(x) | _HIGH
    for k in np.flatnonzero(size > LONG_SPAN).tolist():
        out[k] = strong_digest(points[begin[k]:end[k]].tobytes()) | _HIGH
    return out


def strong_digest(data: bytes, salt: int = 0) -> np.uint64:
    """A cryptographic digest of 64 bits."""
    found = hashlib.blake2b(data, digest_size=8, salt=salt.to_bytes(8, "little")).digest()
    return np.frombuffer(found, np.uint64)[0]


class Names:
    """Digests as names of words, with the words themselves, so that no two share a name.

    Names are given in the order in which words come: of two words of equal digest the later one gets
    another, and the same words in the same order have the same names.
    """

    def __init__(self):
        self.words: dict[int, str] = {}

    def exact(self, joined: str, points: np.ndarray, begin: np.ndarray, end: np.ndarray,
              digest: np.ndarray) -> np.ndarray:
        """The names of spans; most often their digests."""
        open_spans = np.flatnonzero(digest >= _HIGH)
        digest_of, begin, end = digest[open_spans], begin[open_spans], end[open_spans]
        unique, where, which = np.unique(digest_of, return_index=True, return_inverse=True)
        words, doubt = self.words, []
        for k, (d, s, e) in enumerate(zip(unique.tolist(), begin[where].tolist(), end[where].tolist(), strict=True)):
            word = joined[s:e]
            if words.setdefault(d, word) != word:
                doubt.append(k)
        # every span against the first one of its digest
        size, first = end - begin, where[which]
        odd = size != size[first]
        same = np.flatnonzero(~odd)
        ends = np.cumsum(size[same])
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size[same], size[same])
        unlike = points[np.repeat(begin[same], size[same]) + at] != points[np.repeat(begin[first[same]], size[same]) + at]
        odd[same[np.unique(np.searchsorted(ends, np.flatnonzero(unlike), side="right"))]] = True
        if not doubt and not odd.any():
            return digest
        out = digest.copy()
        for k in np.flatnonzero(odd | np.isin(which, doubt)).tolist():
            word, name, salt = joined[begin[k]:end[k]], int(digest_of[k]), 0
            while words.setdefault(name, word) != word:
                salt += 1
                name = int(strong_digest(word.encode("utf-8", "surrogatepass"), salt) | _HIGH)
            out[open_spans[k]] = name
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * _MIX
    return x ^ (x >> np.uint64(29))


def code_points(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts joined, their code points, and the place where each text begins (and the end)."""
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return joined, points, bounds


def pretokens(texts: list[str], names: Names) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Joined texts; begin, end and name of every pre-token; pre-tokens before each text."""
    joined, points, bounds = code_points(texts)
    first = np.zeros(len(points), bool)
    first[bounds[:-1][np.diff(bounds) > 0]] = True
    begin = np.flatnonzero(token_starts(points, first)) if len(points) else np.zeros(0, np.int64)
    end = np.append(begin[1:], len(points)) if len(begin) else begin
    digest = names.exact(joined, points, begin, end, span_digests(points, begin, end))
    return joined, begin, end, digest, np.searchsorted(begin, bounds)


def ragged(flat: np.ndarray, start: np.ndarray, length: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """The slices ``flat[start:start + length]`` of the picked entries, one after the other."""
    n = length[pick]
    ends = np.cumsum(n)
    shift = np.repeat(start[pick] - (ends - n), n)
    return flat[shift + np.arange(len(shift))]


class Vocabulary:
    """Token ranks of a byte-level BPE vocabulary file: rank lines, or the JSON form."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            data = f.read()
        self.added: dict[str, int] = {}
        if path.endswith(".json"):
            # the JSON form writes bytes as printable characters
            plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
            shown = {chr(b): b for b in plain}
            shown |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
            form = json.loads(data)
            ranks = {bytes(shown[c] for c in token): rank for token, rank in form["model"]["vocab"].items()}
            for token in form.get("added_tokens", ()):
                flags = [k for k in ("single_word", "lstrip", "rstrip", "normalized") if token.get(k)]
                if flags:
                    raise ValueError(f"added token {token['content']!r}: {', '.join(flags)} not supported")
                self.added[token["content"]] = token["id"]
        else:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        # merges the bytes of one pre-token by the ranks; the pattern is unused
        self.piece = tiktoken.Encoding("ranks", pat_str=r"\S+", mergeable_ranks=ranks,
                                       special_tokens={})._core_bpe.encode_single_piece
        self.size = max(ranks.values()) + 1
        by_rank = [b""] * self.size
        for token, rank in ranks.items():
            by_rank[rank] = token
        self.token_length = np.array([len(t) for t in by_rank], np.int64)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.token_bytes = np.frombuffer(b"".join(by_rank), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of ids."""
        return ragged(self.token_bytes, self.token_start, self.token_length, ids).tobytes()


@cache
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary at ``path``, read once per worker."""
    return Vocabulary(path)


class TextEncoder:
    """Ids of whole texts, with the pre-tokens met so far kept by name.

    With ``added``, the added tokens of the vocabulary's file cut a text before it is split, and each
    gives its own id, as the tokenizers library does; without, they are ordinary text.
    """

    #: Pre-tokens kept; beyond it the memory starts anew, which changes no result.
    KEEP = 400_000

    def __init__(self, path: str, added: bool = False):
        self.piece = vocabulary(path).piece
        self.added = {t: np.array([k], np.uint32) for t, k in vocabulary(path).added.items()} if added else {}
        # of tokens that begin at one place the longest is taken
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(map(re.escape, longest_first))})").split if self.added else lambda t: [t]
        self.clear()

    def clear(self) -> None:
        self.words = Names()
        self.names = np.zeros(0, np.uint64)
        self.start = self.length = np.zeros(0, np.int64)
        self.flat = array("I")

    def learn(self, joined: str, names: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The places of pre-tokens (sorted by name) in memory, after those not met yet are encoded."""
        if len(self.names):
            at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
            new = np.flatnonzero(self.names[at] != names)
        else:
            new = np.arange(len(names))
        if len(new):
            first, length = len(self.flat), []
            for s, e in zip(begin[new].tolist(), end[new].tolist(), strict=True):
                ids = self.piece(joined[s:e].encode("utf-8", "replace"))
                self.flat.extend(ids)
                length.append(len(ids))
            length = np.array(length, np.int64)
            every = np.concatenate([self.names, names[new]])
            order = np.argsort(every, kind="stable")
            self.names = every[order]
            self.start = np.concatenate([self.start, first + np.cumsum(length) - length])[order]
            self.length = np.concatenate([self.length, length])[order]
        return np.searchsorted(self.names, names)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text in order."""
        # ordinary parts at even places, added tokens between them
        parts = [self.cut(t) for t in texts]
        ordinary = self.ordinary([p for ps in parts for p in ps[::2]])
        for ps in parts:
            ids = next(ordinary)
            if len(ps) > 1:
                ids = np.concatenate([ids, *(x for t in ps[1::2] for x in (self.added[t], next(ordinary)))])
            yield ids

    def ordinary(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text in order, added tokens taken as ordinary text."""
        for a, b in chunks(texts):
            if len(self.names) > self.KEEP:
                self.clear()
            joined, begin, end, digest, before = pretokens(texts[a:b], self.words)
            names, where, which = np.unique(digest, return_index=True, return_inverse=True)
            at = self.learn(joined, names, begin[where], end[where])[which]
            ids = ragged(np.array(self.flat, np.uint32), self.start, self.length, at)
            ends = np.zeros(len(at) + 1, np.int64)
            np.cumsum(self.length[at], out=ends[1:])
            cuts = ends[before]
            for k in range(b - a):
                yield ids[cuts[k]:cuts[k + 1]]
