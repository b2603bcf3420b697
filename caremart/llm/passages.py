"""Passages of texts and their feature vectors, for many texts at once in numpy.

A passage is ``WORDS`` consecutive words (runs without white space) of a text, the last one what
remains, with the white space behind them.  Its features are shares of character classes, hashed
word shapes, hashed words (case folded) and a few numbers on lengths and repetition.  All of it is
array work on code points; nothing is done word by word.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

WORDS = 48
RUN_CHARS = 400_000  # characters encoded at a time
SHAPES, HASHED = 128, 256
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPACE, NEWLINE, LOWER, UPPER, LETTER, DIGIT, OTHER, FIRST_SIGN = range(8)
CLASSES = FIRST_SIGN + len(SIGNS)
NUMBERS = 7
FEATURES = CLASSES + SHAPES + HASHED + NUMBERS

_TOP = 0xFFFF  # code points beyond share the last one's class
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _class(c: str) -> int:
    if c in SIGNS:
        return FIRST_SIGN + SIGNS.index(c)
    if c.isspace():
        return NEWLINE if c in "\n\r" else SPACE
    if c.isupper():
        return UPPER
    if c.islower():
        return LOWER
    return LETTER if c.isalpha() else DIGIT if c.isdigit() else OTHER


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: class, and a number for the lower-cased character; by place: a factor."""
    kinds = np.array([_class(chr(i)) for i in range(_TOP + 1)], np.int64)
    small = np.array([ord(x) if len(x := chr(i).lower()) == 1 else i for i in range(_TOP + 1)], np.uint64)
    places = np.cumprod(np.full(64, _MIX | np.uint64(1), np.uint64))
    return kinds, (small + np.uint64(1)) * _MIX, places


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (passages x ``FEATURES``), passages of each text, and where in its text each starts.

    A text without words has no passage here.
    """
    kinds, values, places = _tables()
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.minimum(points, _TOP)
    kind = kinds[points]
    length = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    text_start = np.cumsum(length) - length
    blank = kind <= NEWLINE
    first = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    if not len(first):
        return np.zeros((0, FEATURES), np.float32), np.zeros(len(texts), np.int64), np.zeros(0, np.int64)
    last = np.flatnonzero(~blank & np.r_[blank[1:], True])
    text_of = np.searchsorted(text_start, first, "right") - 1
    words = np.bincount(text_of, minlength=len(texts))
    nth = np.arange(len(first)) - (np.cumsum(words) - words)[text_of]
    opens = nth % WORDS == 0
    passage = np.cumsum(opens) - 1
    n = int(passage[-1]) + 1

    # characters: those before a text's first word belong to no passage
    word_of = np.repeat(np.arange(-1, len(first)), np.diff(np.r_[0, first, len(points)]))
    at = np.where((word_of >= 0) & (text_of[word_of] == np.repeat(np.arange(len(texts)), length)), passage[word_of], n)
    shares = np.bincount(at * CLASSES + kind, minlength=(n + 1) * CLASSES).reshape(-1, CLASSES)[:n].astype(np.float32)
    shares /= shares.sum(axis=1, keepdims=True)

    place = np.clip(np.arange(len(points)) - first[word_of], 0, len(places) - 1)
    factor = np.where(blank | (word_of < 0), np.uint64(0), places[place])
    word = np.add.reduceat(values[points] * factor, first)
    word ^= word >> np.uint64(31)
    word *= _MIX
    size = last - first + 1
    n_words = np.bincount(passage, minlength=n).astype(np.float32)

    def total(bins: np.ndarray, width: int, weights: np.ndarray | None = None) -> np.ndarray:
        sums = np.bincount(passage * width + bins, weights, minlength=n * width)
        return sums.reshape(n, width).astype(np.float32) / n_words[:, None]

    shape = ((kind[first] * CLASSES + kind[last]) * 16 + np.minimum(size, 15)) * 40503 % 65521 % SHAPES
    sign = np.where(word >> np.uint64(63), 1.0, -1.0)
    hashed = total((word >> np.uint64(40)).astype(np.int64) % HASHED, HASHED, sign)
    again = np.r_[False, (word[1:] == word[:-1]) & ~opens[1:]]
    known = np.sort((passage.astype(np.uint64) << np.uint64(38)) | (word >> np.uint64(26)))
    fresh = known[np.r_[True, known[1:] != known[:-1]]] >> np.uint64(38)
    zero = np.zeros(len(first), np.int64)
    mean = total(zero, 1, size.astype(float))[:, 0]
    ends = np.isin(kind[last], [FIRST_SIGN + SIGNS.index(c) for c in ".!?"])
    numbers = np.stack([
        n_words / WORDS, np.minimum(mean, 50) / 10,
        np.sqrt(np.maximum(total(zero, 1, np.minimum(size, 1000).astype(float) ** 2)[:, 0] - np.minimum(mean, 1000) ** 2, 0)) / 10,
        np.bincount(fresh.astype(np.int64), minlength=n) / n_words, total(zero, 1, again.astype(float))[:, 0],
        total(zero, 1, ends.astype(float))[:, 0], total(zero, 1, (kind[first] == UPPER).astype(float))[:, 0]], axis=1)
    features = np.concatenate([shares, total(shape, SHAPES), hashed, numbers.astype(np.float32)], axis=1)
    return features, -(-words // WORDS), first[opens] - text_start[text_of[opens]]


def pieces(text: str, limit: int = RUN_CHARS):
    """Features of a text's passages, a piece of about ``limit`` characters at a time.

    A piece ends where one of its passages ends, so the passages are those of the whole text.
    """
    start, size = 0, limit
    while start < len(text):
        piece = text[start:start + size]
        features, _, at = encode([piece])
        if start + size >= len(text):
            if len(features):
                yield features
            return
        if len(at) > 1:  # the last passage may go on: it opens the next piece
            yield features[:-1]
            start, size = start + int(at[-1]), limit
        else:
            size *= 2
