"""Exact tokenizer encoding with a bounded cache of white-space chunks.

Valid for a tokenizer whose pre-tokenizer drops white space and treats every
piece between white space on its own (true of ``word_bpe_49k.json``): a text's
ids are then the ids of its chunks, one after another.  Arrow splits texts into
chunks (a word's closing signs apart) and numbers the distinct ones, the cache
answers for those it knows, and the tokenizers library encodes the rest, words
of plain letters in one call.  A chunk is remembered from its second sight on,
so words that occur once neither fill the cache nor push out those in use.
"""

from __future__ import annotations

import os
from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MAX_CACHED = 300_000  # chunks kept per worker; beyond it the less used half goes
SEEN_SLOTS = 1 << 22  # a power of two; one byte each: hashes of chunks seen
SLICE_ROWS = 1024  # texts that are Python strings at a time
SPLIT_CHARS = 3_000_000  # texts are encoded in runs of about so many characters
WORD_END = "</w>"  # closes the last token of every piece in a vocabulary with word ends
LETTERS = "a-zß-öø-ÿ"  # lower-case letters of Latin-1 that no normalizing changes
# A letter and the signs between it and the chunk's end, which the pre-tokenizer always parts.
TAIL = f"([{LETTERS}])([.,;:!?*%#$&\"()-]+)( |$)"

_ENCODERS: dict[str, "ChunkEncoder"] = {}


def encoder(path: str) -> "ChunkEncoder":
    """The worker's encoder for a vocabulary file, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def _plain(text: str) -> str:
    """Lower-cased where that can't differ from the tokenizer's own lower-casing: in Latin-1, which
    holds no character whose lower case depends on its neighbours or is more than one."""
    if text.isascii():
        return text.lower()
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


class ChunkEncoder:
    def __init__(self, path: str, max_cached: int = MAX_CACHED, seen_slots: int = SEEN_SLOTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a piece
        self.closes[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        # for words of LETTERS, handed over as the pre-tokenizer hands them to the model
        self.words = Tokenizer.from_file(path)
        self.words.normalizer, self.words.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        # a letter's bytes are its bytes read as Latin-1, but for the few that the vocabulary renames
        letters = [chr(c) for c in [*range(0xDF, 0xF7), *range(0xF8, 0x100)]]
        pieces = {c.encode().decode("latin-1"): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters}
        self.renamed = [(plain, name) for plain, name in pieces.items() if plain != name]
        self.max_cached = max_cached
        self.seen = np.zeros(seen_slots, np.uint8)
        self._reset()

    def _reset(self) -> None:
        # every chunk's ids lie in flat; the index names those that are remembered
        self.index: dict[str, int] = {"": 0}
        self.start, self.size = array("q", [0]), array("q", [0])
        self.flat = array("I", [0])
        self.uses = np.zeros(1, np.int64)

    def _forget(self) -> None:
        """Drop what is not remembered, and of that the less used half if it is too much."""
        self.uses.resize(len(self.start))
        names = list(self.index)
        at = np.fromiter(self.index.values(), np.int64, len(names))
        uses = self.uses[at]
        keep = uses > (np.partition(uses, -(self.max_cached // 2))[-(self.max_cached // 2)] if len(names) > self.max_cached > 1 else -1)
        keep[0] = True
        kept = np.flatnonzero(keep)
        at, size = at[kept], np.frombuffer(self.size, np.int64)[at[kept]]
        flat = self._gather(at, size)
        self._reset()
        self.index = dict(zip((names[i] for i in kept.tolist()), range(len(kept)), strict=True))
        self.start, self.size, self.flat = array("q"), array("q"), array("I")
        self._store(flat, size)
        self.uses = uses[kept] // 2

    def _gather(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        before = np.cumsum(size) - size
        start = np.frombuffer(self.start, np.int64)[at]
        return np.frombuffer(self.flat, np.uint32)[np.repeat(start - before, size) + np.arange(int(size.sum()))]

    def _store(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Append the ids of new chunks; their numbers."""
        first = len(self.start)
        self.start.frombytes((len(self.flat) + np.cumsum(sizes) - sizes).astype(np.int64).tobytes())
        self.size.frombytes(sizes.astype(np.int64).tobytes())
        self.flat.frombytes(ids.astype(np.uint32).tobytes())
        return np.arange(first, first + len(sizes))

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of LETTERS as one text, and how many each word has: a word's last token closes it."""
        text = " ".join(words)
        if not text.isascii():
            text = text.encode().decode("latin-1")
            for plain, name in self.renamed:
                text = text.replace(plain, name)
        ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        sizes = np.diff(np.flatnonzero(self.closes[ids]), prepend=-1)
        if len(sizes) != len(words):
            raise ValueError("the vocabulary does not close every word with an end token")
        return ids, sizes

    def _encode_others(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)

    def _learn(self, chunks: pa.Array) -> np.ndarray:
        """Numbers of distinct chunks that are not remembered; those seen before are from now on."""
        plain = pc.match_substring_regex(chunks, f"^[{LETTERS}]+$").to_numpy(zero_copy_only=False)
        names = chunks.to_pylist()
        numbers = np.zeros(len(names), np.int64)
        for where, encode in ((np.flatnonzero(plain), self._encode_words), (np.flatnonzero(~plain), self._encode_others)):
            if len(where):
                numbers[where] = self._store(*encode([names[i] for i in where.tolist()]))
        slots = np.fromiter(map(hash, names), np.int64, len(names)) & (len(self.seen) - 1)
        again = np.flatnonzero(self.seen[slots])
        self.seen[slots] = 1
        self.index.update(zip([names[i] for i in again.tolist()], numbers[again].tolist(), strict=True))
        return numbers

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and the number of ids of each."""
        if len(self.index) > self.max_cached or len(self.start) > 2 * self.max_cached:
            self._forget()
        whole: dict[int, np.ndarray] = {}  # texts that may hold a special token's name
        for i, t in enumerate(texts):
            if "<|" in t:
                whole[i] = np.asarray(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
        lines = pa.array(["" if i in whole else _plain(t).replace("\n", " ") for i, t in enumerate(texts)], pa.large_string())
        chunks = pc.split_pattern(pc.replace_substring_regex(lines, TAIL, r"\1 \2\3"), " ")
        counts = np.diff(chunks.offsets.to_numpy())
        encoded = chunks.flatten().dictionary_encode()
        distinct = encoded.dictionary
        at = np.fromiter(map(self.index.get, distinct.to_pylist(), repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            at[missing] = self._learn(distinct.take(pa.array(missing)))
        at = at[encoded.indices.to_numpy()]
        uses = np.bincount(at, minlength=len(self.start))
        uses[:len(self.uses)] += self.uses
        self.uses = uses
        size = np.frombuffer(self.size, np.int64)[at]
        ids = self._gather(at, size)
        lengths = np.add.reduceat(size, np.cumsum(counts) - counts) if len(texts) else counts
        if whole:
            ends = np.cumsum(lengths)
            parts = [whole.get(i, ids[e - n:e]) for i, (e, n) in enumerate(zip(ends, lengths, strict=True))]
            lengths = np.array([len(p) for p in parts], np.int64)
            ids = np.concatenate(parts)
        return ids, lengths


def runs(texts: list[str | None], limit: int = SPLIT_CHARS):
    """(first, last) index pairs of consecutive texts of about ``limit`` characters together."""
    first = chars = 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= limit:
            yield first, i + 1
            first, chars = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with ``end_id`` after each text, and the lengths with it."""
    ends = np.cumsum(lengths)
    return np.insert(ids, ends, np.uint32(end_id)), lengths + 1
