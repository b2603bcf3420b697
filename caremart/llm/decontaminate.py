"""Benchmark decontamination with an FM-index per shard of training documents.

A benchmark item's windows are its runs of ``window`` consecutive words (an item of fewer
words, but not none, is one window).  Each task cuts its documents into shards and builds an
FM-index over each shard: words become numbers, the suffixes of the shard are sorted by prefix
doubling, and the Burrows-Wheeler transform is kept as a wavelet matrix.  All windows are searched
backward at once by ranks in that matrix, occurrences are located by walking to sampled suffix
positions, and the words they cover are merged into spans.

Only words of the benchmark can be part of an occurrence, so the index holds the maximal runs of
benchmark words of at least the shortest window's length; everything else separates runs.  This
is exact and keeps the index small.  Documents are never shuffled.  A large benchmark is
searched in parts of about ``PART_WORDS`` words, each broadcast in turn; spans and items add up.

Defined cases: a null text has no words and is clean; a null or wordless benchmark text has no
window; rows with a null ``item_id`` still mark words and count as the item of that empty name; equal item
ids are one item; repeated documents stay rows; empty tables are fine; with ``mark`` further
columns ride along in a struct, so their names can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caremart.llm.common import slices
from caremart.llm.shingles import words

WINDOW = 13
PART_WORDS = 1_000_000  # benchmark words searched (and broadcast) at a time
SHARD_WORDS = 500_000  # words of a shard, at least one document
SAMPLE = 8  # every so many positions of a run are sampled for locating
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling.  Zeros are separators, each smaller than every word
    and than the separators after it, so no comparison goes on past one."""
    n = len(symbols)
    ends = symbols == 0
    rank = np.where(ends, np.cumsum(ends) - 1, symbols.astype(np.int64) + int(ends.sum()))
    step = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[:-step] = rank[step:] + 1
        order = np.lexsort((ahead, rank))
        first = np.empty(n, bool)
        first[0] = True
        first[1:] = (rank[order][1:] != rank[order][:-1]) | (ahead[order][1:] != ahead[order][:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(first) - 1
        if first.all():
            return order
        step *= 2


class Wavelet:
    """Wavelet matrix: ranks of symbols in prefixes of a sequence, for many at once."""

    def __init__(self, sequence: np.ndarray):
        self.bits = max(1, int(sequence.max()).bit_length())
        self.ones: list[np.ndarray] = []  # by level: number of ones before each place
        self.zeros: list[int] = []
        for level in reversed(range(self.bits)):
            bit = (sequence >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])

    def _descend(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for level, ones, zeros in zip(reversed(range(self.bits)), self.ones, self.zeros, strict=True):
            before = ones[place]
            place = np.where((symbol >> level) & 1, zeros + before, place - before)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        return self._descend(symbol, place) - self._descend(symbol, np.zeros_like(place))

    def access(self, place: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(place)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            before = ones[place]
            bit = ones[place + 1] - before
            symbol = symbol * 2 + bit
            place = np.where(bit, zeros + before, place - before)
        return symbol


class FMIndex:
    """Full-text index of a sequence of numbers; zeros separate runs, the last symbol is zero."""

    def __init__(self, symbols: np.ndarray):
        order = suffix_order(symbols)
        self.n = len(symbols)
        self.bwt = Wavelet(symbols[order - 1])
        counts = np.bincount(symbols)
        self.less = np.concatenate([[0], np.cumsum(counts)])  # symbols smaller than each
        starts = np.flatnonzero(np.concatenate([[True], symbols[:-1] == 0]))  # of runs
        place = np.arange(self.n)
        in_run = place - starts[np.searchsorted(starts, place, "right") - 1]
        sampled = (in_run % SAMPLE == 0)[order]
        self.sampled = sampled
        self.before = np.concatenate([[0], np.cumsum(sampled)])
        self.positions = order[sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each pattern (one a row, equal lengths)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        alive = np.flatnonzero((patterns < len(self.less) - 1).all(axis=1))
        dead = np.ones(len(patterns), bool)
        dead[alive] = False
        for column in reversed(range(patterns.shape[1])):
            c = patterns[alive, column]
            base = self.less[c]
            low[alive] = base + self.bwt.rank(c, low[alive])
            high[alive] = base + self.bwt.rank(c, high[alive])
            gone = high[alive] <= low[alive]
            dead[alive[gone]] = True
            alive = alive[~gone]
        high[dead] = low[dead]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by steps back to the nearest sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.sampled[rows])
        while len(todo):
            c = self.bwt.access(rows[todo])
            rows[todo] = self.less[c] + self.bwt.rank(c, rows[todo])
            steps[todo] += 1
            todo = todo[~self.sampled[rows[todo]]]
        return self.positions[self.before[rows]] + steps


class Phrases:
    """The windows of some benchmark items, as numbers, with the items each belongs to."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.number: dict[bytes, int] = {}
        self.names = sorted({i for i, _ in items})
        name = {x: i for i, x in enumerate(self.names)}
        owners: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            own = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            k = min(window, len(own))
            for i in range(len(own) - k + 1 if k else 0):
                owners.setdefault(tuple(own[i:i + k]), set()).add(name[item])
        self.shortest = min(map(len, owners), default=0)
        self.groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # patterns, owners' starts, owners
        for size in sorted({len(p) for p in owners}):
            own = [(p, sorted(o)) for p, o in owners.items() if len(p) == size]
            self.groups.append((np.array([p for p, _ in own], np.int64),
                                np.cumsum([0, *(len(o) for _, o in own)]),
                                np.array([i for _, o in own for i in o], np.int64)))

    def find(self, docs: list[np.ndarray]) -> list[tuple[list[tuple[int, int]], list[str]]]:
        """Merged hit spans (in words) and item names of each document (arrays of numbers,
        0 for words that aren't the benchmark's)."""
        none: list[tuple[list[tuple[int, int]], list[str]]] = [([], []) for _ in docs]
        if not self.shortest or not docs:
            return none
        # a zero after each document, so that no run crosses
        flat = np.concatenate([x for d in docs for x in (d, np.zeros(1, np.int64))])
        first = np.cumsum([0, *(len(d) + 1 for d in docs)])
        zero = np.flatnonzero(flat == 0)
        begins = np.concatenate([[0], zero[:-1] + 1])
        long = zero - begins >= self.shortest
        begins, lengths = begins[long], (zero - begins)[long] + 1  # with the closing zero
        if not len(begins):
            return none
        before = np.cumsum(lengths) - lengths
        origin = np.repeat(begins - before, lengths) + np.arange(int(lengths.sum()))
        index = FMIndex(flat[origin])
        delta = np.zeros(len(flat) + 1, np.int64)
        seen: list[np.ndarray] = []
        for patterns, starts, owners in self.groups:
            low, high = index.search(patterns)
            count = high - low
            hit = np.flatnonzero(count)
            if not len(hit):
                continue
            n = count[hit]
            rows = np.repeat(low[hit] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            at = origin[index.locate(rows)]
            np.add.at(delta, at, 1)
            np.add.at(delta, at + patterns.shape[1], -1)
            pairs = np.unique(np.stack([np.searchsorted(first, at, "right") - 1, np.repeat(hit, n)], 1), axis=0)
            m = starts[pairs[:, 1] + 1] - starts[pairs[:, 1]]
            which = np.repeat(starts[pairs[:, 1]] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            seen.append(np.unique(np.stack([np.repeat(pairs[:, 0], m), owners[which]], 1), axis=0))
        if not seen:
            return none
        covered = np.concatenate([[0], (np.cumsum(delta[:-1]) > 0).astype(np.int8), [0]])
        edge = np.diff(covered)
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            d = int(np.searchsorted(first, a, "right")) - 1
            none[d][0].append((a - int(first[d]), b - int(first[d])))
        for d, i in np.unique(np.concatenate(seen), axis=0).tolist():
            none[d][1].append(self.names[i])
        return none


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the characters from the first to the last word of each span."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def mark(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW,
         part_words: int = PART_WORDS, shard_words: int = SHARD_WORDS, cut_text: bool = False) -> DataFrame:
    """``doc`` (struct of the ``keep`` columns), n_words, spans (in words), items (found ids),
    n_hit and contaminated of every document; with ``cut_text`` also ``clean_text``, the text
    without its spans."""
    sc = docs.sparkSession.sparkContext
    wanted = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").dropna()
    total = wanted.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    parts = max(1, -(-total // (4 * part_words)))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(parts))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), F.col("text").cast("string").alias("text"),
                         F.lit(0).cast("long").alias("n_words"),
                         F.array().cast("array<struct<start: long, stop: long>>").alias("spans"),
                         F.array().cast("array<string>").alias("items"))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in packed.schema])
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    rows = packed
    for p in range(parts):
        items = [(r["item"], r["text"]) for r in wanted.filter(part == p).collect()]  # about part_words words
        shared = sc.broadcast(Phrases(items, window))
        last = p == parts - 1

        def search(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            phrases = shared.value
            number = phrases.number

            def close(held: list[pa.RecordBatch], docs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
                found, at = phrases.find(docs), 0
                for b in held:
                    own = found[at:at + b.num_rows]
                    sizes = [len(d) for d in docs[at:at + b.num_rows]]
                    at += b.num_rows
                    old = b.column(3).to_pylist(), b.column(4).to_pylist()
                    spans = [_merged([*s, *((x["start"], x["stop"]) for x in o)]) for (s, _), o in zip(own, old[0], strict=True)]
                    names = [sorted({*i, *o}) for (_, i), o in zip(own, old[1], strict=True)]
                    text = b.column(1)
                    if last:
                        text = pa.array([None if t is None or not cut_text else without_spans(t, s) if s else t
                                         for t, s in zip(text.to_pylist(), spans, strict=True)] if cut_text
                                        else [None] * b.num_rows, pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0), text, pa.array(sizes, pa.int64()),
                         pa.array([[{"start": x, "stop": y} for x, y in s] for s in spans], span_type),
                         pa.array(names, pa.list_(pa.string()))], names=["doc", "text", "n_words", "spans", "items"])

            held: list[pa.RecordBatch] = []
            docs: list[np.ndarray] = []
            n = 0
            for b in slices(batches):
                for t in b.column(1).to_pylist():
                    own = words(t)
                    docs.append(np.fromiter((number.get(w, 0) for w in own), np.int64, len(own)))
                    n += len(own)
                held.append(b)
                if n >= shard_words:
                    yield from close(held, docs)
                    held, docs, n = [], [], 0
            if held:
                yield from close(held, docs)

        rows = rows.mapInArrow(search, schema)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["stop"] - s["start"])
    out = rows.withColumn("n_hit", n_hit)
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    return out.withColumnRenamed("text", "clean_text") if cut_text else out.drop("text")


def items_digest(items: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(items), ","), 256)
