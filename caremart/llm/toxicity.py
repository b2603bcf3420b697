"""Toxicity by nearest labelled examples: exact TF-IDF cosine, distance-weighted votes.

``fit`` takes a bounded sample of labelled rows (``MAX_TOXIC`` + ``MAX_CLEAN`` documents, the
smallest hashes of their ids), counts near copies with one label once (half of a bottom sketch of
five-word shingles in common), selects the terms that tell the labels apart, and keeps the
examples' unit TF-IDF vectors over these terms in a block-max inverted index: postings by term,
and each term's largest weight in every block of ``BLOCK`` examples.  Terms are whole words and
the first 4 to 6 bytes of longer ones (to the end of a character), so inflected forms meet.  Inverse document frequencies
count every document of the corpus.

``score`` bounds each block by the sum of its terms' maxima, evaluates the best blocks first
and then every block that can still hold one of the k nearest, so the search is exact.  The
neighbours vote with their cosines; a monotone map fitted on leave-one-out votes of the sample
(weighted back to all labelled rows) turns votes into probabilities.  A text without any
selected term gets the rate of toxic labels among such examples.  Whole texts are read.

Defined cases: a null or empty text scores like a text without selected terms; rows of
``labels`` with a null id or label are ignored, an id labelled twice counts as toxic if any of
its labels is; without a toxic or without a clean example every score is the (smoothed) rate 0;
equal cosines go to the example with the smaller id; repeated rows stay; further columns are
ignored.  Only the text enters a score.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caremart.llm.common import cut, md5_long, slices

MAX_TOXIC, MAX_CLEAN = 4_000, 8_000  # bound of the sample of labelled rows
MAX_TERMS = 4_096  # bound of the vocabulary, most telling first
MIN_EXAMPLES, MIN_Z, MIN_ODDS = 3, 4.0, math.log(4)
MIN_SHARE = 0.015  # of a label's examples that a telling term occurs in, so alike for small and large samples
SHINGLE, SKETCH = 5, 16  # words of a shingle, and least hashes kept of a text
PREFIXES = (4, 5, 6)
NEIGHBOURS = 15
BLOCK = 64
FIRST_BLOCKS = 8
THRESHOLD = 0.3

# Lower-cased UTF-8 bytes to words: ASCII signs and white space part words.
_WORDS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_WORDS).split()


def terms(word: bytes) -> list[bytes]:
    """A word's terms; a prefix is marked so that it never equals a whole word."""
    out = [word]
    for n in PREFIXES:
        while n < len(word) and word[n] & 0xC0 == 0x80:  # inside a character
            n += 1
        if n < len(word):
            out.append(word[:n] + b"*")
    return out


def sketch(text: str | None) -> list[int]:
    """The least hashes of a text's shingles (of the whole text, if it is shorter)."""
    ws = words(text)
    found = {zlib.crc32(b" ".join(ws[i:i + SHINGLE])) for i in range(max(1, len(ws) - SHINGLE + 1))}
    return heapq.nsmallest(SKETCH, found)


def independent(sketches: list[tuple[int, int, list[int]]]) -> set[int]:
    """Ids of the examples (id, label, sketch) without near copies of an earlier one with their label."""
    kept: set[int] = set()
    holders: dict[tuple[int, int], list[int]] = {}
    for i, label, own in sorted(sketches):
        shared = Counter(j for h in own for j in holders.get((label, h), ()))
        if not shared or 2 * max(shared.values()) < len(own):
            kept.add(i)
            for h in own:
                holders.setdefault((label, h), []).append(i)
    return kept


class Vocabulary:
    """The selected terms; ``count`` gives the term counts of a text."""

    def __init__(self, selected: list[bytes]):
        self.selected = selected
        self.number = {t: i for i, t in enumerate(selected)}
        self.starts = {t.rstrip(b"*")[:4] for t in selected}

    def count(self, text: str | None) -> Counter:
        found: Counter = Counter()
        starts, number = self.starts, self.number
        for w, n in Counter([w for w in words(text) if w[:4] in starts]).items():
            for t in terms(w):
                if (i := number.get(t)) is not None:
                    found[i] += n
        return found


@dataclass
class Index:
    """Block-max inverted index over unit vectors of examples."""

    postings: list[tuple[np.ndarray, np.ndarray]]  # by term: examples ascending, weights
    maxima: np.ndarray  # term x block
    labels: np.ndarray
    ids: np.ndarray

    @classmethod
    def build(cls, vectors: list[dict[int, float]], labels: list[int], ids: list[int], n_terms: int) -> "Index":
        lists: list[list[tuple[int, float]]] = [[] for _ in range(n_terms)]
        maxima = np.zeros((n_terms, max(1, -(-len(vectors) // BLOCK))))
        for e, v in enumerate(vectors):
            for t, w in v.items():
                lists[t].append((e, w))
                maxima[t, e // BLOCK] = max(maxima[t, e // BLOCK], w)
        postings = [(np.array([e for e, _ in x], np.int64), np.array([w for _, w in x])) for x in lists]
        return cls(postings, maxima, np.array(labels, np.int64), np.array(ids, np.int64))

    def _evaluate(self, query: dict[int, float], alive: np.ndarray) -> np.ndarray:
        scores = np.zeros(len(self.ids))
        for t, w in query.items():
            e, weights = self.postings[t]
            on = alive[e // BLOCK]
            scores[e[on]] += w * weights[on]
        return scores

    def nearest(self, query: dict[int, float], k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest positive cosine and these, nearest first."""
        at = list(query)
        bound = np.array([query[t] for t in at]) @ self.maxima[at]
        alive = np.zeros(len(bound), bool)
        alive[np.argsort(-bound, kind="stable")[:FIRST_BLOCKS]] = True
        scores = self._evaluate(query, alive)
        if without >= 0:
            scores[without] = 0
        kth = np.partition(scores, -k)[-k] if len(scores) > k else 0.0
        rest = (bound >= kth - 1e-9) & (bound > 0) & ~alive
        if rest.any():
            scores += self._evaluate(query, rest)
            if without >= 0:
                scores[without] = 0
        found = np.flatnonzero(scores > 0)
        if len(found) > k:
            found = found[scores[found] >= np.partition(scores[found], -k)[-k]]
        best = found[np.lexsort((self.ids[found], -scores[found]))][:k]
        return best, scores[best]


def _vector(counts: Counter, idf: np.ndarray) -> dict[int, float]:
    raw = {t: (1 + math.log(n)) * idf[t] for t, n in sorted(counts.items())}
    norm = math.sqrt(sum(w * w for w in raw.values()))
    return {t: w / norm for t, w in raw.items()} if norm else {}


def _vote(labels: np.ndarray, cosines: np.ndarray) -> float:
    weights = 1 / (1.05 - np.minimum(cosines, 1))
    return float((weights * labels).sum() / weights.sum())


def _monotone(x: list[float], y: list[int], w: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression (pooled neighbours), smoothed by half a row of each label."""
    pools: list[list[float]] = []  # sum of w*y, sum of w, least x, largest x
    for a, b, c in sorted(zip(x, y, w, strict=True)):
        pools.append([b * c, c, a, a])
        while len(pools) > 1 and (pools[-2][3] == pools[-1][2]
                                  or pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]):
            s, n, _, top = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2], top]
    xs = [v for p in pools for v in (p[2], p[3])]
    ys = [(p[0] + 0.5) / (p[1] + 1) for p in pools for _ in (0, 1)]
    return np.array(xs), np.maximum.accumulate(np.array(ys)) if ys else np.array(ys)


@dataclass
class Model:
    vocabulary: Vocabulary
    idf: np.ndarray
    index: Index
    base: float
    votes: np.ndarray
    chances: np.ndarray
    k: int

    def score(self, text: str | None) -> tuple[float, list[tuple[int, float, int]]]:
        """Probability, and the voters (example's id, cosine, label) as evidence."""
        query = _vector(self.vocabulary.count(text), self.idf)
        best, cosines = self.index.nearest(query, self.k) if query and len(self.index.ids) else ([], [])
        if not len(best):
            return self.base, []
        labels = self.index.labels[best]
        chance = float(np.interp(_vote(labels, cosines), self.votes, self.chances)) if len(self.votes) else self.base
        return chance, list(zip(self.index.ids[best].tolist(), np.minimum(cosines, 1).tolist(), labels.tolist(), strict=True))


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN,
        k: int = NEIGHBOURS) -> Model:
    """Fit on at most ``max_toxic`` + ``max_clean`` labelled documents."""
    spark = docs.sparkSession
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = md5_long(F.col("doc_id").cast("string"))
    sample = (known.filter("toxic = 1").orderBy(order, "doc_id").limit(max_toxic)
              .union(known.filter("toxic = 0").orderBy(order, "doc_id").limit(max_clean)))
    chosen = {r["doc_id"]: r["toxic"] for r in sample.collect()}  # bounded by the two parameters
    n = [sum(v == c for v in chosen.values()) for c in (0, 1)]
    none = Model(Vocabulary([]), np.zeros(0), Index.build([], [], [], 0), 0.0, np.zeros(0), np.zeros(0), k)
    if not n[0] or not n[1]:
        return none
    small = spark.createDataFrame(list(chosen.items()), "doc_id long, toxic int")
    sampled = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                  .join(F.broadcast(small), "doc_id").select("doc_id", "toxic", "text"), "toxicity-sample")

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([sketch(t) for t in b.column(2).to_pylist()], pa.list_(pa.int64()))],
                names=["doc_id", "toxic", "sketch"])

    # one sketch an example (an id with several texts: its least), so bounded like the sample
    seen_once = (sampled.mapInArrow(sketches, "doc_id long, toxic int, sketch array<long>")
                 .groupBy("doc_id", "toxic").agg(F.min("sketch").alias("sketch")).collect())
    kept_ids = independent([(r["doc_id"], r["toxic"], r["sketch"]) for r in seen_once])
    n = [sum(r["doc_id"] in kept_ids and r["toxic"] == c for r in seen_once) for c in (0, 1)]
    if not n[0] or not n[1]:
        return none
    picked = sampled.join(F.broadcast(spark.createDataFrame([(i,) for i in kept_ids], "doc_id long")), "doc_id")\
        .select("doc_id", "toxic", "text")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for label, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                counts[label].update({t for w in set(words(text)) for t in terms(w)})
            both = list(set(counts[0]) | set(counts[1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(both, pa.binary()), pa.array([counts[0][t] for t in both], pa.int64()),
                 pa.array([counts[1][t] for t in both], pa.int64())], names=["term", "clean", "toxic"])

    seen = (picked.mapInArrow(spread, "term binary, clean long, toxic long")
            .groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    p0, p1 = (F.col("clean") + 0.5) / (n[0] + 1), (F.col("toxic") + 0.5) / (n[1] + 1)
    odds = F.log(p1 / (1 - p1)) - F.log(p0 / (1 - p0))
    pooled = (F.col("clean") + F.col("toxic") + 1) / (n[0] + n[1] + 2)
    z = (p1 - p0) / F.sqrt(pooled * (1 - pooled) * (1 / n[0] + 1 / n[1]))
    spread_enough = (F.col("toxic") >= MIN_SHARE * n[1]) | (F.col("clean") >= MIN_SHARE * n[0])
    telling = (seen.filter((F.col("clean") + F.col("toxic") >= MIN_EXAMPLES) & spread_enough
                           & (F.abs(odds) >= MIN_ODDS) & (F.abs(z) >= MIN_Z))
               .orderBy(F.desc(F.abs(z)), "term").limit(MAX_TERMS).select("term").collect())
    vocabulary = Vocabulary([bytes(r["term"]) for r in telling])

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = Counter(), 0
        for b in slices(batches):
            rows += b.num_rows
            for text in b.column(0).to_pylist():
                counts.update(vocabulary.count(text).keys())
        yield pa.RecordBatch.from_arrays([pa.array([-1, *counts.keys()], pa.int32()),
                                          pa.array([rows, *counts.values()], pa.int64())], names=["term", "n"])

    # one row per selected term: bounded by MAX_TERMS
    df = {r["term"]: r["n"] for r in docs.select("text").mapInArrow(frequency, "term int, n long")
          .groupBy("term").agg(F.sum("n").alias("n")).collect()}
    idf = np.array([math.log((1 + df.get(-1, 0)) / (1 + df.get(i, 0))) + 1 for i in range(len(telling))])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            counts = [vocabulary.count(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([list(c.keys()) for c in counts], pa.list_(pa.int32())),
                 pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))],
                names=["doc_id", "toxic", "terms", "n"])

    # bounded: sampled rows times selected terms
    rows = picked.mapInArrow(vectors, "doc_id long, toxic int, terms array<int>, n array<long>").collect()
    examples = sorted((r["doc_id"], r["toxic"], sorted(zip(r["terms"], r["n"], strict=True))) for r in rows)
    weight = [totals.get(c, 0) / n[c] for c in (0, 1)]
    blank = [0.0, 0.0]
    kept = []
    for doc_id, toxic, counts in examples:
        if counts:
            kept.append((doc_id, toxic, _vector(Counter(dict(counts)), idf)))
        else:
            blank[toxic] += weight[toxic]
    index = Index.build([v for *_, v in kept], [t for _, t, _ in kept], [d for d, *_ in kept], len(telling))
    x, y, w = [], [], []
    for e, (_, toxic, v) in enumerate(kept):
        best, cosines = index.nearest(v, k, without=e)
        if len(best):
            x.append(_vote(index.labels[best], cosines))
            y.append(toxic)
            w.append(weight[toxic])
    votes, chances = _monotone(x, y, w)
    base = (blank[1] + 0.5) / (sum(blank) + 5)
    return Model(vocabulary, idf, index, base, votes, chances, k)


def score(docs: DataFrame, model: Model, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """``doc`` (struct of the ``keep`` columns), score, predicted and evidence (the voters) of
    every document, from its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample and the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int64())]))
        for b in slices(batches):
            found = [m.score(t) for t in b.column(1).to_pylist()]
            chance = np.array([s for s, _ in found])
            voters = [[{"doc_id": d, "cosine": c, "toxic": y} for d, c, y in v] for _, v in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(chance, pa.float64()), pa.array((chance >= threshold).astype(np.int32)),
                 pa.array(voters, kind)], names=["doc", "score", "predicted", "evidence"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), F.col("text").cast("string").alias("text"))
    voter = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("cosine", T.DoubleType()),
                          T.StructField("toxic", T.LongType())])
    return rows.mapInArrow(run, T.StructType([
        T.StructField("doc", rows.schema["doc"].dataType), T.StructField("score", T.DoubleType()),
        T.StructField("predicted", T.IntegerType()), T.StructField("evidence", T.ArrayType(voter))]))


def held_out(doc_id="doc_id"):
    """True for ids whose crc32, as text, leaves 2 when divided by 4 (false for null)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit_open(docs: DataFrame, labels: DataFrame, **bounds) -> Model:
    """``fit`` on the labelled rows that are not held out."""
    return fit(docs, labels.filter(~held_out()), **bounds)
