"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages (``passages``); only the bag has a label.  Each passage x becomes
h = tanh(W x + b), its gated attention is a = softmax over the bag of w.(tanh(V h) * sigmoid(U h)),
the document is the weighted representation z = sum of a h, and its score is sigmoid(c.z + c0).
All parts learn together from the documents' labels by gradient descent (Adam), so attention finds
by itself the passages that decide.

``fit`` takes a bounded sample of labelled rows: per label at most ``MAX_EACH`` documents of the
smallest hashes of their ids, none longer than ``MAX_BYTES``, at most ``MAX_PASSAGES`` passages in
all.  The losses are weighted back to all labelled rows, so scores are probabilities.  ``score``
reads every text whole; a long one is encoded in pieces whose attention sums are merged, so memory
doesn't grow with the text.

Defined cases: a null, empty or blank text is a bag of one passage of zeros; rows of ``labels``
with a null id or label are ignored, an id labelled twice counts as 1 only if all its labels are;
an id with several texts is learned from the least of them; without examples of both labels every
score is the (smoothed) share of label 1; equal texts get equal scores, repeated rows stay; an
empty table gives an empty result; further columns are ignored.  Only the text enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caremart.llm import passages
from caremart.llm.common import cut, md5_long, slices
from caremart.llm.encoding import runs

MAX_EACH = 2_000  # sampled documents per label
MAX_BYTES = 1 << 20  # longest text to learn from
MAX_PASSAGES = 60_000  # passages to learn from
HIDDEN, GATES = 32, 16
EPOCHS, BAGS, RATE, DECAY = 30, 64, 3e-3, 0.01
SEED = 11
THRESHOLD = 0.7
CLIP = 6.0
DIGITS = 9  # of a score: what differs with the texts encoded beside it is far smaller


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Network:
    """Encoder, gated attention and classifier."""

    weights: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray
    moments: dict[str, list[np.ndarray]] = field(default_factory=dict)
    steps: int = 0

    @classmethod
    def fresh(cls, x: np.ndarray, seed: int = SEED, hidden: int = HIDDEN, gates: int = GATES) -> "Network":
        rng = np.random.default_rng(seed)
        mean, deviation = x.mean(axis=0, dtype=np.float64), x.std(axis=0, dtype=np.float64)

        def part(*shape: int) -> np.ndarray:
            return (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)

        weights = {"W": part(x.shape[1], hidden), "b": np.zeros(hidden, np.float32), "V": part(hidden, gates),
                   "U": part(hidden, gates), "w": part(gates), "c": part(hidden), "c0": np.zeros(1, np.float32)}
        return cls(weights, mean.astype(np.float32), np.where(deviation > 1e-6, 1 / np.maximum(deviation, 1e-6), 0).astype(np.float32))

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) * self.scale, -CLIP, CLIP).astype(self.weights["W"].dtype)

    def passages(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """h, both gates and the attention before its softmax, of scaled passages."""
        p = self.weights
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        return h, t, s, (t * s) @ p["w"]

    def logits(self, x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, tuple]:
        """One logit a bag; bags (none empty) follow each other in ``x``."""
        h, t, s, e = self.passages(x)
        first, bag = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
        a = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a /= np.add.reduceat(a, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return z @ self.weights["c"] + self.weights["c0"][0], (h, t, s, a, z, first, bag)

    def gradients(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted mean log loss of the bags, and its gradients."""
        p = self.weights
        logit, (h, t, s, a, z, first, bag) = self.logits(x, sizes)
        share = weight / weight.sum()
        loss = float((share * (np.logaddexp(0, logit) - y * logit)).sum())
        d_logit = (share * (_sigmoid(logit) - y)).astype(h.dtype)
        d_z = (d_logit[:, None] * p["c"])[bag]
        d_a = (h * d_z).sum(axis=1)
        d_e = a * (d_a - np.add.reduceat(a * d_a, first)[bag])
        d_gate = d_e[:, None] * p["w"]
        d_t, d_s = d_gate * s * (1 - t * t), d_gate * t * s * (1 - s)
        d_h = (a[:, None] * d_z + d_t @ p["V"].T + d_s @ p["U"].T) * (1 - h * h)
        return loss, {"W": x.T @ d_h, "b": d_h.sum(axis=0), "V": h.T @ d_t, "U": h.T @ d_s, "w": (t * s).T @ d_e,
                      "c": z.T @ d_logit, "c0": d_logit.sum(keepdims=True)}

    def step(self, gradients: dict[str, np.ndarray], rate: float, decay: float) -> None:
        """Adam, with the weights' decay apart from the gradients."""
        self.steps += 1
        for k, g in gradients.items():
            m, v = self.moments.setdefault(k, [np.zeros_like(g), np.zeros_like(g)])
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            move = m / (1 - 0.9**self.steps) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)
            self.weights[k] -= (rate * (move + decay * self.weights[k])).astype(np.float32)

    def chance(self, features: Iterator[np.ndarray]) -> float:
        """Score of one document whose passages come in pieces: attention sums are rescaled and added."""
        top, mass, z = -np.inf, 0.0, np.zeros(len(self.weights["c"]), np.float64)
        for x in features:
            h, _, _, e = self.passages(self.scaled(x))
            new = max(top, float(e.max()))
            old = np.exp(top - new) if mass else 0.0
            a = np.exp(e.astype(np.float64) - new)
            top, mass, z = new, mass * old + float(a.sum()), z * old + a @ h
        return float(_sigmoid(np.float64(z @ self.weights["c"] / mass + self.weights["c0"][0])))

    def chances(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Scores of several documents; one without passages is one passage of zeros."""
        if (sizes == 0).any():
            x = np.insert(x, np.repeat(np.cumsum(sizes), sizes == 0), 0, axis=0)
            sizes = np.maximum(sizes, 1)
        return _sigmoid(self.logits(self.scaled(x), sizes)[0].astype(np.float64)) if len(sizes) else np.zeros(0)


@dataclass
class Model:
    network: Network | None
    base: float
    losses: list[float] = field(default_factory=list)

    def scores(self, texts: list[str | None]) -> list[float]:
        if self.network is None:
            return [self.base] * len(texts)
        out = []
        for i, j in runs(texts, passages.RUN_CHARS):
            part = [t or "" for t in texts[i:j]]
            if len(part[-1]) > passages.RUN_CHARS:  # a run ends with its long text, if any
                out += [*self._short(part[:-1]), self.network.chance(self._pieces(part[-1]))]
            else:
                out += self._short(part)
        return [round(c, DIGITS) for c in out]

    @staticmethod
    def _pieces(text: str) -> Iterator[np.ndarray]:
        some = False
        for x in passages.pieces(text):
            some = True
            yield x
        if not some:
            yield np.zeros((1, passages.FEATURES), np.float32)

    def _short(self, texts: list[str]) -> list[float]:
        if not texts:
            return []
        x, sizes, _ = passages.encode(texts)
        return self.network.chances(x, sizes).tolist()


def train(x: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS,
          bags: int = BAGS, rate: float = RATE, decay: float = DECAY, seed: int = SEED) -> tuple[Network, list[float]]:
    """Fit a network to bags of raw passages; returns it with the loss of every epoch."""
    net = Network.fresh(x, seed)
    x = net.scaled(x)
    share = np.average(y, weights=weight)
    net.weights["c0"][0] = np.log(share / (1 - share))
    first = np.cumsum(sizes) - sizes
    rng, losses = np.random.default_rng(seed), []
    total = epochs * -(-len(sizes) // bags)
    for _ in range(epochs):
        seen = []
        for chosen in np.array_split(rng.permutation(len(sizes)), -(-len(sizes) // bags)):
            rows = np.repeat(first[chosen] - (np.cumsum(sizes[chosen]) - sizes[chosen]), sizes[chosen]) + np.arange(sizes[chosen].sum())
            loss, gradients = net.gradients(x[rows], sizes[chosen], y[chosen], weight[chosen])
            net.step(gradients, rate * (1 - net.steps / (total + 1)), decay)
            seen.append(loss)
        losses.append(float(np.mean(seen)))
    net.moments.clear()
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    return net, losses


def fit(docs: DataFrame, labels: DataFrame, max_each: int = MAX_EACH, max_bytes: int = MAX_BYTES,
        max_passages: int = MAX_PASSAGES, **training) -> Model:
    """Fit on a bounded sample of the labelled documents."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
             .dropna().filter("quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality")))
    totals = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    base = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 1)
    order = md5_long(F.lit("quality"), F.col("doc_id").cast("string"))
    ids = [known.filter(F.col("quality") == q).orderBy(order, "doc_id").limit(max_each) for q in (0, 1)]
    chosen = [(r["doc_id"], r["quality"]) for r in ids[0].union(ids[1]).collect()]  # bounded by the parameter
    if len({q for _, q in chosen}) < 2:
        return Model(None, base)
    small = docs.sparkSession.createDataFrame(chosen, "doc_id long, quality int")
    picked = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
              .filter(F.octet_length("text") <= max_bytes)
              .join(F.broadcast(small), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(2).to_pylist()
            for i, j in runs(texts, passages.RUN_CHARS):
                x, sizes, _ = passages.encode(texts[i:j])
                x = x.astype(np.float16)
                ends = np.cumsum(sizes)
                bags = [(x[e - n:e] if n else np.zeros((1, x.shape[1]), x.dtype)) for e, n in zip(ends, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array([len(g) for g in bags], pa.int64()),
                     pa.array([g.tobytes() for g in bags], pa.binary())], names=["doc_id", "quality", "n", "x"])

    stored = cut(picked.mapInArrow(features, "doc_id long, quality int, n long, x binary"), "quality-bags")
    sizes = {r["doc_id"]: r["n"] for r in stored.select("doc_id", "n").collect()}  # at most 2 * max_each rows
    # documents of both labels in turn, while their passages fit
    turns = sorted((n, q, d) for q in (0, 1) for n, d in enumerate(d for d, of in chosen if of == q))
    taken, left = [], max_passages
    for _, _, d in turns:
        if d in sizes and sizes[d] <= left:
            taken.append((d,))
            left -= sizes[d]
    if not taken:
        return Model(None, base)
    bags = (stored.join(F.broadcast(docs.sparkSession.createDataFrame(taken, "doc_id long")), "doc_id")
            .orderBy("doc_id").toArrow())  # bounded by max_passages
    y = bags["quality"].to_numpy().astype(np.float32)
    if len(set(y.tolist())) < 2:
        return Model(None, base)
    n = bags["n"].to_numpy()
    x = np.concatenate([np.frombuffer(b.as_buffer(), np.float16).reshape(-1, passages.FEATURES).astype(np.float32)
                        for b in bags["x"]])
    weight = np.where(y == 1, totals[1] / y.sum(), totals[0] / (1 - y).sum())
    network, losses = train(x, n, y, weight, **training)
    return Model(network, base, losses)


def score(docs: DataFrame, model: Model, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """``doc`` (struct of the ``keep`` columns), score and predicted of every document, from its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: the network's weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            chance = np.array(shared.value.scores(b.column(1).to_pylist()), np.float64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(chance), pa.array((chance >= threshold).astype(np.int32))],
                names=["doc", "score", "predicted"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType([
        T.StructField("doc", rows.schema["doc"].dataType), T.StructField("score", T.DoubleType()),
        T.StructField("predicted", T.IntegerType())]))
