"""Passages against plain Python, the network against numeric gradients and a loop, scores on held-out labels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from caremart.llm import passages, quality_mil
from caremart.llm.common import table
from caremart.llm.toxicity import held_out

KIND = "doc_id long, text string, score string, label int, doc string"
PLAIN = "The quick brown fox. " * 40


def split(text):
    """Passages as lists of words, by plain Python."""
    words = text.split()
    return [words[i:i + passages.WORDS] for i in range(0, len(words), passages.WORDS)]


TEXTS = ["", " \n\t ", "one", "  lead Zoë 中文 12 !? " * 30, PLAIN, "a\nb\r\nc " * 100, "word " * 48, "x" * 5000 + " y", "Éa b \U0001F600 ok"]


def test_passages_equal_plain_python():
    x, sizes, _ = passages.encode(TEXTS)
    want = [split(t) for t in TEXTS]
    assert sizes.tolist() == [len(w) for w in want]
    first = passages.CLASSES + passages.SHAPES + passages.HASHED
    for got, words in zip(x, [w for ws in want for w in ws], strict=True):
        assert got[:passages.CLASSES].sum() == pytest.approx(1, abs=1e-5)
        assert got[first] == pytest.approx(len(words) / passages.WORDS)
        assert got[first + 1] == pytest.approx(min(50, np.mean([len(w) for w in words])) / 10, rel=1e-4)
        assert got[first + 3] == pytest.approx(len({w.lower() for w in words}) / len(words), rel=1e-4)
        again = sum(a.lower() == b.lower() for a, b in zip(words, words[1:], strict=False))
        assert got[first + 4] == pytest.approx(again / len(words), rel=1e-4)
        assert got[first + 5] == pytest.approx(sum(w[-1] in ".!?" for w in words) / len(words), rel=1e-4)
        assert got[first + 6] == pytest.approx(sum(w[0].isupper() for w in words) / len(words), rel=1e-4)


def test_a_text_is_the_same_alone_among_others_and_in_pieces():
    x, sizes, _ = passages.encode(TEXTS)
    ends = np.cumsum(sizes)
    for t, e, n in zip(TEXTS, ends, sizes, strict=True):
        assert np.array_equal(passages.encode([t])[0], x[e - n:e])
        for limit in (7, 100, 1000):
            found = list(passages.pieces(t, limit))
            assert np.array_equal(np.concatenate(found) if found else x[:0], x[e - n:e])


def small_network(dtype=np.float64):
    rng = np.random.default_rng(0)
    x, sizes = rng.normal(size=(23, 6)), np.array([1, 4, 7, 2, 9])
    net = quality_mil.Network.fresh(x, 1, hidden=5, gates=3)
    net.weights = {k: (v + rng.normal(size=v.shape) * 0.3).astype(dtype) for k, v in net.weights.items()}
    return net, x, sizes


def test_gradients():
    net, x, sizes = small_network()
    y, weight = np.array([0.0, 1, 1, 0, 1]), np.array([1.0, 2, 0.5, 3, 1])
    x = net.scaled(x)
    _, gradients = net.gradients(x, sizes, y, weight)
    for k, g in gradients.items():
        for at in np.ndindex(g.shape):
            w, loss = net.weights[k], []
            for move in (1e-6, -2e-6):
                w[at] += move
                loss.append(net.gradients(x, sizes, y, weight)[0])
            w[at] += 1e-6
            assert (loss[0] - loss[1]) / 2e-6 == pytest.approx(g[at], abs=1e-6)


def by_loop(net, x):
    """Score of one bag, one passage at a time."""
    p, x = {k: v.astype(float) for k, v in net.weights.items()}, net.scaled(x).astype(float)
    hs, es = [], []
    for row in x:
        h = np.tanh(row @ p["W"] + p["b"])
        hs.append(h)
        es.append(float((np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"]))
    total = sum(math.exp(e - max(es)) for e in es)
    z = sum(math.exp(e - max(es)) / total * h for e, h in zip(es, hs, strict=True))
    return 1 / (1 + math.exp(-float(z @ p["c"] + p["c0"][0])))


def test_scores_equal_the_loop_whole_and_in_pieces():
    net, x, sizes = small_network()
    want, e = [], 0
    for n in sizes:
        bag = x[e:e + n]
        want.append(by_loop(net, bag))
        assert net.chance(iter([bag])) == pytest.approx(want[-1], abs=1e-9)
        assert net.chance(bag[i:i + 2] for i in range(0, n, 2)) == pytest.approx(want[-1], abs=1e-9)
        e += n
    assert np.allclose(net.chances(x, sizes), want, atol=1e-9)


JUNK = "&&& thing### of%%% " * 30


def corpus(spark, n=60):
    docs = [(i, (PLAIN + str(i)) if i % 3 else JUNK + str(i), "x", 1, "y") for i in range(n)]
    docs += [(100, None, "x", 1, "y"), (101, "", "x", 1, "y"), (102, PLAIN * 3000, "x", 1, "y"), (103, JUNK * 5000, "x", 1, "y"),
             (None, PLAIN, "x", 1, "y"), (5, PLAIN + "5", "x", 1, "y"), (5, PLAIN + "5", "x", 1, "y"), (104, " \n ", "x", 1, "y")]
    labels = [(i, int(i % 3 > 0), 0) for i in range(n)] + [(None, 1, 0), (7, None, 0), (8, 1, 0), (100, 1, 0), (999, 0, 0), (4, 3, 0)]
    return spark.createDataFrame(docs, KIND), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_awkward_rows(spark):
    docs, labels = corpus(spark)
    model = quality_mil.fit(docs, labels, epochs=12)
    rows = quality_mil.score(docs, model, ["doc_id", "score", "doc"]).collect()
    assert len(rows) == docs.count()
    got = {}
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert got.setdefault(r["doc"]["doc_id"], r["score"]) == r["score"]
    assert got[100] == got[101] == got[104]
    assert all((got[i] >= 0.7) == (i % 3 > 0) for i in range(60)) and got[102] >= 0.7 > got[103]
    again = quality_mil.fit(docs, labels, epochs=12)
    assert all(np.array_equal(again.network.weights[k], v) for k, v in model.network.weights.items())
    # a bound of one passage still fits or falls back, and never fails
    assert quality_mil.fit(docs, labels, max_passages=1, epochs=1).network is None
    assert quality_mil.fit(docs, labels, max_each=3, max_bytes=2000, epochs=1).network is not None


def test_one_label_or_none(spark):
    docs, labels = corpus(spark, 12)
    ones = quality_mil.fit(docs, labels.filter("quality = 1"))
    assert ones.network is None and ones.base > 0.9
    none = quality_mil.fit(docs, labels.limit(0))
    assert none.base == 0.5
    assert {r["score"] for r in quality_mil.score(docs, none, ["doc_id"]).collect()} == {0.5}
    assert quality_mil.score(docs.limit(0), ones, ["doc_id"]).collect() == []


def test_query_on_held_out_labels_and_by_loop(spark):
    path = "/root/testdata/sf0.01"
    docs, labels = table(spark, path, "documents"), table(spark, path, "labels")
    model = quality_mil.fit(docs, labels.filter(~held_out()))
    rows = (quality_mil.score(docs, model, ["doc_id"]).select("doc.doc_id", "score", "predicted")
            .join(docs.select("doc_id", "text"), "doc_id").withColumn("held", held_out()).join(labels, "doc_id", "left").collect())
    assert len(rows) == docs.count()
    for r in rows[::7]:
        x = passages.encode([r["text"] or ""])[0]
        want = by_loop(model.network, x if len(x) else np.zeros((1, passages.FEATURES), np.float32))
        assert r["score"] == pytest.approx(want, abs=1e-4)
    held = [r for r in rows if r["held"] and r["quality"] is not None]
    bad = [r for r in held if r["quality"] == 0]
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.94 * len(held)
    assert sum(r["predicted"] == 0 for r in bad) >= 0.85 * len(bad)
    assert model.losses[-1] < 0.5 * model.losses[0]


def test_query_columns(spark, small):
    from caremart.llm.queries import op11_quality

    got = op11_quality(spark, small)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert [t for _, t in got.dtypes] == ["bigint", "boolean", "double", "int"]
    assert got.count() == table(spark, small, "documents").count() and got.filter(F.isnull("score")).count() == 0
