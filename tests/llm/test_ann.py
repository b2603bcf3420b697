"""Nearest vectors against brute force in double precision."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from caremart.llm import ann
from caremart.llm.common import table

KIND = "vec_id long, embedding array<float>, score string"


def brute(rows, every, k):
    clean = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            clean[i] = min(clean.get(i, v), v)
    out = {}
    for q in sorted(i for i in clean if i % every == 0):
        a = np.array(clean[q], np.float64)
        near = []
        for i, v in clean.items():
            if i != q and len(v) == len(a):
                b = np.array(v, np.float64)
                near.append((-float(a @ b) / np.sqrt(float(a @ a) * float(b @ b)), i))
        # scores that differ by rounding alone count as equal
        out[q] = sorted(near, key=lambda t: (round(t[0], 12), t[1]))[:k]
    return out


def check(df, rows, every, k):
    want, got = brute(rows, every, k), {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {q for q, v in want.items() if v}
    for q, found in got.items():
        assert [r for r, *_ in found] == list(range(1, len(want[q]) + 1))
        assert [i for _, i, _ in found] == [i for _, i in want[q]]
        assert np.allclose([s for *_, s in found], [-s for s, _ in want[q]], atol=1e-12)


def test_awkward_vectors(spark):
    f = float
    rows = [(0, [1.0, 2.0]), (1, [2.0, 4.0]), (2, [2.0, 4.0]), (3, None), (4, [0.0, 0.0]), (5, [f("nan"), 1.0]),
            (6, [f("inf"), 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (None, [1.0, 2.0]), (10, [-1.0, -2.0]),
            (12, [1.0, 2.0]), (12, [1.0, 2.0]), (20, [3e38, 1e-30]), (21, [1e-38, 3e-38]), (-10, [2.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], KIND)
    rows32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    check(ann.nearest(df, F.col("vec_id") % 10 == 0, 5), rows32, 10, 5)
    assert ann.nearest(df.limit(0), F.col("vec_id") % 10 == 0, 5).count() == 0


@pytest.mark.parametrize("tile", [3, 16, 1000])
def test_ties_and_near_ties(spark, tile):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 8))
    rows = [(i, [float(np.float32(x)) for x in base[i % 6] + (rng.normal(size=8) * 1e-3 if i % 2 else 0)]) for i in range(120)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], KIND)
    check(ann.nearest(df, F.col("vec_id") % 10 == 0, 5, tile_rows=tile), rows, 10, 5)


@pytest.mark.parametrize("tile", [4, 1000])
def test_every_vector_of_an_id_counts(spark, tile):
    rng = np.random.default_rng(8)
    rows = [(i % 25, [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(100)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], KIND)
    want = {}
    for i, v in rows:
        for j, w in rows:
            if i % 10 == 0 and i != j:
                a, b = np.array(v), np.array(w)
                want.setdefault(i, {}).setdefault(j, []).append(float(a @ b) / np.sqrt(float(a @ a) * float(b @ b)))
    got = ann.nearest(df, F.col("vec_id") % 10 == 0, 5, tile_rows=tile).orderBy("query_id", "rank").collect()
    assert len(got) == 5 * len(want)
    for q, near in want.items():
        best = sorted(((-max(s), j) for j, s in near.items()))[:5]
        own = [r for r in got if r["query_id"] == q]
        assert [(r["rank"], r["vec_id"]) for r in own] == [(n + 1, j) for n, (_, j) in enumerate(best)]
        assert np.allclose([r["score"] for r in own], [-s for s, _ in best], atol=1e-12)


def test_query_equals_brute_force(spark, small):
    from caremart.llm.queries import op2_nearest

    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, small, "embeddings").collect()]
    check(op2_nearest(spark, small), rows, 50, 5)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    import pandas as pd

    for scale in (1e-3, 1, 1e6):
        x = pd.Series(list((rng.normal(size=(50, 32)) ** 3 * scale).tolist()))
        v, n, q, s, e = ann._unit(x)
        u = v / n[:, None]
        near = (q @ q.T) * s[:, None] * s[None, :]
        bound = (1 + e[:, None]) * e[None, :] + e[:, None] + ann.SLACK
        assert (np.abs(near - u @ u.T) <= bound).all()
