"""Hard negatives against brute force in whole numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from caremart.llm import hard_negatives as hn
from caremart.llm.common import table

KIND = "vec_id long, embedding array<float>, label int, score string, mark int"


def whole(v):
    limit = min(2**31 - 1, math.floor(math.sqrt(float(2**63 - 1) / max(1, len(v)))) - 1)
    return tuple(math.floor(max(-limit, min(limit, 256.0 * x))) for x in v)


def brute(rows, every, positives, negatives):
    clean = set()
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            clean.add((i, (label + 1) % 10 if i % 7 == 0 else label, whole(v)))
    out = []
    for a in sorted(clean):
        if a[0] % every:
            continue
        scored = [(-sum(x * y for x, y in zip(a[2], r[2], strict=True)), r[0], r[1]) for r in clean
                  if r != a and len(r[2]) == len(a[2])]
        for p in sorted(s for s in scored if s[2] == a[1])[:positives]:
            near = sorted(s for s in scored if s[2] != a[1] and 30 * -p[0] <= 100 * -s[0] <= 90 * -p[0])[:negatives]
            out += [(a[0], p[1], n + 1, s[1], -p[0], -s[0]) for n, s in enumerate(near)]
    return sorted(out)


def mined(df, every=10, positives=5, negatives=10, **more):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hn.mine(df, F.col("vec_id") % every == 0, label, positives, negatives, **more).collect()
    return sorted(tuple(r) for r in rows)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", 1) for i, v, y in rows], KIND)


def test_residues_are_exact():
    rng = np.random.default_rng(2)
    for dim, top in ((1, 2**31 - 1), (3, 1000), (64, 300), (64, 370_000_000), (200, 50_000_000), (1000, 5)):
        a, b = (rng.integers(-top, top + 1, (7, dim)) for _ in range(2))
        a[0], b[0], b[1] = top, top, -top
        bound = max(int(sum(int(x) ** 2 for x in r)) for r in [*a, *b])
        primes = hn.moduli(bound)
        assert hn.CHUNK * (max(primes) // 2) ** 2 < 2**24
        got = hn.Residues(a, primes).product(hn.Residues(b, primes), 0, 7)
        assert got.tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]


@pytest.mark.parametrize("block", [None, 4])
def test_awkward_vectors(spark, block):
    f = float
    rows = [(0, [1.0, 2.0], 1), (1, [2.0, 4.0], 2), (2, [2.0, 4.0], 2), (3, None, 1), (4, [0.0, 0.0], 3), (5, [f("nan"), 1.0], 1),
            (6, [f("-inf"), 1.0], 1), (8, [None, 1.0], 1), (9, [], 2), (10, [], 2), (11, [], 4), (None, [1.0, 2.0], 2),
            (12, [-1.0, -2.0], 2), (13, [1.0, 1.0], None), (15, [1.0, 0.5], 2), (15, [0.5, 0.5], 2), (20, [1.0, 1.0], 2),
            (20, [1.0, 1.0], 2), (20, [0.3, 1.0], 2), (30, [1e30, -1e30], 2), (31, [1e-30, 1.0], 5), (40, [0.0, 0.0], 3),
            (41, [0.0, 0.0], 7), (70, [1.0, 1.5, 2.0], 8), (71, [1.0, 1.5, 2.0], 9), (72, [0.5, 0.75, 1.0], 3)]
    rows32 = [(i, None if v is None else [None if x is None else f(np.float32(x)) for x in v], y) for i, v, y in rows]
    got = mined(frame(spark, rows), block_rows=block)
    assert got == brute(rows32, 10, 5, 10)
    assert any(r[0] == 10 for r in got) and any(r[0] == 70 for r in got)


@pytest.mark.parametrize("block", [7, None])
def test_ties_and_one_label_of_a_third(spark, block):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 8)).astype(np.float32)
    rows = [(i, [float(x) for x in base[i % 12] * np.float32(0.5 + (i % 3))], 1 if i % 3 else int(rng.integers(10))) for i in range(150)]
    got = mined(frame(spark, rows), positives=3, negatives=4, block_rows=block)
    assert got == brute(rows, 10, 3, 4) and len(got) > 50


def test_empty(spark):
    assert mined(frame(spark, []).limit(0)) == []
    assert mined(frame(spark, [(0, [1.0], 1)])) == []


def test_query_equals_brute_force(spark, small):
    from caremart.llm.queries import op12_hard_negatives

    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table(spark, small, "embeddings").collect()]
    got = sorted(tuple(r) for r in op12_hard_negatives(spark, small).collect())
    assert got == brute(rows, 100, 5, 10) and got
