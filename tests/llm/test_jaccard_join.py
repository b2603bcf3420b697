"""The Jaccard join against all pairs by brute force, and its parts."""

import random

import numpy as np
import pytest

from caremart.llm import jaccard_join as J
from caremart.llm.common import table
from caremart.llm.components import components
from caremart.llm.shingles import words

DOCS = "doc_id long, text string"


def shingles(text):
    ws = words(text)
    k = min(5, len(ws))
    return frozenset(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1)) if k else frozenset()


def brute(rows, threshold=0.8):
    sets = [shingles(t) if i is not None else frozenset() for i, t in rows]
    near = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j]
             and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])] for i in range(len(rows))]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, js in enumerate(near):
            low = min([label[i], *(label[j] for j in js)])
            for x in (i, *js):
                changed |= label[x] != low
                label[x] = min(label[x], low)
    members = {}
    for i, c in enumerate(label):
        members.setdefault(c, []).append(rows[i][0])
    return sorted(((rows[i][0], min(members[c]) if rows[i][0] is not None else None, len(near[i]),
                    sum(s == sets[i] for s in sets) if sets[i] else 1) for i, c in enumerate(label)), key=str)


def variants(seed, groups, size, length=60):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(300)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(length)]
        for c in range(size):
            own = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 4))):
                own[rng.randrange(length)] = rng.choice(vocabulary)
            rows.append(" ".join(own))
    rng.shuffle(rows)
    return list(enumerate(rows))


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' AS node", "1 AS sign", "2 AS n_same").repartition(3)
    return sorted((tuple(r) for r in J.link(df, **options).collect()), key=str)


def test_awkward_rows(spark):
    long = " ".join("t%d" % (i * i % 997) for i in range(20_000))
    rows = [(1, None), (2, ""), (3, "..."), (4, "one two"), (5, "One, TWO."), (6, "one two three"), (7, "a b c d e"), (8, "a b c d e"),
            (8, "a b c d e"), (None, "a b c d e"), (9, long), (10, long + " more"), (11, "a b c d e f g h i j k l m n o p q r s t u v"),
            (12, "a b c d e f g h i j k l m n o p q r s t u w"), (12, "quite another text that is not near")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_groups_of_near_copies(spark):
    rows = variants(7, 25, 12)
    assert run(spark, rows) == brute(rows)


def test_large_buckets_go_through_blocks_and_tiles(spark):
    rows = variants(11, 2, 120)
    assert run(spark, rows, bucket=16, tile_rows=24, deepest=3) == brute(rows)


@pytest.mark.parametrize("tile_bytes", [40, 500])
def test_links_are_counted_once_when_tiles_lack_a_block(spark, tile_bytes):
    """Texts far above a tile's bytes: most blocks of a component are empty."""
    rows = variants(5, 6, 2, length=200) + variants(6, 2, 3, length=150)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    rows += [(0, "quite another text that is near to none"), (3, rows[5][1])]  # ids given to several texts
    assert run(spark, rows, tile_bytes=tile_bytes) == brute(rows)


def test_exact_pairs_across_blocks_only():
    sets, block = [np.arange(50, dtype=np.uint64)] * 3, np.zeros(3, int)
    assert [len(j) for _, j in J.exact_pairs(sets, block, 0.8, False)] == [2, 1]
    assert not any(len(j) for _, j in J.exact_pairs(sets, block, 0.8, True))


def test_deduplicate_keeps_one_of_each_class(spark):
    rows = variants(3, 10, 6) + [(1000, None), (1001, ""), (1002, "only here once a b c"), (1002, "only here once a b c")]
    df = spark.createDataFrame([(*r, "x", i) for i, r in enumerate(rows)], DOCS + ", lang string, n long")
    kept = J.deduplicate(df)
    assert kept.columns == df.columns
    want = sorted({r[1] for r in brute(rows)})
    assert sorted(r["doc_id"] for r in kept.collect()) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 100), (7, 7), (None, 3), (200, 210), (-5, 210)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 99: 99, 100: 99, 200: -5, 210: -5, -5: -5}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_pairs_and_recall():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(40)]
    for blocks in (np.zeros(40, int), np.arange(40) % 2):
        got = {(i, int(j)) for i, js in J.exact_pairs(sets, blocks, 0.4) for j in js}
        want = {(i, j) for i in range(40) for j in range(i + 1, 40) if (len(set(blocks)) == 1 or blocks[i] != blocks[j])
                and len(np.intersect1d(sets[i], sets[j])) >= 0.4 * len(np.union1d(sets[i], sets[j])) - 1e-9}
        assert got == want
    # measured chance to share a path in all runs, for signatures that agree in 80 % of positions
    roots = J._keys(J.runs_needed())
    met = 0
    for _ in range(400):
        a = rng.integers(0, 2**32, J.POSITIONS, dtype=np.uint32)
        b = np.where(rng.random(J.POSITIONS) < 0.8, a, a + np.uint32(1)).astype(np.uint32)
        path, which = np.repeat(roots, 2), np.tile([0, 1], len(roots))
        for _ in range(J.MAX_DEPTH):
            path, which = J.descend(path, which, np.stack([a, b]), J.SIMILARITY)
        met += bool(set(path[which == 0].tolist()) & set(path[which == 1].tolist()))
    assert met >= 0.985 * 400


def test_query_equals_brute_force(spark, small):
    from caremart.llm.queries import op8_jaccard_join

    rows = [(r["doc_id"], r["text"]) for r in table(spark, small, "documents").collect()]
    got = sorted((tuple(r) for r in op8_jaccard_join(spark, small).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("text, n", [("a b c", 1), ("a b c d e f", 2), ("", 0)])
def test_shingles(text, n):
    assert len(J.shingle_set(text, 5)) == n
