"""Mixing and sharding against plain Python and SQL."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caremart.llm import mixing, queries, sharding
from caremart.llm.common import table

KIND = "doc_id long, text string, source string, target string, size int, bucket string"


def fill(sizes, weights=(1, 2, 3), most=3):
    """Targets by literally sharing the excess again until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > most * sizes[s]]
        if not full:
            return out | share
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
            open_.discard(s)
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, "t", 1, "b") for r in rows], KIND).repartition(3)
    return mixing.mix(df, ["doc_id", "target"]).collect()


def check(rows, got):
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = fill(dict(sizes))
    taken, largest = defaultdict(int), defaultdict(int)
    source = {}
    for i, t, s in rows:
        source.setdefault(i, s)
    for r in got:
        s = source[r["doc"]["doc_id"]]
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], want[s], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] and len(r["positions"]) == r["copies"]
        assert r["positions"] == sorted(r["positions"]) and all(0 <= p <= 1 for p in r["positions"])
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6, s


def test_awkward_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y z", "a"), (4, "x " * 5000, "a"), (5, "q", None), (6, "p q r", None), (7, "", "zero"),
            (8, "a b\tc\nd\x0be\x0cf", "é"), (9, "nb sp x", "Z"), (10, "one two", "b"), (10, "one two", "b"), (11, "u v w", "")]
    got = run(spark, rows)
    assert len(got) == len(rows)
    check(rows, got)
    assert run(spark, []) == []
    assert [r["target"] for r in run(spark, [(1, None, "a")])] == [0.0]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.sampled_from(["a", "b", "c", None, "dd"])), min_size=1, max_size=30))
def test_targets_are_met(spark, sizes):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate(sizes)]
    check(rows, run(spark, rows))


def test_curriculum(spark):
    rows = [(i, "w w w", "abc"[i % 3]) for i in range(600)]
    df = spark.createDataFrame([(*r, "t", 1, "b") for r in rows], KIND)
    mixed = mixing.mix(df, ["doc_id", "source"], weights=(1, 1, 1))
    placed = mixing.training_order(mixed).collect()
    assert [r["position"] for r in placed] == sorted(r["position"] for r in placed) and len(placed) == 600
    early = Counter(r["doc"]["source"] for r in placed[:150])
    assert early["b"] > early["a"] > early["c"]  # its weight falls, stays, rises
    assert sorted(map(tuple, mixed.select("doc.doc_id", "copies").collect())) == sorted(
        map(tuple, mixing.mix(df, ["doc_id"], weights=(1, 1, 1)).select("doc.doc_id", "copies").collect()))


@pytest.mark.parametrize("bucket_rows", [3, 100_000])
def test_ranks_are_the_training_order(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    rows = [(i, "w " * (i % 7), "ab"[i % 5 == 0]) for i in range(200)] + [(7, "", "a"), (7, "", "a"), (None, "x", None), (300, None, "zero")]
    df = spark.createDataFrame([(*r, "t", 1, "b") for r in rows], KIND).repartition(5)
    got = mixing.ranked(mixing.mix(df, ["doc_id", "bucket"])).collect()
    assert len(got) == len(rows) and all(r["copies"] == len(r["positions"]) == len(r["ranks"]) for r in got)
    copies = sorted(((rank, p) for r in got for rank, p in zip(r["ranks"], r["positions"], strict=True)))
    assert [rank for rank, _ in copies] == list(range(len(copies))) and len(copies) > 100
    assert [p for _, p in copies] == sorted(p for _, p in copies)
    check(rows, got)
    assert mixing.ranked(mixing.mix(df.limit(0), ["doc_id"])).collect() == []


def time_by_steps(share, start, stop, steps=200_000):
    """Where the integral of the schedule reaches its share, by adding it up."""
    total, at = (start + stop) / 2, 0.0
    for i in range(steps):
        at += (start + (stop - start) * (i + 0.5) / steps) / steps
        if at >= share * total:
            return (i + 1) / steps
    return 1.0


def test_positions_invert_the_schedule(spark):
    rows = [(i, "w w w w", "abc"[i % 3]) for i in range(30)]
    df = spark.createDataFrame([(*r, "t", 1, "b") for r in rows], KIND)
    got = sorted(mixing.mix(df, ["doc_id", "source"], weights=(1, 1, 1)).collect(), key=lambda r: r["positions"][0])
    for source, (start, stop) in zip("abc", mixing.SCHEDULES, strict=True):
        mine = [r["positions"][0] for r in got if r["doc"]["source"] == source]
        assert len(mine) == 10
        for n, p in enumerate(mine):
            assert p == pytest.approx(time_by_steps((4 * n + 2) / 40, start, stop), abs=1e-4)


def test_no_python_in_native_plans(spark, small):
    for name in ("op7_sharding", "op9_mixing"):
        plan = queries.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, small, duck, name):
    df = queries.queries()[name](spark, small)
    cur = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(cur.fetchall())


def test_lookup_table():
    names = [f"s{i}" for i in range(10)]
    size = sharding.table_size(10)
    assert size == 1009 and all(size % d for d in range(2, size))
    a = sharding.lookup_table(names, size)
    assert max(Counter(a).values()) - min(Counter(a).values()) <= 1
    b = sharding.lookup_table(names[:-1], size)
    moved = sum(x != y for x, y in zip(a, b, strict=True) if x != 9)
    assert moved < 0.15 * size  # few others than the removed shard's
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 7)


def test_place(spark):
    rows = [(1, "a", "old"), (None, "b", "old"), (1, "c", "old")]
    df = spark.createDataFrame(rows, "doc_id long, slot string, shard string")
    placed = sharding.place(df, names=["x", "y"])
    assert placed.columns == ["doc_id", "slot", "shard"] and placed.count() == 3
    got = {r["slot"]: r["shard"] for r in placed.collect()}
    size = sharding.table_size(2)
    table_ = sharding.lookup_table(["x", "y"], size)
    for key, slot in (("1", "a"), ("", "b"), ("1", "c")):
        at = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % size
        assert got[slot] == "xy"[table_[at]]
    assert sharding.place(df.limit(0)).count() == 0


def test_shards_are_even(spark, small):
    n = table(spark, small, "documents").count()
    counts = Counter(r["shard"] for r in queries.op7_sharding(spark, small).collect())
    assert sum(counts.values()) == n and max(counts.values()) <= 6 * n / sharding.SHARDS + 6
