"""Decontamination against brute force over words."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caremart.llm import decontaminate as D
from caremart.llm.common import table
from caremart.llm.shingles import words

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower)


def brute(docs, items, window):
    out = []
    pieces = []
    for item, text in items:
        ws = plain_words(text)
        k = min(window, len(ws))
        pieces += [("" if item is None else str(item), tuple(ws[i:i + k])) for i in range(len(ws) - k + 1)] if k else []
    for doc_id, text in docs:
        ws = plain_words(text)
        hit, found = set(), set()
        for item, p in pieces:
            for i in range(len(ws) - len(p) + 1):
                if tuple(ws[i:i + len(p)]) == p:
                    hit.update(range(i, i + len(p)))
                    found.add(item)
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(ws), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(ws)))
    return sorted(out, key=str)


def run(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS items", "1 AS n_hit").repartition(2)
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "2 AS item")
    found = D.mark(d, b, ["doc_id", "items", "n_hit"], **options)
    rows = found.select("doc.doc_id", "n_words", "n_hit", F.size("items").alias("n"), D.items_digest(F.col("items")), "contaminated")
    return sorted((tuple(r) for r in rows.collect()), key=str)


ITEMS = [(1, "the quick brown fox jumps over the lazy dog"), (2, "Fox, jumps!"), (3, "one"), (4, None), (5, "..."),
         (2, "quick brown"), (10, "élan vital über alles 7"), (None, "lazy dog")]
DOCS = [(1, "The QUICK brown-fox jumps over the lazy dog; one."), (2, None), (3, ""), (4, "..."), (5, "nothing here at all"),
        (6, "one " * 50 + "x" * 20), (7, "the the the quick brown quick brown fox jumps fox jumps"), (7, "dup id"), (7, "dup id"),
        (None, "ÉLAN élan vital über alles 7 Élan"), (8, "w " * 3000 + "fox jumps " + "w " * 3000)]


@pytest.mark.parametrize("options", [{}, {"window": 3}, {"window": 2, "shard_words": 5}, {"window": 3, "part_words": 4}])
def test_awkward_rows(spark, options):
    assert run(spark, DOCS, ITEMS, **options) == brute(DOCS, ITEMS, options.get("window", 13))


def test_empty_tables(spark):
    assert run(spark, DOCS[:3], []) == brute(DOCS[:3], [], 13)
    assert run(spark, [], ITEMS) == []


def test_cut_text(spark):
    d = spark.createDataFrame([(1, "Say: the Quick brown fox, please."), (2, None)], "doc_id long, text string")
    b = spark.createDataFrame([(1, "quick BROWN fox")], "item_id long, text string")
    got = {r["doc"]["doc_id"]: r["clean_text"] for r in D.mark(d, b, ["doc_id"], cut_text=True).collect()}
    assert got == {1: "Say: the , please.", 2: None}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=30), min_size=1, max_size=6),
       st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=7), min_size=1, max_size=5), st.integers(1, 5))
def test_index_finds_what_a_scan_finds(docs, items, window):
    name = "zabcde"
    texts = [" ".join(name[w] for w in d) for d in docs]
    pairs = [(str(i), " ".join(name[w] for w in x)) for i, x in enumerate(items)]
    phrases = D.Phrases(pairs, window)
    got = phrases.find([np.array([phrases.number.get(w, 0) for w in words(t)], np.int64) for t in texts])
    for (spans, names), want in zip(got, [brute([(0, t)], pairs, window)[0] for t in texts], strict=True):
        assert sum(b - a for a, b in spans) == want[2] and len(names) == want[3]
        assert all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_suffix_order_and_ranks():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, 300)
    x[-1] = 0
    order = D.suffix_order(x)
    zero = iter(range(300))
    named = [(0, next(zero)) if c == 0 else (1, int(c)) for c in x]
    assert order.tolist() == sorted(range(300), key=lambda i: named[i:])
    w = D.Wavelet(x)
    place = np.arange(301)
    for c in range(4):
        assert w.rank(np.full(301, c), place).tolist() == np.concatenate([[0], np.cumsum(x == c)]).tolist()
    assert w.access(np.arange(300)).tolist() == x.tolist()


def test_query_equals_brute_force(spark, small):
    from caremart.llm.queries import op10_decontamination

    docs = [(r["doc_id"], r["text"]) for r in table(spark, small, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, small, "benchmark").collect()]
    got = sorted((tuple(r) for r in op10_decontamination(spark, small).collect()), key=str)
    assert got == brute(docs, items, 13) and any(r[-1] for r in got)
