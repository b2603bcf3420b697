"""Token files: exact ids against the library, round trips, pruning, block boundaries."""

import functools
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caremart.llm import encoding, token_counts, token_orc
from caremart.llm.common import scratch, table

AWKWARD = [None, "", " ", "\n\n", "Hello, world.", "it's  o'clock", "a,b ,c..d", "İstanbul ΟΔΟΣ", "<|endoftext|> x <|ENDOFTEXT|>",
           "tab\tsep nbsp em", "é ́x", "x" * 3000, "word " * 5000, "1234 5,6!?", "***bold***, (see) \"q\"."]
DOCS = "doc_id long, text string"


@functools.cache
def library(vocabulary):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


def plain(vocabulary, text):
    return library(vocabulary).encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library(vocabulary):
    enc = encoding.ChunkEncoder(vocabulary, max_cached=20)  # forgets all the time
    for _ in range(2):
        ids, n = enc.encode([t or "" for t in AWKWARD])
        parts = np.split(ids, np.cumsum(n)[:-1])
        for t, p in zip(AWKWARD, parts, strict=True):
            assert p.tolist() == plain(vocabulary, t), t


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n.,'sS<|>aÉ")), max_size=40), min_size=1, max_size=4))
def test_encoder_equals_library_on_any_text(texts):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    enc = encoding.encoder(str(path))
    ids, n = enc.encode(texts)
    for t, p in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert p.tolist() == plain(str(path), t)


def expected(vocabulary, rows):
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*plain(vocabulary, text), 1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_orc_round_trip(spark, vocabulary):
    rows = [(i * 7, t) for i, t in enumerate(AWKWARD)]
    path = scratch(spark, "t")
    token_orc.write(spark.createDataFrame(rows[::-1], DOCS).selectExpr("*", "1 AS ids", "2 AS part"), path, vocabulary)
    got = [tuple(r) for r in token_orc.digest(spark, path).orderBy("doc_id").collect()]
    assert got == expected(vocabulary, rows)
    found = token_orc.find(spark, path, [28]).collect()
    assert found[0]["ids"] == [*plain(vocabulary, AWKWARD[4]), 1]
    plan = token_orc.find(spark, path, [28])._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,28)]" in plan.split("PushedFilters")[-1]


def test_orc_ties_nulls_and_empty(spark, vocabulary):
    path = scratch(spark, "t")
    token_orc.write(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (1, None)], DOCS), path, vocabulary)
    got = token_orc.digest(spark, path).orderBy("start").collect()
    assert got[0]["doc_id"] is None and [r["doc_id"] for r in got[1:]] == [1, 1, 1]
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    path = scratch(spark, "t")
    token_orc.write(spark.createDataFrame([], DOCS), path, vocabulary)
    assert token_orc.digest(spark, path).count() == 0


def test_orc_query_equals_library(spark, small, vocabulary):
    from caremart.llm.queries import op1_token_orc

    rows = [(r["doc_id"], r["text"]) for r in table(spark, small, "documents").orderBy("doc_id").collect()]
    got = [tuple(r) for r in op1_token_orc(spark, small).orderBy("doc_id").collect()]
    assert got == expected(vocabulary, rows)


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1 << 20])
def test_counts_across_blocks(spark, vocabulary, block):
    rows = [(i, t) for i, t in enumerate(AWKWARD[:10] * 2)] + [(None, "x y"), (3, "again")]
    path = scratch(spark, "t")
    manifest = token_counts.write(spark.createDataFrame(rows, DOCS).repartition(3), path, vocabulary)
    found = token_counts.token_counts(manifest, path, block_tokens=block).select("doc_id", "n_tokens").collect()
    assert sorted((r[0] is None, r[0] or 0, r[1]) for r in found) == sorted(
        (i is None, i or 0, len(plain(vocabulary, t))) for i, t in rows)


def test_counts_of_long_texts_beside_clashing_columns(spark, vocabulary):
    rows = [(i, t) for i, t in enumerate(AWKWARD[10:])] + [(90, "one two " * 40_000), (91, None), (91, "z")]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "'f' AS file", "7 AS ordinal", "9 AS n_tokens", "1 AS first", "2 AS ends")
    path = scratch(spark, "t")
    found = token_counts.token_counts(token_counts.write(df, path, vocabulary), path, block_tokens=5000)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in found.collect()) == sorted((i, len(plain(vocabulary, t))) for i, t in rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    window = "".join(plan[plan.index("Window "):].splitlines()[:2])  # the window and the columns it gets
    assert not re.search(r"\b(ends|starts)#", window)  # separators stay out of the prefix scan


def test_counts_of_a_file_without_last_separator(spark):
    from pyarrow import fs

    path = scratch(spark, "t")
    where, folder = fs.FileSystem.from_uri(path)
    where.create_dir(folder, recursive=True)
    with where.open_output_stream(f"{folder}/a.bin") as f:
        f.write(np.array([5, 9, 9, 7, 7, 7], "<u2").tobytes() + b"\x01")
    with where.open_output_stream(f"{folder}/b.bin") as f:
        f.write(b"")
    files = spark.createDataFrame([("a.bin",), ("b.bin",)], "file string")
    got = sorted(tuple(r) for r in token_counts.scan(files, path, separator=9, block_tokens=2).collect())
    assert got == [("a.bin", 0, 0, 1, True), ("a.bin", 1, 2, 0, True), ("a.bin", 2, 3, 3, False)]
    empty = spark.createDataFrame([], "file string, ordinal long, doc_id long")
    assert token_counts.token_counts(empty, path).count() == 0


def test_counts_query_equals_library(spark, small, vocabulary):
    from caremart.llm.queries import op3_token_counts

    want = sorted((r["doc_id"], len(plain(vocabulary, r["text"]))) for r in table(spark, small, "documents").collect())
    assert sorted(tuple(r) for r in op3_token_counts(spark, small).collect()) == want
