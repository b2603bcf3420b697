"""Removal of boilerplate lines that spread over many sites.

A line's spread is the number of distinct sites whose documents hold it.  Lines are keyed by 128
bits of their trimmed text.  First, a plain aggregate keeps the lines seen on two sites or more; a
line of one site can't be boilerplate.  For these, HyperLogLog sketches of the sites are built in
every task and merged by aggregation.  Estimates well below the threshold are dropped, those well
above are taken; lines whose estimate lies within ``MARGIN`` of it get an exact distinct count.
``remove`` then takes the lines found out of the documents.  Up to ``BROADCAST_KEYS`` keys are broadcast and
documents stay where they are.  Of more keys, those on the most documents are, and the lines of the
others, none of which is frequent then, are found by a join of line keys and go by their position.

Defined cases: a null text has no lines and becomes empty; blank lines are kept and count nowhere;
a null site is a site of its own; repeated rows stay; a document of boilerplate alone becomes empty text;
empty tables are fine; further columns are kept in a struct.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caremart.llm.common import cut, near_join, slices

SITES = 8  # distinct sites from which on a line is boilerplate
SKETCH_BITS = 12  # standard error of about 1.6 %
MARGIN = 0.1  # over six standard errors on either side
BROADCAST_KEYS = 250_000  # line keys (16 bytes, some 80 in a Python set) that are broadcast at most


def boilerplate(docs: DataFrame, site: str = "source", sites: int = SITES, margin: float = MARGIN,
                sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """Keys (md5 of the trimmed text) of the lines on at least ``sites`` distinct sites, and the number
    ``n`` of documents that hold them."""
    where = F.col(f"`{site}`").cast("string")
    where = F.xxhash64(F.when(where.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), where)))
    line = F.explode(F.array_distinct(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", -1)))
    rows = cut(docs.select(where.alias("site"), line.alias("line")).filter(F.trim("line") != "")
               .select(F.unhex(F.md5(F.trim("line"))).alias("key"), "site"), "lines")
    if sites < 2:
        return cut(rows.groupBy("key").agg(F.count("*").alias("n")), "boilerplate")
    spread = cut(rows.groupBy("key").agg(F.min("site").alias("a"), F.max("site").alias("b"))
                 .filter("a < b").select("key"), "spread")
    wide = rows.join(near_join(spread), "key", "left_semi")
    sketched = cut(wide.groupBy("key").agg(F.hll_sketch_agg("site", F.lit(sketch_bits)).alias("sketch"), F.count("*").alias("n"))
                   .select("key", "n", F.hll_sketch_estimate("sketch").alias("estimate")), "sketched")
    low, high = sites * (1 - margin) - 1, sites * (1 + margin) + 1
    sure = sketched.filter(F.col("estimate") > high).select("key", "n")
    near = sketched.filter((F.col("estimate") <= high) & (F.col("estimate") >= low)).select("key")
    exact = (rows.join(near_join(near), "key", "left_semi").groupBy("key").agg(F.count_distinct("site").alias("sites"), F.count("*").alias("n"))
             .filter(F.col("sites") >= sites).select("key", "n"))
    return cut(sure.union(exact), "boilerplate")


def _frequent(keys: DataFrame, most: int) -> int:
    """The least power of two such that at most ``most`` keys lie on so many documents or more."""
    power = F.floor(F.log2("n")).cast("int")
    left, level = most, 62
    for r in keys.groupBy(power.alias("power")).count().orderBy(F.desc("power")).collect():  # at most 63 rows
        if r["count"] > left:
            break
        left, level = left - r["count"], r["power"]
    return 1 << level


def remove(docs: DataFrame, keys: DataFrame, keep: list[str], broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``doc`` (struct of the ``keep`` columns), text without the lines of ``keys``, n_lines, n_removed."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc"].dataType
    if keys.count() > broadcast_keys:
        level = _frequent(keys, broadcast_keys)
        rows = _with_places(rows, keys.filter(F.col("n") < level).select("key"))
        keys = keys.filter(F.col("n") >= level)
    else:
        rows = rows.withColumn("places", F.lit(None).cast("array<int>"))
    shared = sc.broadcast(frozenset(bytes(r["key"]) for r in keys.select("key").collect()))  # at most broadcast_keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone = shared.value
        for b in slices(batches):
            texts, total, removed = [], [], []
            for t, at in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                lines, places = t.split("\n"), frozenset(at or ())
                kept = [x for i, x in enumerate(lines) if i not in places
                        and (not (s := x.strip(" ")) or hashlib.md5(s.encode()).digest() not in gone)]
                texts.append("\n".join(kept))
                total.append(len(lines) if t else 0)
                removed.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(total, pa.int64()),
                                              pa.array(removed, pa.int64())], names=["doc", "text", "n_lines", "n_removed"])

    return rows.select("doc", "text", "places").mapInArrow(run, T.StructType([
        T.StructField("doc", kind), T.StructField("text", T.StringType()),
        T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())]))


def _with_places(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows with the positions of their lines of ``keys``: only keys and positions are shuffled to find
    them, and no key is on many rows."""
    stored = cut(rows.withColumn("row", F.monotonically_increasing_id()), "documents")
    lines = stored.select("row", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).filter(F.trim("line") != "")
    found = (lines.select("row", "at", F.unhex(F.md5(F.trim("line"))).alias("key")).join(keys.hint("merge"), "key", "left_semi")
             .groupBy("row").agg(F.collect_list("at").alias("places")))
    return stored.join(found.hint("merge"), "row", "left")
