"""Hard-negative mining by integer inner products in a residue number system.

Components become whole numbers, ``floor(scale * x)``.  Their inner products are needed exactly,
but are multiplied in float32: modulo each of several small primes the component matrices hold
balanced residues so small that a product over ``CHUNK`` components stays below 2^24, where
float32 is exact.  The residues of a score modulo the primes give the signed score back by Chinese
remaindering (balanced mixed-radix digits).  As many primes are taken as the largest squared
length of a vector asks for, which bounds every score.

The work is a block matrix product: anchors and rows are dealt into blocks by hash, a tile is one
block of anchors against one block of rows, and each block is shipped to the tiles that need it.
Two rounds of tiles: the first keeps each anchor's best rows of the same label (its positives),
merged over tiles by a window; the second gets each anchor with its positives' scores, and keeps
for every positive the best rows of other labels whose score lies in the window that the positive's
score allows, merged again.  A tile returns at most k rows an anchor (and positive), whatever the
number of equal scores.

Defined cases: rows with a null id or label, a null vector, or a null or non-finite component take
no part; vectors of other lengths than the anchor's are no partners (an empty vector scores 0 with
other empty ones); components saturate where an inner product could leave a long (for 64
components beyond 379 million); rows equal in id, label and whole-number vector count once; an id
with several different rows has all of them as rows of their own (as an anchor it mines for each,
its other rows are partners like any); equal scores go to the smaller id, then label, then
fingerprint of the vector; an anchor without positives or a positive without negatives in its
window has no result rows; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caremart.llm.common import cut

CHUNK = 64  # components whose residue products are added in float32
HALF = math.isqrt((2**24 - 1) // CHUNK)  # largest absolute residue that keeps such a sum exact
LONG = 2**63 - 1
BLOCK_BYTES = 32 << 20  # float32 bytes of a block's residue matrix
LEAST_BLOCK = 1024
STEP = 256  # anchors whose scores are held at a time


def _primes(largest: int) -> list[int]:
    """The odd primes up to ``largest``, largest first."""
    return [p for p in range(largest, 2, -1) if all(p % d for d in range(2, math.isqrt(p) + 1))]


def moduli(bound: int) -> list[int]:
    """Primes whose product tells all whole numbers from -bound to bound apart."""
    out, product = [], 1
    for p in _primes(2 * HALF + 1):
        out.append(p)
        product *= p
        if product > 2 * bound:
            return out
    raise ValueError("too large a score for the primes below the residue bound")


def _balanced(x: np.ndarray, p: int) -> np.ndarray:
    """The residue of least absolute value."""
    r = x % p
    return r - p * (r > p // 2)


class Residues:
    """A whole-number matrix, as float32 residue matrices modulo each prime."""

    def __init__(self, matrix: np.ndarray, primes: list[int]):
        self.primes = primes
        self.parts = [_balanced(matrix, p).astype(np.float32) for p in primes]

    def product(self, rows: "Residues", first: int, last: int) -> np.ndarray:
        """Exact scores (long) of the own rows from first to last with all of the other's."""
        digits: list[np.ndarray] = []
        for n, (p, a, b) in enumerate(zip(self.primes, self.parts, rows.parts, strict=True)):
            a = a[first:last]
            total = np.zeros((len(a), len(b)), np.int32)
            for c in range(0, a.shape[1], CHUNK):
                total += (a[:, c:c + CHUNK] @ b[:, c:c + CHUNK].T).astype(np.int32) % p
            # the next mixed-radix digit: what is left after the earlier ones, divided by their primes
            digit = total
            for q, known in zip(self.primes[:n], digits, strict=False):
                digit = (digit - known) % p * pow(q, -1, p) % p
            digits.append(_balanced(digit, p).astype(np.int32))
        score = np.zeros(digits[0].shape, np.int64)
        radix = 1
        for p, digit in zip(self.primes, digits, strict=True):
            with np.errstate(over="ignore"):  # sums wrap; the true score fits a long
                score += digit * np.array(radix % 2**64, np.uint64).astype(np.int64)
            radix *= p
        return score


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _best(scores: np.ndarray, where: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """The k positions of ``where`` with the largest scores; ties by ``order``."""
    s = scores[where]
    if len(where) > k:
        kept = s >= np.partition(s, -k)[-k]
        where, s = where[kept], s[kept]
    return where[np.lexsort((order[where], -s))][:k]


def _ranked(t: pa.Table) -> np.ndarray:
    """The place of every row in the order that settles ties."""
    keys = list(zip(t["id"].to_pylist(), t["label"].to_pylist(), t["mark"].to_pylist(), strict=True))
    place = np.empty(len(keys), np.int64)
    place[sorted(range(len(keys)), key=keys.__getitem__)] = np.arange(len(keys))
    return place


def tile(anchors: pa.Table, rows: pa.Table, primes: list[int], dim: int,
         choose: Callable[[int, np.ndarray, np.ndarray], list[tuple[int, np.ndarray]]]) -> list[tuple[int, int, int, int]]:
    """(anchor, what, row, score) of the rows that ``choose`` takes for each anchor of the tile.

    ``choose`` gets an anchor's number, its scores and the tie order, and returns
    (what, positions) pairs.
    """
    out = []
    order = _ranked(rows)
    a, b = (Residues(_matrix(t["v"], dim), primes) for t in (anchors, rows))
    for first in range(0, len(anchors), STEP):
        scores = a.product(b, first, min(first + STEP, len(anchors)))
        for i, s in enumerate(scores, first):
            for what, at in choose(i, s, order):
                out += [(i, what, int(j), int(s[j])) for j in at]
    return out


def _found(anchors: pa.Table, rows: pa.Table, found: list[tuple[int, int, int, int]]) -> pa.Table:
    i, what, j, score = (np.array(c, np.int64) for c in (zip(*found, strict=True) if found else ([], [], [], [])))
    names = ["anchor_id", "anchor_mark", "what", "id", "label", "mark", "score"]
    a, r = anchors.select(["id", "mark"]).take(i), rows.select(["id", "label", "mark"]).take(j)
    return pa.table([*a.columns, pa.array(what), *r.columns, pa.array(score)], names=names)


FOUND = "anchor_id long, anchor_mark binary, what long, id long, label long, mark binary, score long"


def whole_vectors(vectors: DataFrame, is_anchor: Column, label: Column, scale: int, id_col: str,
                  vector_col: str) -> DataFrame:
    """id, label, v (whole numbers), mark, dim, square and is_anchor of the rows that take part, each once."""
    finite = F.forall("x", lambda c: F.coalesce(F.abs(c) < F.lit(math.inf), F.lit(False)))
    limit = F.least(F.lit(2.0**31 - 1), F.floor(F.sqrt(F.lit(float(LONG)) / F.greatest(F.size("x"), F.lit(1)))) - 1.0)
    return (vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
                           F.col(vector_col).cast("array<double>").alias("x"),
                           F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
            .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & finite)
            .withColumn("limit", limit)
            .select("id", "label", "is_anchor", F.transform("x", lambda c: F.floor(F.greatest(
                -F.col("limit"), F.least(F.col("limit"), c * scale))).cast("int")).alias("v"))
            .groupBy("id", "label", "v").agg(F.max("is_anchor").alias("is_anchor"))
            .select("*", F.size("v").alias("dim"),
                    F.unhex(F.md5(F.concat_ws(",", F.col("label").cast("string"), F.col("v").cast("array<string>"))
                                  .cast("binary"))).alias("mark"),
                    F.aggregate("v", F.lit(0).cast("long"), lambda s, c: s + c.cast("long") * c).alias("square")))


def mine(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10,
         least: tuple[int, int] = (30, 100), most: tuple[int, int] = (90, 100), scale: int = 256,
         id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A negative's score is at least ``least`` and at most ``most`` (numerator, denominator) of the
    positive's.  ``block_rows`` bounds the rows of a block (default: by bytes and parallelism).
    """
    spark = vectors.sparkSession
    rows = cut(whole_vectors(vectors, is_anchor, label, scale, id_col, vector_col), "hard-negatives")
    asked = rows.filter("is_anchor").drop("is_anchor")
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("is_anchor").alias("anchors"),
                     F.max("square").alias("square"), F.max("dim").alias("dim")).first()
    primes = moduli(max(1, sizes["square"] or 0))
    cores = spark.sparkContext.defaultParallelism
    most_rows = block_rows or max(LEAST_BLOCK, BLOCK_BYTES // (4 * max(1, sizes["dim"] or 0) * len(primes)))
    spread = -(-sizes["n"] // (4 * cores))  # small tables are dealt finer, for parallel tiles
    row_blocks = max(1, -(-sizes["n"] // min(most_rows, max(spread, block_rows or LEAST_BLOCK))))
    anchor_blocks = max(1, -(-sizes["anchors"] // most_rows))
    parts = min(row_blocks * anchor_blocks, max(200, 4 * cores))  # tiles are few bytes and much work: not coalesced

    def block(seed: str, n: int) -> Column:
        return F.pmod(F.xxhash64("id", "mark", F.lit(seed)), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    dealt = rows.select("dim", "id", "label", "mark", "v", block("r", row_blocks).alias("rb"),
                        every(anchor_blocks).alias("ab"))

    def tiles(anchors: DataFrame, one: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
        sent = anchors.select(*[F.col(c).alias(c) for c in anchors.columns], block("a", anchor_blocks).alias("ab"), every(row_blocks).alias("rb"))
        a, b = (df.repartition(parts, "dim", "ab", "rb").groupBy("dim", "ab", "rb") for df in (sent, dealt))
        return a.cogroup(b).applyInArrow(one, FOUND)

    def same_label(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(anchors) or not len(rows):
            return _found(anchors, rows, [])
        labels = rows["label"].to_numpy()
        by_label = {int(x): np.flatnonzero(labels == x) for x in np.unique(labels)}
        own = {key: i for i, key in enumerate(zip(rows["id"].to_pylist(), rows["mark"].to_pylist(), strict=True))}
        mine = anchors.select(["id", "mark", "label"]).to_pylist()

        def choose(i: int, scores: np.ndarray, order: np.ndarray) -> list[tuple[int, np.ndarray]]:
            where = by_label.get(mine[i]["label"], np.zeros(0, np.int64))
            where = where[where != own.get((mine[i]["id"], mine[i]["mark"]), -1)]
            return [(0, _best(scores, where, order, positives))]

        return _found(anchors, rows, tile(anchors, rows, primes, anchors["dim"][0].as_py(), choose))

    kept = Window.partitionBy("anchor_id", "anchor_mark", "what").orderBy(F.desc("score"), "id", "label", "mark")
    pairs = cut(tiles(asked.select("dim", "id", "label", "mark", "v"), same_label)
                .withColumn("nth", F.row_number().over(kept)).filter(F.col("nth") <= positives)
                .select("anchor_id", "anchor_mark", "nth", "id", "score"), "positives")
    # an anchor has at most ``positives`` of them
    wanted = asked.join(
        pairs.groupBy(F.col("anchor_id").alias("id"), F.col("anchor_mark").alias("mark"))
        .agg(F.array_sort(F.collect_list(F.struct("nth", "score"))).alias("pairs")), ["id", "mark"])
    (low, of_low), (high, of_high) = least, most

    def other_labels(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(anchors) or not len(rows):
            return _found(anchors, rows, [])
        labels = rows["label"].to_numpy()
        own = anchors["label"].to_numpy()
        given = anchors["pairs"].to_pylist()

        def choose(i: int, scores: np.ndarray, order: np.ndarray) -> list[tuple[int, np.ndarray]]:
            others = np.flatnonzero(labels != own[i])
            s, out = scores[others], []
            for pair in given[i]:
                # low/of_low * p <= s <= high/of_high * p in whole numbers
                floor, ceiling = -(-low * pair["score"] // of_low), high * pair["score"] // of_high
                out.append((pair["nth"], _best(scores, others[(s >= floor) & (s <= ceiling)], order, negatives)))
            return out

        return _found(anchors, rows, tile(anchors, rows, primes, anchors["dim"][0].as_py(), choose))

    found = (tiles(wanted.select("dim", "id", "label", "mark", "v", "pairs"), other_labels)
             .withColumn("rank", F.row_number().over(kept)).filter(F.col("rank") <= negatives)
             .select("anchor_id", "anchor_mark", F.col("what").cast("int").alias("nth"), "rank",
                     F.col("id").alias("negative_id"), F.col("score").alias("negative_score")))
    return (found.join(pairs.withColumnRenamed("id", "positive_id").withColumnRenamed("score", "positive_score"),
                       ["anchor_id", "anchor_mark", "nth"])
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
