"""k nearest vectors by cosine: a block matrix join with int8 product tiles.

Queries and rows are dealt into blocks; a tile is one query block against one row block.
In a tile all vectors are quantised to int8.  With u = s*q + e (q the int8 vector, |e| known
per vector) the cosine of two unit vectors differs from s*s'*q.q' by at most
(1+|e|)*|e'| + |e|.  Pairs whose upper bound reaches the k-th largest lower bound of their
query are computed again in double precision on the original vectors, and a heap keeps each
query's k best; the tiles' results are merged the same way.  The bounds are proven, so the
result is exact: nothing near the border is lost, ties go to the smaller id.

A tile returns at most k rows a query, whatever the number of equal or near vectors.

Defined cases: rows with a null id, and vectors that are null, empty, all zero or hold a null
or non-finite component take no part; vectors of another length than the query's are no
candidates; an id given to several vectors is reached by each of them, and as a query asks with
each, and counts with its best score; fewer than k candidates are all returned; empty tables give
empty results; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caremart.llm.common import cut

TILE_ROWS = 1024  # rows (and queries) of a tile at most about this many
SLACK = 1e-9  # covers rounding of the bounds themselves
RESULT = "query_id long, vec_id long, score double"


def _unit(column: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scaled originals and norms; int8 values (held as float), scales and error norms."""
    v = np.array(column.tolist(), np.float64)
    _, exponent = np.frexp(np.abs(v).max(axis=1))
    v = np.ldexp(v, -exponent[:, None])  # exact, and no square over- or underflows
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    u = v / norm[:, None]
    scale = np.abs(u).max(axis=1) / 127.0
    q = np.rint(u / scale[:, None])
    left = u - q * scale[:, None]
    kind = np.float32 if v.shape[1] * 127 * 127 < 2**24 else np.float64  # products stay whole numbers
    return v, norm, q.astype(kind), scale, np.sqrt(np.einsum("ij,ij->i", left, left))


def tile_nearest(queries: pd.DataFrame, rows: pd.DataFrame, k: int, step: int = 256) -> pd.DataFrame:
    """The k nearest ids of each query row within one tile (columns id, v)."""
    out: list[tuple[int, int, float]] = []
    if len(queries) and len(rows):
        rows = rows.sort_values("id", kind="stable")
        qid, rid = queries["id"].to_numpy(), rows["id"].to_numpy()
        first = np.flatnonzero(np.r_[True, rid[1:] != rid[:-1]])  # rows of one id follow each other
        qv, qn, q8, qs, qe = _unit(queries["v"])
        rv, rn, r8, rs, re = _unit(rows["v"])
        for a in range(0, len(qid), step):
            b = min(a + step, len(qid))
            near = (q8[a:b] @ r8.T).astype(np.float64) * qs[a:b, None] * rs[None, :]
            err = (1 + qe[a:b, None]) * re[None, :] + qe[a:b, None] + SLACK
            own = qid[a:b, None] == rid[None, :]
            low = np.where(own, -np.inf, near - err)
            if len(first) < len(rid):
                low = np.maximum.reduceat(low, first, axis=1)
            kth = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(b - a, -np.inf)
            keep = ((near + err) >= kth[:, None]) & ~own
            for i in range(b - a):
                j = np.flatnonzero(keep[i])
                score = np.einsum("ij,ij->i", rv[j], np.broadcast_to(qv[a + i], (len(j), qv.shape[1])))
                score = score / (rn[j] * qn[a + i])
                of_id: dict[int, float] = {}
                for r, s in zip(rid[j].tolist(), (-score).tolist(), strict=True):
                    of_id[r] = min(s, of_id.get(r, s))
                best = heapq.nsmallest(k, ((s, r) for r, s in of_id.items()))
                out += [(int(qid[a + i]), r, -s) for s, r in best]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id",
            vector_col: str = "embedding", tile_rows: int = TILE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest other rows of each query row."""
    whole = F.forall("v", lambda x: F.coalesce(F.abs(x) < F.lit(math.inf), F.lit(False)))
    rows = cut(vectors.select(F.col(id_col).cast("long").alias("id"),
                              F.col(vector_col).cast("array<double>").alias("v"),
                              F.coalesce(is_query, F.lit(False)).alias("is_query"))
               .filter(F.col("id").isNotNull() & whole & F.exists("v", lambda x: x != 0))
               .groupBy("id", "v").agg(F.max("is_query").alias("is_query"))
               .withColumn("dim", F.size("v")), "ann")
    size = rows.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).first()
    row_blocks, query_blocks = max(1, -(-size["n"] // tile_rows)), max(1, -(-size["q"] // tile_rows))

    def block(seed: str, n: int) -> Column:
        return F.pmod(F.xxhash64("id", "v", F.lit(seed)), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    queries = rows.filter("is_query").select("dim", "id", "v", block("q", query_blocks).alias("qb"),
                                             every(row_blocks).alias("rb"))
    others = rows.select("dim", "id", "v", block("r", row_blocks).alias("rb"), every(query_blocks).alias("qb"))

    def tile(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        return tile_nearest(q, r, k)

    found = queries.groupBy("dim", "qb", "rb").cogroup(others.groupBy("dim", "qb", "rb")).applyInPandas(tile, RESULT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    each = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return (each.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
