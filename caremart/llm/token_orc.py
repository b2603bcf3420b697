"""Token ids in ORC files: written in ascending document order, read stripe-parallel.

Files: a folder of ORC files, one per write task, ranges of ``doc_id`` in file order.
Columns: ``part`` (number of the file's range), ``doc_id``, ``local_start`` (ids of the
documents before it in its range), ``n_tokens``, ``ids`` (array of int).  The ORC writer
stores integers run-length encoded, a row index every ``INDEX_STRIDE`` rows and a Bloom
filter on ``doc_id``; a reader with a predicate on ``doc_id`` skips files and stripes by
their minima and maxima, and row groups by the Bloom filter (``find``).

Defined cases: a null text is empty (its ids are the end id alone); a null ``doc_id``
sorts first; equal ``doc_id`` s are ordered by their text's hash, repeated rows stay; an
empty table gives a valid, empty folder; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caremart.llm import encoding
from caremart.llm.common import slices

STRIPE_BYTES = 16 << 20  # several stripes a file, read in parallel
INDEX_STRIDE = 1_000  # rows between row-index entries
END_ID = 1
FILE_SCHEMA = "part int, doc_id long, local_start long, n_tokens long, ids array<int>"


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> None:
    """Encode ``text`` whole and write the ids below ``path``.

    One range shuffle of (doc_id, text); encoding, numbering and writing follow in the
    same tasks.  Nothing is gathered: each task numbers its own range.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding.encoder(tokenizer_path)
        part, before = TaskContext.get().partitionId(), 0
        for b in slices(batches, encoding.SLICE_ROWS):
            keys, texts = b.column(0), [t or "" for t in b.column(1).to_pylist()]
            for i, j in encoding.runs(texts):
                ids, n = encoding.with_end(*enc.encode(texts[i:j]), end_id)
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(j - i, part, np.int32)), keys.slice(i, j - i).cast(pa.int64()),
                    pa.array(before + ends - n), pa.array(n),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)),
                                             pa.array(ids.view(np.int32)))],
                    names=["part", "doc_id", "local_start", "n_tokens", "ids"])
                before += int(ends[-1])

    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
     .repartitionByRange("doc_id", F.xxhash64("text"))
     .sortWithinPartitions("doc_id", F.xxhash64("text"))
     .mapInArrow(encode, FILE_SCHEMA)
     .write.option("orc.stripe.size", STRIPE_BYTES).option("orc.create.index", "true")
     .option("orc.row.index.stride", INDEX_STRIDE).option("orc.bloom.filter.columns", "doc_id")
     .option("orc.bloom.filter.fpp", "0.01").option("compression", "zstd").orc(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows; the columns asked for and predicates on them reach the ORC reader."""
    return spark.read.schema(FILE_SCHEMA).orc(path)


def find(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Ids of a few documents, by file and stripe pruning and the Bloom filter."""
    return read(spark, path).filter(F.col("doc_id").isin(list(doc_ids))).select("doc_id", "ids")


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, from the files alone.

    ``start`` adds the ids of all earlier ranges to ``local_start``; the ranges' sums are
    one row per written file, which is what bounds the broadcast.
    """
    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            at = ids.offsets.to_numpy()
            sums = [zlib.crc32(flat[x:y].data) for x, y in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2),
                 pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())],
                names=["part", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    stored = read(spark, path)
    ranges = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = ranges.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    rows = stored.select("part", "doc_id", "local_start", "ids").mapInArrow(
        crc, "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return (rows.join(F.broadcast(base), "part")
            .select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"))
