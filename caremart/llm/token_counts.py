"""Token counts from flat token files without an index.

A flat file is nothing but 16-bit little-endian token ids, each document closed by a
separator id.  ``scan`` reads fixed blocks of such files in parallel, finds separators with
one vectorised comparison a block, and stitches documents that cross blocks with a prefix
scan over one small row per block (file, first token, separators, last one): the sum of separators
before a block numbers its documents, the last separator before it gives the first document's
start.  The two carried numbers are joined back to the blocks, whose separators stay where they are.

``write`` makes such files: one per task attempt, named uniquely, and a manifest (file,
ordinal, doc_id) that Spark commits.  A file of a lost or repeated attempt is in no
manifest and so is never read.

Defined cases: a null or empty text has 0 tokens; repeated and null ``doc_id`` s stay rows of
their own; ids after a file's last separator form a last document with ``closed`` false; a
trailing odd byte is ignored; empty tables and files give no rows; further columns are
ignored.  Files are opened with pyarrow's file systems, so ``path`` may be file://, hdfs:// or
an object store's URI.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caremart.llm import encoding
from caremart.llm.common import cut, slices

BLOCK_TOKENS = 1 << 20
SEPARATOR = 0xFFFF  # above every id of the vocabularies that fit 16 bits
TOKEN = np.dtype("<u2")


def write(docs: DataFrame, path: str, tokenizer_path: str, separator: int = SEPARATOR) -> DataFrame:
    """Write flat files below ``path``, straight from the scan; returns the stored manifest."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding.encoder(tokenizer_path)
        where, folder = fs.FileSystem.from_uri(path)
        name = f"{TaskContext.get().partitionId():07d}-{uuid.uuid4().hex}.bin"
        sink, ordinal = None, 0
        for b in slices(batches, encoding.SLICE_ROWS):
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i, j in encoding.runs(texts):
                ids, n = enc.encode(texts[i:j])
                if len(ids) and int(ids.max()) >= separator:
                    raise ValueError("the separator must be above every token id")
                if sink is None:
                    where.create_dir(folder, recursive=True)
                    sink = where.open_output_stream(f"{folder}/{name}")
                sink.write(encoding.with_end(ids, n, separator)[0].astype(TOKEN).tobytes())
            at = np.arange(ordinal, ordinal + b.num_rows)
            ordinal += b.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * b.num_rows, pa.string()), pa.array(at), b.column(0).cast(pa.int64())],
                names=["file", "ordinal", "doc_id"])
        if sink is not None:
            sink.close()

    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
               .mapInArrow(encode, "file string, ordinal long, doc_id long"), "manifest")


def scan(files: DataFrame, path: str, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, ordinal, start, n_tokens, closed of every document of the named flat files."""
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, folder = fs.FileSystem.from_uri(path)
        for b in batches:
            for name in b.column(0).to_pylist():
                n = where.get_file_info(f"{folder}/{name}").size // TOKEN.itemsize
                first = np.arange(0, n, block_tokens)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(first), pa.string()), pa.array(first),
                     pa.array(np.minimum(block_tokens, n - first)), pa.array(np.full(len(first), n))],
                    names=["file", "first", "n", "file_tokens"])

    def separators(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, folder = fs.FileSystem.from_uri(path)
        for b in batches:
            for r in b.to_pylist():
                with where.open_input_file(f"{folder}/{r['file']}") as f:
                    raw = f.read_at(r["n"] * TOKEN.itemsize, r["first"] * TOKEN.itemsize)
                tokens = np.frombuffer(raw, TOKEN)
                at = np.flatnonzero(tokens == separator) + r["first"]
                if r["first"] + r["n"] == r["file_tokens"] and tokens[-1] != separator:
                    at = np.append(at, r["file_tokens"])
                starts = [None, *(at[:-1] + 1).tolist()][:len(at)]  # the first one is in an earlier block
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["file"]]), pa.array([r["first"]]), pa.array([len(at)], pa.int64()),
                     pa.array([int(at[-1]) if len(at) else None], pa.int64()),
                     pa.array([at.tolist()], pa.list_(pa.int64())), pa.array([starts], pa.list_(pa.int64())),
                     pa.array([r["file_tokens"]])],
                    names=["file", "first", "n_ends", "last_end", "ends", "starts", "file_tokens"])

    found = cut(files.select("file").distinct().mapInArrow(blocks, "file string, first long, n long, file_tokens long")
             .repartition("file", "first")
             .mapInArrow(separators, "file string, first long, n_ends long, last_end long, ends array<long>, "
                                     "starts array<long>, file_tokens long"), "blocks")
    earlier = Window.partitionBy("file").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    carries = found.select(
        "file", "first", F.coalesce(F.sum("n_ends").over(earlier), F.lit(0)).alias("before"),
        (F.coalesce(F.last("last_end", ignorenulls=True).over(earlier), F.lit(-1)) + 1).alias("carried"))
    each = (found.join(carries, ["file", "first"])
            .select("file", "file_tokens", "before", "carried", F.posexplode(F.arrays_zip("starts", "ends")).alias("i", "span")))
    start, end = F.coalesce("span.starts", "carried"), F.col("span.ends")
    return each.select("file", (F.col("before") + F.col("i")).alias("ordinal"), start.alias("start"),
                       (end - start).alias("n_tokens"), (end < F.col("file_tokens")).alias("closed"))


def token_counts(manifest: DataFrame, path: str, separator: int = SEPARATOR,
                 block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, file, start, n_tokens of every document of a manifest."""
    counted = scan(manifest, path, separator, block_tokens).filter("closed")
    # both sides grow with the documents, and the stored manifest is far smaller than its rows
    return manifest.hint("merge").join(counted, ["file", "ordinal"]).select("doc_id", "file", "start", "n_tokens")
