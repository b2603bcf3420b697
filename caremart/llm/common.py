"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caremart.session import ensure_checkpoint_dir

SLICE_ROWS = 256
BROADCAST_ROWS = 1_000_000  # ids or keys (8 to 40 bytes each) that may be broadcast; more are joined


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, through Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder below the shared checkpoint folder; removed when the application ends."""
    base = ensure_checkpoint_dir(spark)
    path = f"{base}/caremart-llm/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, so a
    lost executor costs a re-read, never a recomputation of what came before."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def near_join(small: DataFrame) -> DataFrame:
    """A stored frame of ids, to be broadcast if its counted rows allow it, else left to a shuffle join."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in small pieces without copying, so that few texts are Python objects at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def md5_long(*cols: Column) -> Column:
    """60 bits of md5 as a non-negative long; the same number in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 15), 16, 10).cast("long")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so further columns can never clash with working names."""
    return df.select(*[F.col(f"`{n}`") for n in names])
