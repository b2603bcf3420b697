"""Apply a stream of change rows to a stored dimension, one version per batch.

The SCD operators are pure functions (current, changes) -> next, so a change
feed needs no new operator: ``foreachBatch`` hands each micro-batch to
``scd2_apply`` / ``scd1_upsert`` and writes the result as a new version
``<target>/version=<batch id>``.  The current table is the newest complete
version below the batch id, so a batch replayed after a failure rebuilds the
same version from the same input (idempotent), and readers never see a
half-written table.  Old versions stay until the caller removes them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from caremart.operators import scd
from caremart.sources.tables import _hadoop_fs

VERSION_PREFIX = "version="


def _versions(spark: SparkSession, target: str, below: int | None = None) -> list[int]:
    root, fs = _hadoop_fs(spark, target)
    if not fs.exists(root):
        return []
    out = []
    for st in fs.listStatus(root):
        name = st.getPath().getName()
        if name.startswith(VERSION_PREFIX):
            v = int(name[len(VERSION_PREFIX):])
            done = spark._jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")
            if (below is None or v < below) and fs.exists(done):
                out.append(v)
    return sorted(out)


def version_path(target: str, version: int) -> str:
    return f"{target.rstrip('/')}/{VERSION_PREFIX}{version:012d}"


def latest_version(spark: SparkSession, target: str, below: int | None = None) -> DataFrame | None:
    """The newest complete version of the table (optionally older than ``below``)."""
    vs = _versions(spark, target, below)
    return spark.read.parquet(version_path(target, vs[-1])) if vs else None


def apply_change_stream(changes: DataFrame, target: str, initial: DataFrame,
                        checkpoint_location: str, mode: str = "scd2",
                        trigger: dict | None = None, **op_args) -> StreamingQuery:
    """Start a query that maintains ``target`` from the ``changes`` stream.

    ``mode="scd2"`` applies ``scd.scd2_apply(current, batch, **op_args)``;
    ``mode="scd1"`` applies ``scd.scd1_upsert``.  ``initial`` is the table
    before the first batch.  ``checkpoint_location`` must be a shared folder.
    """
    if mode == "scd2":
        op: Callable = scd.scd2_apply
    elif mode == "scd1":
        op = scd.scd1_upsert
    else:
        raise ValueError("mode must be 'scd2' or 'scd1'")

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        current = latest_version(spark, target, below=batch_id)
        if current is None:
            current = initial
        op(current, batch, **op_args).write.mode("overwrite").parquet(version_path(target, batch_id))

    writer = changes.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    return writer.start()
