"""Session helpers.

The library never creates a session behind the caller's back: every operator
takes DataFrames.  These helpers are for scripts, tests and the benchmark.
"""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Mapping
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings that matter at any scale.  AQE re-plans joins from measured shuffle
# sizes (broadcast conversion, skew splitting, partition coalescing).
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "caremart", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


@contextmanager
def set_conf(spark: SparkSession, conf: Mapping[str, str]):
    """Settings for the jobs that are started inside; what was set before is set again behind."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def shuffle_parts(spark: SparkSession, input_bytes: int, part_bytes: int):
    """Exchanges of the jobs inside start from a partition for each ``part_bytes`` of input, but not from fewer than
    the session's number; AQE joins small partitions up."""
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes // part_bytes))
    return set_conf(spark, {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts)})


def bounded_tasks(spark: SparkSession, read_bytes: int, joined_bytes: int):
    """A task of the jobs inside reads at most ``read_bytes`` of files, and AQE joins small partitions up to
    ``joined_bytes``.  Spark's defaults let both grow with the input up to 128 and 64 MB, compressed."""
    return set_conf(spark, {"spark.sql.files.maxPartitionBytes": str(read_bytes),
                            "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(joined_bytes)})


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the operator to a shared file system.  Only when
    it is unset (local tests) do we fall back to a fresh scratch folder.
    """
    sc = spark.sparkContext
    active = sc._jsc.sc().getCheckpointDir()
    if active.isDefined():
        return active.get()
    current = sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        # unset on a local master: a fresh folder of its own
        current = tempfile.mkdtemp(prefix="caremart-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(current)
    return sc._jsc.sc().getCheckpointDir().get()
