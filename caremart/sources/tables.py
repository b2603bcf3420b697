"""Scans, in-memory sources and sinks."""

from __future__ import annotations

import hashlib
import threading
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from caremart.sources.claims_build import write_claims
from caremart.sources.fixtures import ALIASES, DOMAIN_SOURCES, DOMAIN_SQL, FACT_SOURCES, RAW_TABLES
from caremart.sources.layout import LAYOUT_COLUMNS, with_month, write_gathered

# The claims with their typed service day, year and month: the stored layout itself.
MONTHLY = "claims_by_month"


class Warehouse:
    """The claims warehouse over one folder of parquet files.

    Raw tables are read lazily and exposed to SQL as temporary views under
    their own names; each domain table is its fixture SQL over those views.

    With ``materialize=True`` (default) a domain table is written once, as
    parquet, into the cluster's shared checkpoint folder and read back from
    there - the stored claims table the reports expect.  The copy is keyed by
    a fingerprint of the source files (paths, sizes, modification times) and of
    the table's SQL, so a changed source gets a new copy and later applications
    with the same ``spark.checkpoint.dir`` reuse it; being files in the shared
    folder it survives lost executors.  Queries then scan a columnar claims table with
    column pruning and filter pushdown instead of re-deriving it.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, materialize: bool = True):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.materialize = materialize
        self._frames: dict[str, DataFrame] = {}
        self._lock = threading.RLock()  # one materialisation per table, even across threads
        self._raw = {t: self.raw(t) for t in DOMAIN_SOURCES}
        self._publish_raw()

    def _publish_raw(self) -> None:
        # the fixture SQL names raw tables; another warehouse in the same
        # session may have published other folders under those names since
        for t, df in self._raw.items():
            df.createOrReplaceTempView(t)

    def raw(self, name: str) -> DataFrame:
        if name not in RAW_TABLES:
            raise KeyError(f"unknown raw table {name!r}")
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return balanced(df) if name in FACT_SOURCES else df

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    def table(self, name: str) -> DataFrame:
        """Resolve a 1-, 2- or 3-part name to a domain table."""
        base = ALIASES.get(_bare(name), _bare(name))
        if base not in DOMAIN_SQL and base != MONTHLY:
            raise KeyError(f"unknown table {name!r}")
        with self._lock:
            if base not in self._frames:
                if base == "claims":  # the same files without the layout's columns
                    self._frames[base] = self.table(MONTHLY).drop(*LAYOUT_COLUMNS)
                else:
                    self._frames[base] = self._build(base)
            return self._frames[base]

    def _build(self, base: str) -> DataFrame:
        self._publish_raw()
        monthly = base == MONTHLY
        df = self.spark.sql(DOMAIN_SQL["claims" if monthly else base])
        if self.materialize:
            return _materialized(self.spark, self.sf_dir, base, df, write=self._write_claims if monthly else None)
        return with_month(df) if monthly else df

    def _write_claims(self, _df: DataFrame, path: str) -> None:
        """Write the rows of CLAIMS_SQL below ``path``, a folder a month."""
        write_claims(self._raw, _bytes(self.spark, f"{self.sf_dir}/lineitem.parquet"), lambda rows: write_gathered(rows, path))

    def stored(self, name: str, build) -> DataFrame:
        """A table derived by ``build()`` and written once to the shared
        folder (like a notebook's ``saveAsTable`` followed by a re-read)."""
        key = f"derived:{name}"
        with self._lock:
            if key not in self._frames:
                self._frames[key] = _materialized(self.spark, self.sf_dir, name, build(), shared_path)
            return self._frames[key]

    def register_views(self, names: Iterable[str] = tuple(DOMAIN_SQL) + tuple(ALIASES)) -> None:
        """Expose domain tables to ``spark.sql`` under the notebook names."""
        for n in names:
            self.table(n).createOrReplaceTempView(n)


# A scan with at least this many splits is left alone on any cluster.
BALANCE_SPLITS = 64


def balanced(df: DataFrame) -> DataFrame:
    """Spread a scan that has only a handful of splits.

    A small file with one parquet row group is a single split, which would
    run every downstream broadcast join and projection in one task.  Such a
    scan is round-robin repartitioned to min(cores, 64) partitions - a small
    shuffle of a small input.  Inputs with enough splits (every large table)
    are returned untouched, so no big table is ever reshuffled here.
    """
    try:
        target = min(df.sparkSession.sparkContext.defaultParallelism, BALANCE_SPLITS)
        splits = df._jdf.rdd().getNumPartitions()
    except Exception:  # noqa: BLE001 - no JVM handle (remote session): leave as is
        return df
    return df.repartition(target) if splits < target else df


def _hadoop_fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _bytes(spark: SparkSession, path: str) -> int:
    p, fs = _hadoop_fs(spark, path)
    return fs.getContentSummary(p).getLength()


def _fingerprint(spark: SparkSession, sf_dir: str) -> str:
    h = hashlib.sha1(sf_dir.encode())
    h.update(repr(sorted(DOMAIN_SQL.items())).encode())
    for t in DOMAIN_SOURCES:
        p, fs = _hadoop_fs(spark, f"{sf_dir}/{t}.parquet")
        files = fs.listFiles(p, True)  # every part file of a folder
        seen = []
        while files.hasNext():
            st = files.next()
            seen.append(f"{st.getPath()}:{st.getLen()}:{st.getModificationTime()}")
        h.update(f"{t}:{sorted(seen)}".encode())
    return h.hexdigest()[:16]


def _materialized(spark: SparkSession, sf_dir: str, name: str, df: DataFrame, place=None, write=None) -> DataFrame:
    """``df`` as stored below ``place`` (by default the folder that applications share) by ``write``
    (plain parquet if not given); written beside it first, so that a copy is either whole or absent."""
    from caremart import __version__

    folder = (place or stable_path)(spark, "caremart-tables", f"{_fingerprint(spark, sf_dir)}-v{__version__}")
    path = f"{folder}/{name}"
    p, fs = _hadoop_fs(spark, path)
    if not fs.exists(p):
        stage, _ = _hadoop_fs(spark, f"{folder}/_stage-{name}-{uuid.uuid4().hex}")
        (write or (lambda rows, to: rows.write.parquet(to)))(df, stage.toString())
        if fs.exists(p) or not fs.rename(stage, p):
            fs.delete(stage, True)  # another application was first
    return spark.read.parquet(path)


def _bare(name: str) -> str:
    return name.split(".")[-1].strip("`")


def table(spark: SparkSession, name: str) -> DataFrame:
    """Catalog table by 1-, 2- or 3-part name."""
    return spark.table(name)


def preview(df: DataFrame, n: int = 10, order_by: Sequence[str] | None = None) -> DataFrame:
    """First ``n`` rows in a total order (a bare LIMIT is nondeterministic).

    Planned as ``TakeOrderedAndProject``: each task keeps its own top ``n`` and
    only ``n`` rows per task reach the final merge.
    """
    keys = list(order_by) if order_by else list(df.columns)
    return df.orderBy(*keys).limit(n)


def change_set(spark: SparkSession, rows: Sequence[tuple], schema: StructType) -> DataFrame:
    """S3: a typed in-memory change set (hand-made test rows)."""
    return spark.createDataFrame(list(rows), schema)


def empty_table(spark: SparkSession, schema: StructType) -> DataFrame:
    """An empty table with a declared schema."""
    return spark.createDataFrame([], schema)


def register_view(df: DataFrame, name: str) -> DataFrame:
    """Publish a frame as a temporary view; returns the frame."""
    df.createOrReplaceTempView(name)
    return df


def write_table(df: DataFrame, name: str, mode: str = "overwrite") -> DataFrame:
    """Write a frame as a catalog table and return the stored table.

    Spark refuses to overwrite a table the plan still reads from, so when the
    target appears in the plan the rows go to a staging table first, which is
    then copied into place.  Each step is a full, restartable Spark job; a lost
    executor only re-runs its tasks.
    """
    spark = df.sparkSession
    if mode == "overwrite" and spark.catalog.tableExists(name) and _reads_table(df, name):
        stage = f"{name}_stage_{uuid.uuid4().hex[:8]}"
        df.write.mode("overwrite").saveAsTable(stage)
        spark.table(stage).write.mode("overwrite").saveAsTable(name)
        spark.sql(f"DROP TABLE IF EXISTS {stage}")
    else:
        df.write.mode(mode).saveAsTable(name)
    return spark.table(name)


def _reads_table(df: DataFrame, name: str) -> bool:
    plan = df._jdf.queryExecution().analyzed().toString().lower()
    return _bare(name).lower() in plan


def write_path(df: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Write parquet to ``path`` and return a frame that reads it back.

    Used to cut lineage between chained table rebuilds (SCD runs): the new
    version lives in a shared folder, so any executor can read it after the
    writer is gone.
    """
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.parquet(path)


def load_or_init_scd2(spark: SparkSession, target: str, base: DataFrame, init) -> DataFrame:
    """Read the SCD2 table ``target`` or build it from ``base`` with ``init``.

    ``init`` is the initial-load operator (``scd.scd2_init``); a base frame
    that already carries the SCD2 columns is returned unchanged.
    """
    if spark.catalog.tableExists(target):
        current = spark.table(target)
        if "is_current_record" not in current.columns:
            current = init(current)
        return current
    return init(base)


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path in the cluster's shared checkpoint folder (``spark.checkpoint.dir``)."""
    from caremart.session import ensure_checkpoint_dir

    root = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([root, *parts])


def stable_path(spark: SparkSession, *parts: str) -> str:
    """As ``shared_path``, but the same for every application that names the same folder; where
    the setting is absent (tests) this is ``shared_path``."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return "/".join([root.rstrip("/"), *parts]) if root else shared_path(spark, *parts)
