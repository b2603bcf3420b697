"""Join helpers: size-checked broadcast of a small side.

Spark broadcasts a join side on its own only when a *static* estimate is
under ``spark.sql.autoBroadcastJoinThreshold``; a side derived from an
aggregate or a join has no useful estimate, so Spark plans a sort-merge join
and shuffles the other side too - for a table-maintenance job that means
shuffling the whole stored dimension to apply a small batch of changes.

``bounded_broadcast`` measures instead of guessing: the frame is checkpointed
into the shared ``spark.checkpoint.dir`` (reliable files, lineage cut), its
in-memory bytes are measured from the data (``measured_bytes``: real string
lengths, fixed widths, row overhead), and it is marked for broadcast only if
that fits the threshold.  Otherwise it is returned as is and the join stays a
shuffle join (with AQE's skew splitting).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_LIMIT = 10 * 1024 * 1024


def _threshold(df: DataFrame) -> int:
    raw = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", str(DEFAULT_LIMIT))
    raw = raw.strip().lower()
    mult = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    for suffix in ("kb", "mb", "gb", "k", "m", "g", "b"):
        if raw.endswith(suffix):
            num = raw[: -len(suffix)]
            return int(float(num) * mult.get(suffix[0], 1))
    return int(raw)


def bounded_broadcast(df: DataFrame, max_bytes: int | None = None) -> tuple[DataFrame, bool]:
    """Materialise ``df`` and broadcast it if its measured size is small.

    Returns (frame, broadcast?).  The size is measured from the data
    (``measured_bytes``); a negative threshold (broadcast disabled) never
    broadcasts.
    """
    from caremart.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    limit = _threshold(df) if max_bytes is None else max_bytes
    frozen = df.checkpoint(eager=True)
    if limit < 0:
        return frozen, False
    size = measured_bytes(frozen)
    if size <= limit:
        return F.broadcast(frozen), True
    return frozen, False


def measured_bytes(df: DataFrame) -> int:
    """In-memory size of ``df`` from its data, in one aggregation.

    Strings and binaries count at their real byte length, other columns at
    their fixed width, plus 8 bytes per field per row (row format overhead);
    nested columns count at Spark's default estimate.
    """
    variable = [f.name for f in df.schema.fields
                if f.dataType.typeName() in ("string", "binary")]
    fixed = 0
    for f in df._jdf.schema().fields():
        if f.dataType().typeName() not in ("string", "binary"):
            fixed += int(f.dataType().defaultSize())
    per_row = fixed + 8 * len(df.schema.fields)
    aggs = [F.count(F.lit(1)).alias("__n")]
    aggs += [F.coalesce(F.sum(F.octet_length(F.col(c))), F.lit(0)).alias(f"__v{i}")
             for i, c in enumerate(variable)]
    row = df.agg(*aggs).first()
    return int(row["__n"]) * per_row + sum(int(row[f"__v{i}"]) for i in range(len(variable)))


def bounded_like(df: DataFrame, broadcast: bool) -> DataFrame:
    """Broadcast ``df`` when it is derived from (and no larger than) a frame
    that ``bounded_broadcast`` already measured and broadcast."""
    return F.broadcast(df) if broadcast else df


def keys_seen(big: DataFrame, small_keys: DataFrame, key: str, broadcast: bool) -> DataFrame:
    """Distinct keys of ``small_keys`` that occur in ``big``.

    ``big`` is probed with the small key set as the build side (no shuffle of
    ``big``); the result is bounded by the small key set, so it can be
    broadcast back for anti/semi joins against the small side.
    """
    probe = big.select(key).join(bounded_like(small_keys.select(key), broadcast), key, "left_semi")
    return probe.distinct()


# Output rows one join task should produce at most for one key.
PRODUCT_ROWS_PER_TASK = 5_000_000


def spread_product_join(left: DataFrame, right: DataFrame, key: str,
                        rows_per_task: int = PRODUCT_ROWS_PER_TASK) -> DataFrame:
    """Inner equi-join whose per-key output (n_left x n_right) may be huge.

    A plain join emits all of one key's output from one task.  Here each
    key's output size is computed from per-key row counts (two aggregates),
    and the *hot* keys - those needing more than one task - are kept: there
    are at most total output / ``rows_per_task`` of them, and the set is
    measured before it is broadcast (``bounded_broadcast``).  The rows of a
    hot key's larger side are split by a hash of the row into
    ``s = ceil(n_left * n_right / rows_per_task)`` buckets (at most its rows)
    and the smaller side's rows are repeated once per bucket, so its
    output is spread over ``s`` tasks of about ``rows_per_task`` rows.  Every
    other key keeps one bucket; neither side is shuffled for the bucketing.

    Both sides are checkpointed first (shared ``spark.checkpoint.dir``), so
    the aggregates that usually feed this join are computed once and read
    twice (sizes, join) instead of recomputed from the facts.
    """
    from caremart.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(left.sparkSession)
    left = left.checkpoint(eager=True)
    right = right.checkpoint(eager=True)
    lc = left.groupBy(key).agg(F.count(F.lit(1)).alias("__nl"))
    rc = right.groupBy(key).agg(F.count(F.lit(1)).alias("__nr"))
    salts = F.least(F.greatest("__nl", "__nr"),
                    F.ceil(F.col("__nl") * F.col("__nr") / F.lit(float(rows_per_task))))
    hot = (lc.join(rc, key).select(key, salts.cast("int").alias("__salts"),
                                   (F.col("__nl") >= F.col("__nr")).alias("__split_left"))
           .where(F.col("__salts") > 1))
    hot, small = bounded_broadcast(hot)

    def salted(df: DataFrame, split: Column) -> DataFrame:
        one = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.col("__salts")).cast("int")
        at = (F.when(F.col("__salts").isNull(), F.array(F.lit(0))).when(split, F.array(one))
              .otherwise(F.sequence(F.lit(0), F.col("__salts") - 1)))
        return df.join(hot, key, "left").withColumn("__salt", F.explode(at)).drop("__salts", "__split_left")

    return (salted(left, F.col("__split_left"))
            .join(salted(right, ~F.col("__split_left")), [key, "__salt"]).drop("__salt"))


PART_BYTES = 4 << 20  # of the scanned columns' files, for a task behind ``by_key``
MOST_PARTS = 20_000  # an estimate may be far off where no files tell it


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with the rows of a key in one task; over more partitions than the session's number where Spark's
    estimate of ``df`` asks for it, so a task's rows don't grow with the table."""
    try:
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
        least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    except Exception:  # noqa: BLE001 - no JVM handle (remote session): the session's number
        return df.repartition(*keys)
    parts = -(-size // PART_BYTES)
    return df.repartition(min(parts, MOST_PARTS), *keys) if parts > least else df.repartition(*keys)
