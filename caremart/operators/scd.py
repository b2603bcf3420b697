"""Slowly-changing dimensions.

Every operator is a pure function from frames to the next version of the
table; nothing is updated in place.  A caller persists the result with
``sources.write_table`` / ``write_path`` (a new location), which also cuts the
lineage before the next run.

Shape of one SCD2 run over a large dimension:

* the change set is reduced to one row per key and start date with
  ``max(struct(...))``, a partial aggregate, so a row repeated a million times
  costs one row per task and a key has at most one row per calendar day;
* one scan of the table gives the stored state of the batch's keys;
* the dimension is read once more and joined (left) to the changed keys to
  close rows, and the new versions and new keys are appended by name.

The change batch is checkpointed and measured once (``bounded_broadcast``);
when it fits the broadcast threshold every join against the stored table uses
it as the build side, so the table is scanned but never shuffled.  Anti-joins
("keys the table has never seen") probe the table with the batch's keys
first, so even they keep the table on the streaming side.  A batch too large
to broadcast falls back to shuffle joins, where AQE splits skewed keys.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caremart.functions.cleaning import parse_date
from caremart.functions.predicates import to_date_value
from caremart.operators.asof import as_of
from caremart.operators.joins import bounded_broadcast, bounded_like, keys_seen
from caremart.operators.timeline import Versions, closed_by, columns_of, placed, spans

# The open end date, and the change-reason labels written into
# the eligibility history.
OPEN_END = _dt.date(9999, 12, 31)
INITIAL_LOAD = "Initial Load"
NEW_ENROLLMENT = "New Enrollment"
STATUS_REASONS = (("Terminated", "Coverage Terminated"),
                  ("Active", "Coverage Activated"),
                  ("Suspended", "Coverage Suspended"))
OTHER_REASON = "Eligibility Update"

SCD2_COLUMNS = ("record_start_date", "record_end_date", "is_current_record", "change_reason",
                "version_number", "created_timestamp")
ELIGIBILITY_TRACKED = ("eligibility_status", "eligibility_start_date", "eligibility_end_date")


def _ts(as_of_ts) -> Column:
    return F.current_timestamp() if as_of_ts is None else F.lit(as_of_ts).cast("timestamp")


def scd2_init(base: DataFrame, as_of_ts=None, start_col: str = "eligibility_start_date") -> DataFrame:
    """M1: every row becomes version 1, current, valid from its start date."""
    return base.withColumns({
        "record_start_date": parse_date(start_col),
        "record_end_date": F.lit(OPEN_END),
        "is_current_record": F.lit(True),
        "change_reason": F.lit(INITIAL_LOAD),
        "version_number": F.lit(1),
        "created_timestamp": _ts(as_of_ts),
    })


def latest_per_key(changes: DataFrame, key: str | Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key (a column or several): the greatest by ``order`` (then by the whole row).

    ``max(struct(order..., row))`` is a mergeable aggregate, so Spark combines
    it inside each task before the shuffle: no window, no group held whole.
    """
    cols = changes.columns
    ranked = F.struct(*[o.alias(f"__o{i}") for i, o in enumerate(order)],
                      F.struct(*[F.col(c) for c in cols]).alias("__row"))
    keys = [key] if isinstance(key, str) else key
    return (changes.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.max(ranked).alias("__m"))
            .select(*[F.col(f"__m.__row.{c}").alias(c) for c in cols]))


def _differs(tracked: Sequence[str], left: str, right: str) -> Column:
    conds = [~F.col(f"{left}{c}").eqNullSafe(F.col(f"{right}{c}")) for c in tracked]
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def scd2_changes(current: DataFrame, changes: DataFrame, key: str = "member_id",
                 tracked: Sequence[str] = ELIGIBILITY_TRACKED,
                 current_flag: str = "is_current_record") -> DataFrame:
    """M2: change rows whose tracked values differ (null-safe) from the
    member's current row."""
    cur = current.where(F.col(current_flag)).select(
        F.col(key), *[F.col(c).alias(f"__cur_{c}") for c in tracked])
    j = changes.join(cur, key, "inner")
    return j.where(_differs(tracked, "__cur_", "")).select(*changes.columns)


def change_reason(status: str | Column = "eligibility_status") -> Column:
    """M4: label of a new version from its status."""
    s = F.col(status) if isinstance(status, str) else status
    out = None
    for value, label in STATUS_REASONS:
        out = F.when(s == value, label) if out is None else out.when(s == value, label)
    return out.otherwise(OTHER_REASON)


def scd2_apply(current: DataFrame, changes: DataFrame, key: str = "member_id",
               tracked: Sequence[str] = ELIGIBILITY_TRACKED, as_of=None, as_of_ts=None,
               start_col: str = "eligibility_start_date", id_col: str | None = "eligibility_id",
               start_policy: str = "source") -> DataFrame:
    """M3: next version of an SCD2 eligibility table.

    * Changes with one key and one parsed start date are reduced to the row
      with the greatest ``id_col``; a key's other changes become successive
      versions in order of their start (a missing start first).  Each but the
      last is closed at the start of the next one.
    * A change that equals the current row, or the change before it, on
      ``tracked`` (null-safe) is none, so a batch applied twice changes nothing.
    * If changes remain, the current row is closed at ``as_of`` and versions
      from ``max(version) + 1`` on are added with a status-based reason.
      Closed history is only touched by late changes.
    * Keys whose stored rows are all closed get new versions too; nothing is
      closed for them.
    * Keys the table has never seen start with version 1, ``New Enrollment``.
    * Change rows with a null key are left out; a key with several current rows
      gets all of them closed before its new versions.
    * ``start_policy="source"`` starts a new version at the change row's own
      start date (periods of one member may then overlap, as in the source
      notebooks).  A change that starts before the current row arrives late: it
      splits the stored version in force at its start, ends where the next one
      starts, and the current row stays current.
    * ``"as_of"`` starts a version at ``as_of`` (no overlap, nothing is late; changes
      up to the last that equals the current row count as stored).
    * ``"timeline"`` places every change by its own start (``timeline``), whatever
      order the batches come in: stored versions end where the next one starts,
      ``as_of`` closes nothing, and periods neither overlap nor leave gaps.  Of
      changes with one start the greatest ``id_col`` holds, stored ones included.
    """
    if start_policy not in ("source", "as_of", "timeline"):
        raise ValueError("start_policy must be 'source', 'as_of' or 'timeline'")
    missing = [c for c in changes.columns if c not in current.columns]
    if missing:
        raise ValueError(f"change set has columns the table lacks: {missing}")
    if start_policy == "timeline":
        return _place_eligibility(current, changes, key, tracked, as_of_ts, start_col, id_col, keep_repeats=True)
    as_of_date = to_date_value(as_of) if as_of is not None else _dt.date.today()
    named = changes.where(F.col(key).isNotNull()).withColumn("__start", parse_date(start_col))
    chg, small = bounded_broadcast(
        latest_per_key(named, [key, "__start"], [F.col(id_col)] if id_col else []))

    # what the table holds of the batch's keys, from one scan: a current row, its start and tracked
    # values (least and greatest, should a key have several current rows) and the last version
    is_current = F.coalesce(F.col("is_current_record"), F.lit(False))
    held = F.when(is_current, F.struct(*tracked))
    state = (current.join(bounded_like(chg.select(key), small), key, "left_semi")
             .groupBy(key).agg(F.max(is_current).alias("__current"), F.min(held).alias("__low"),
                               F.max(held).alias("__high"), F.max("version_number").alias("__max_version"),
                               F.max(F.when(is_current, F.col("record_start_date"))).alias("__since")))
    judged, small = bounded_broadcast(chg.join(bounded_like(state, small), key, "left"))
    late = F.lit(start_policy == "source") & F.coalesce("__current", F.lit(False)) & F.coalesce(
        F.col("__start") < F.col("__since"), F.lit(False))

    # a key's changes in order of their start: those that equal what stands already are none
    steps = Window.partitionBy(key).orderBy("__start")
    stands = F.coalesce(F.col("__current"), F.lit(False))
    for c in tracked:
        for side in ("__low", "__high"):
            stands = stands & F.col(c).eqNullSafe(F.col(side).getField(c))
    values = F.struct(*tracked)
    if start_policy == "as_of":
        stored = F.max(stands).over(steps.rowsBetween(0, Window.unboundedFollowing))
    else:
        stored = stands & F.lag(F.lit(True)).over(steps).isNull()
    kept = (judged.where(~late)
            .withColumns({"__stored": stored,
                          "__same": F.coalesce(values.eqNullSafe(F.lag(values).over(steps)), F.lit(False))})
            .where(~F.col("__stored") & ~F.col("__same")))
    changed_keys = bounded_like(kept.where("__current").select(key).distinct()
                                .withColumn("__changed", F.lit(True)), small)

    # close the current row of each changed key; every other row is kept as is
    closing = F.coalesce(F.col("__changed"), F.lit(False)) & F.col("is_current_record")
    existing = (current.join(changed_keys, key, "left")
                .withColumns({"record_end_date": F.when(closing, F.lit(as_of_date))
                              .otherwise(F.col("record_end_date")),
                              "is_current_record": F.when(closing, F.lit(False))
                              .otherwise(F.col("is_current_record"))})
                .drop("__changed"))

    fresh = F.col("__current").isNull()
    own_start, next_start = F.col("__start"), F.lead("__start").over(steps)
    if start_policy == "as_of":
        own_start = F.when(fresh, own_start).otherwise(F.lit(as_of_date))
        next_start = F.when(fresh, next_start).otherwise(F.lit(as_of_date))
    nth = F.row_number().over(steps)
    last = F.lead(F.lit(True)).over(steps).isNull()
    added = kept.withColumns({
        "record_start_date": own_start,
        "record_end_date": F.when(last, F.lit(OPEN_END)).otherwise(F.coalesce(next_start, F.lit(as_of_date))),
        "is_current_record": last,
        "change_reason": F.when(fresh & (nth == 1), NEW_ENROLLMENT)
        .otherwise(change_reason("eligibility_status")),
        "version_number": (F.coalesce("__max_version", F.lit(0)) + nth).cast("int"),
        "created_timestamp": _ts(as_of_ts)})
    out = existing.select(*current.columns).unionByName(added.select(*current.columns))
    late_rows = judged.where(late).select(*changes.columns)
    if late_rows.isEmpty():  # the batch is stored: this reads no table
        return out
    return _place_eligibility(out, late_rows, key, tracked, as_of_ts, start_col, id_col, keep_repeats=False)


def _place_eligibility(current: DataFrame, changes: DataFrame, key: str, tracked: Sequence[str], as_of_ts,
                       start_col: str, id_col: str | None, keep_repeats: bool) -> DataFrame:
    """The table with ``changes`` placed among its versions by their own start."""
    kind = Versions(key, "record_start_date", "record_end_date", "is_current_record", tuple(tracked),
                    (id_col,) if id_col else tuple(tracked), OPEN_END, keep_repeats, "version_number")
    found, small = placed(current, changes, kind, parse_date(start_col), F.col("change_reason") == NEW_ENROLLMENT)
    enrolled = F.col("__led") & (F.col("change_reason") == NEW_ENROLLMENT)
    existing = closed_by(current, found, small, kind).withColumn(
        "change_reason", F.when(enrolled, change_reason("eligibility_status")).otherwise(F.col("change_reason")))
    added = (found.select(*columns_of(found, changes.columns), *[c for c in found.columns if c not in (key, "row")])
             .withColumns({**spans(found, kind), "record_start_date": parse_date(start_col),
                           "change_reason": F.when(F.col("first") & (~F.col("known") | F.col("marked")), NEW_ENROLLMENT)
                           .otherwise(change_reason("eligibility_status")),
                           "version_number": (F.coalesce("number", F.lit(0)) + F.col("nth")).cast("int"),
                           "created_timestamp": _ts(as_of_ts)}))
    return existing.select(*current.columns).unionByName(added.select(*current.columns))


def change_summary(scd2: DataFrame) -> DataFrame:
    """Rows per change reason, most first."""
    return (scd2.groupBy("change_reason").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col("change_reason")))


# -- SCD1 --------------------------------------------------------------------

def scd1_upsert(current: DataFrame, changes: DataFrame, key: str = "provider_id",
                update_columns: Sequence[str] | None = None) -> DataFrame:
    """M5: matched rows updated, unmatched change rows inserted, rest kept.

    ``update_columns=None`` replaces matched rows whole (the executed
    behaviour).  With a column list only those columns take the change row's
    value - a null included, via a match marker rather than ``coalesce`` -
    and the others keep the stored value.
    """
    # one row per key (the greatest by its values); a null key names no row and is left out
    chg, small = bounded_broadcast(latest_per_key(changes.where(F.col(key).isNotNull()), key, []))
    if update_columns is None:
        kept = current.join(chg.select(key), key, "left_anti")
        return kept.unionByName(chg.select(*current.columns))
    upd = set(update_columns)
    src = bounded_like(chg.select(*[F.col(c).alias(f"__s_{c}") for c in current.columns],
                                  F.lit(True).alias("__s_hit")), small)
    # stored rows, updated where matched (the table streams, the batch is built)
    j = current.join(src, current[key] == src[f"__s_{key}"], "left")
    kept = j.select(*[(F.when(F.col("__s_hit"), F.col(f"__s_{c}")).otherwise(F.col(c))
                       if c in upd else F.col(c)).alias(c) for c in current.columns])
    # batch rows for keys the table has never seen
    seen = bounded_like(keys_seen(current, chg, key, small), small)
    inserts = chg.join(seen, key, "left_anti").select(*current.columns)
    return kept.unionByName(inserts)


def affected_rows(df: DataFrame, changes: DataFrame, key: str = "provider_id") -> DataFrame:
    """M6: rows of ``df`` whose key appears in the change set (semi-join)."""
    chg, small = bounded_broadcast(changes.select(key))
    return df.join(chg, key, "left_semi")


def upsert_summary(before: DataFrame, after: DataFrame, changes: DataFrame,
                   key: str = "provider_id") -> DataFrame:
    """M7: one row - rows after, change rows processed, inserted, updated.

    One tagged union and one aggregation: no cross join of single-row frames
    and no counts pulled to the driver.
    """
    chg, small = bounded_broadcast(changes.select(key))
    seen = bounded_like(keys_seen(before, chg, key, small), small)
    tagged = (after.select(F.lit("after").alias("__tag"))
              .unionByName(chg.join(seen, key, "left_anti").select(F.lit("new").alias("__tag")))
              .unionByName(chg.join(seen, key, "left_semi").select(F.lit("upd").alias("__tag"))))

    def n(tag: str) -> Column:
        return F.count(F.when(F.col("__tag") == tag, 1))

    return tagged.agg(n("after").alias("total_after"),
                      (n("new") + n("upd")).alias("records_processed"),
                      n("new").alias("new_records"),
                      n("upd").alias("updated_records"))


# -- SCD2 on a surrogate-key dimension (M8, M9) -------------------------------

def scd2_apply_dim(dim: DataFrame, updates: DataFrame, natural_key: str = "provider_id",
                   start: str = "start_date", end: str = "end_date", current: str = "is_current",
                   surrogate_key: str = "provider_key", keep_repeats: bool = False) -> DataFrame:
    """M8: apply new versions to a dimension with surrogate keys.

    Update rows carry their own surrogate key and ``start`` date.  Updates with one natural key and one
    start are reduced to the greatest surrogate key.  Each update is placed among the stored versions of
    its key by its start, also before the current one (``timeline``): the version in force there is closed
    at the update's start, the update where the next version starts; the last becomes current with an
    open (null) end.  At one start the greater surrogate key holds, so periods are never negative.  An
    update that equals the version in force at its start in all attributes (null-safe) changes nothing;
    with ``keep_repeats`` it does unless it has that version's start too, and then a batch gives the same
    periods whole or split, in any order.  Natural keys that are unknown, or have closed rows only, are
    inserted; updates with a null natural key are left out.
    """
    attrs = tuple(c for c in dim.columns if c not in (natural_key, start, end, current, surrogate_key))
    kind = Versions(natural_key, start, end, current, attrs, (surrogate_key,), None, keep_repeats)
    found, small = placed(dim, updates, kind)
    existing = closed_by(dim, found, small, kind)
    added = (found.select(*columns_of(found, updates.columns), "next_at").withColumns(spans(found, kind)))
    return existing.select(*dim.columns).unionByName(added.select(*dim.columns))


def assign_dim_key(facts: DataFrame, dim: DataFrame, fact_key: str = "provider_id",
                   fact_date: str = "claim_date", natural_key: str = "provider_id",
                   start: str = "start_date", end: str = "end_date",
                   surrogate_key: str = "provider_key", max_bytes: int | None = None) -> DataFrame:
    """M9: stamp each fact with the surrogate key valid on its date.

    Validity is half-open ``[start, end)`` with a null end meaning open, so a
    fact dated on a change day gets the new version.  Facts without a valid
    version keep a null key (left join).  A dimension within the broadcast threshold goes
    to the facts, which stay where they are; beyond it facts look their day up (``asof``), so neither
    the versions of a key nor a key with many facts make one task long.
    """
    if surrogate_key in facts.columns:
        facts = facts.drop(surrogate_key)
    return as_of(facts, dim, F.col(fact_key), F.col(fact_date), F.col(natural_key), F.col(start), F.col(end),
                 [surrogate_key], half_open=True, max_bytes=max_bytes)


# -- whole runs over committed table versions -----------------------------------

def run_scd2_versions(table, base: DataFrame, changes: DataFrame, as_of=None, keep: int = 2, **apply_args):
    """One eligibility SCD2 run on a ``VersionedTable``; returns the version it committed.

    The table is initialised from ``base`` if it has no version yet.  The run reads the version that is
    current at its start and commits the next one, or fails if another run committed meanwhile; its notes
    hold the rows by change reason.  The ``keep`` newest versions stay.
    """
    before = table.load_or_init(lambda: scd2_init(base))
    after = scd2_apply(table.read(before), changes, as_of=as_of, **apply_args)
    folder = table.stage(after)
    stored = table.spark.read.schema(after.schema).parquet(f"{table.path}/{folder}")
    notes = {r["change_reason"]: r["count"] for r in change_summary(stored).collect()}  # one row per label
    version = table.publish(folder, after.schema, before, notes)
    table.retain(keep)
    return version


def run_scd1_versions(table, changes: DataFrame, key: str = "provider_id",
                      update_columns: Sequence[str] | None = None, keep: int = 2):
    """One provider SCD1 run on a ``VersionedTable`` with at least one version.

    Returns the committed version; its notes hold the counts of M7, taken against the version before.
    """
    before = table.current()
    rows = table.read(before)
    keys, small = bounded_broadcast(changes.where(F.col(key).isNotNull()).select(key).distinct())
    seen = bounded_like(keys_seen(rows, keys, key, small), small)
    processed, new = keys.count(), keys.join(seen, key, "left_anti").count()
    version = table.write(scd1_upsert(rows, changes, key, update_columns), before,
                          {"records_processed": processed, "new_records": new, "updated_records": processed - new})
    table.retain(keep)
    return version


# -- whole runs over catalog tables ---------------------------------------------

def run_scd2(spark, target: str, base: DataFrame, changes: DataFrame, as_of=None,
             **apply_args) -> tuple[DataFrame, DataFrame]:
    """One eligibility SCD2 run against the catalog table ``target``.

    Reads ``target`` (or initialises it from ``base``), applies the change
    batch, writes the next version over ``target`` (staged, since the plan
    reads the table it replaces) and returns (stored table, change summary).
    The write also cuts the lineage, so runs chain without growing plans.
    """
    from caremart.sources.tables import load_or_init_scd2, write_table

    current = load_or_init_scd2(spark, target, base, scd2_init)
    stored = write_table(scd2_apply(current, changes, as_of=as_of, **apply_args), target)
    return stored, change_summary(stored)


def run_scd1(spark, target: str, changes: DataFrame, key: str = "provider_id",
             update_columns: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """One provider SCD1 run against the catalog table ``target``.

    Returns (stored table, upsert summary); the summary counts new keys
    against the table as it was before the run.
    """
    from caremart.sources.tables import write_table

    before = spark.table(target)
    # counted against the table as it is before the write
    keys, small = bounded_broadcast(changes.select(key))
    seen = bounded_like(keys_seen(before, keys, key, small), small)
    processed, new = keys.count(), keys.join(seen, key, "left_anti").count()
    stored = write_table(scd1_upsert(before, changes, key, update_columns), target)
    counts = {"records_processed": processed, "new_records": new, "updated_records": processed - new}
    return stored, stored.agg(F.count(F.lit(1)).alias("total_after")).withColumns(
        {name: F.lit(n).cast("long") for name, n in counts.items()})
