"""Reports that follow their table: mergeable states per service month.

A state row holds, for one month, one dimension value and one range of members, sums, counts and a
bitmap of the members seen.  States of different months merge by adding and or-ing, so a report over
all claims is a small aggregate of states, distinct members included and exact.  ``refresh`` compares the
files of every month with those that its state was made from and recomputes the months that differ:
new claims are added, corrected ones replace what they counted, and deleted months go.  Other months are
not read.

Bitmaps need whole numbers for members.  ``members`` numbers each member once, densely and for good; a
bitmap covers 32,768 of them, so a state's size follows the members in it, not their ids.

Both tables are ``VersionedTable`` s.  Members are committed before the states that use them, so a refresh
that breaks off leaves reports as they were, and the next one does the rest.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caremart.functions.cleaning import MONEY, ratio
from caremart.operators.enrich import enhance_claims
from caremart.session import bounded_tasks, shuffle_parts
from caremart.sources.layout import LAYOUT_COLUMNS, MONTH, YEAR
from caremart.sources.versions import Version, VersionedTable

DIMENSIONS = ("Sex", "race", "State")
KEYS = ("month", "dimension", "value", "bucket")
PART_BYTES = 8 << 20  # of the claims' files, for a task of an exchange before Spark joins small partitions up
READ_BYTES = 16 << 20  # of the claims' files that a task reads and combines per member
JOINED_BYTES = 8 << 20  # of exchanged rows up to which Spark joins small partitions up for a task that sorts them
UNDATED = 0  # the month number of claims without a readable date


def _sums() -> dict[str, Column]:
    """Sums of a state, by name; all merge by adding."""
    return {"claims": F.count(F.lit(1)), "billed": F.sum(F.col("billed_amount").cast(MONEY)),
            "billed_n": F.count("billed_amount"), "age": F.sum(F.col("AGE").cast("long")), "age_n": F.count("AGE"),
            "denials": F.sum("has_denial"), "inpatient": F.sum("is_inpatient")}


def _month() -> Column:
    return F.coalesce(F.col(YEAR) * 12 + F.col(MONTH), F.lit(UNDATED))


class ReportStates:
    """States of the claims stored by month below ``claims_path``, kept below ``state_path``."""

    def __init__(self, spark: SparkSession, claims_path: str, state_path: str):
        self.spark, self.claims_path = spark, claims_path.rstrip("/")
        self.states = VersionedTable(spark, f"{state_path.rstrip('/')}/states")
        self.members = VersionedTable(spark, f"{state_path.rstrip('/')}/members")

    def source(self) -> dict[str, str]:
        """A fingerprint of every month's files, from their names, sizes and times alone."""
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.claims_path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found: dict[str, list[str]] = {}
        files = fs.listFiles(root, True)
        while files.hasNext():
            f = files.next()
            path = f.getPath()
            if path.getName().startswith(("_", ".")):
                continue
            month, year = (p.getName().split("=")[-1] for p in (path.getParent(), path.getParent().getParent()))
            number = int(year) * 12 + int(month) if year.isdigit() and month.isdigit() else UNDATED
            found.setdefault(str(number), []).append(f"{path.getName()}:{f.getLen()}:{f.getModificationTime()}")
        return {m: hashlib.sha1("\n".join(sorted(names)).encode()).hexdigest() for m, names in found.items()}

    def refresh(self) -> tuple[Version | None, list[int]]:
        """Bring the states up to date; (their version, the months that were read)."""
        before, now = self.states.current(), self.source()
        known = before.notes if before else {}
        changed = sorted(int(m) for m in now if now[m] != known.get(m))
        stale = [*changed, *(int(m) for m in known if m not in now)]
        if not stale:
            return before, []
        parts = []
        with shuffle_parts(self.spark, self._claims_bytes(), PART_BYTES), bounded_tasks(self.spark, READ_BYTES, JOINED_BYTES):
            if before:
                parts.append(self.states.read(before).where(~F.col("month").isin(stale)))
            if changed:
                parts.append(self._compute(changed))
            rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            version = self.states.write(rows, before, now)
        self.states.retain()
        return version, changed

    def _claims_bytes(self) -> int:
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.claims_path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(root).getLength()

    def _compute(self, months: list[int]) -> DataFrame:
        """States of the claims of ``months``; a claim counts once in every dimension."""
        claims = self.spark.read.parquet(self.claims_path).withColumn("month", _month()).where(F.col("month").isin(months))
        rows = enhance_claims(claims.drop(*LAYOUT_COLUMNS))
        # combined per member and month first, so that the joins and the dimensions' expansion see few rows
        combined = rows.groupBy("month", "member_id", *DIMENSIONS).agg(*[c.alias(n) for n, c in _sums().items()])
        numbered = combined.join(self._numbers(rows.select("member_id")), "member_id", "left").drop("member_id").withColumns(
            {"bucket": F.bitmap_bucket_number("number"), "bit": F.bitmap_bit_position("number")})
        # a month's range of members lies in one task, so a state's bitmap is made once, not by every task that saw a member
        each = numbered.repartition("month", "bucket").withColumn("d", F.explode(F.array(*[
            F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in DIMENSIONS])))
        return (each.select("*", "d.dimension", "d.value").groupBy(*KEYS)
                .agg(*[F.sum(n).alias(n) for n in _sums()], F.bitmap_construct_agg("bit").alias("seen")))

    def _numbers(self, ids: DataFrame) -> DataFrame:
        """member_id, number of all members, the unknown ones among ``ids`` numbered behind the known."""
        before = self.members.current()
        known = self.members.read(before) if before else self.spark.createDataFrame([], "member_id string, number long")
        new = ids.where(F.col("member_id").isNotNull()).distinct().join(known, "member_id", "left_anti")
        # a number within a part comes from its place, the numbers before a part from one row a part
        folder = self.members.stage(new.select("member_id", F.monotonically_increasing_id().alias("at")))
        placed = self.spark.read.schema("member_id string, at long").parquet(f"{self.members.path}/{folder}")
        part = F.shiftright("at", 33)
        earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        first = known.agg(F.max("number")).first()[0]
        offsets = (placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
                   .select("part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) + F.lit(0 if first is None else first + 1)).alias("base")))
        numbers = (placed.select("member_id", part.alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("within"))
                   .join(offsets, "part").select("member_id", (F.col("base") + F.col("within")).alias("number")))
        version = self.members.write(known.unionByName(numbers), before)
        self.members.retain()
        return self.members.read(version)

    def measures(self, dimension: str) -> DataFrame:
        """The merged states of one dimension: its values, sums and distinct members."""
        states = self.states.read().where(F.col("dimension") == dimension)
        names = list(_sums())
        ranges = states.groupBy("value", "bucket").agg(*[F.sum(n).alias(n) for n in names],
                                                       F.bitmap_count(F.bitmap_or_agg("seen")).alias("members"))
        return ranges.groupBy(F.col("value").alias(dimension)).agg(*[F.sum(n).alias(n) for n in names],
                                                                   F.sum("members").alias("members"))

    def gender_report(self) -> DataFrame:
        """A8 from states."""
        return (_common(self.measures("Sex")).select("*", F.try_divide(F.col("age").cast("double"), "age_n").alias("avg_age"),
                                                            ratio("total_cost", "unique_members").alias("cost_per_member"))
                .drop(*_sums(), "members"))

    def race_report(self) -> DataFrame:
        """A9 from states."""
        return (_common(self.measures("race")).withColumn("denial_rate", ratio("denials", "claim_count"))
                .drop(*[n for n in _sums() if n != "denials"], "members")
                .orderBy(F.col("claim_count").desc(), F.col("race").asc()))

    def state_report(self) -> DataFrame:
        """A10 from states."""
        return (_common(self.measures("State")).select(
            "*", F.col("inpatient").alias("inpatient_claims"), ratio("total_cost", "unique_members").alias("cost_per_member"),
            ratio("inpatient", "claim_count").alias("inpatient_rate"))
            .drop(*_sums(), "members").orderBy(F.col("total_cost").desc(), F.col("State").asc()))


def _common(measures: DataFrame) -> DataFrame:
    total = F.col("billed").cast("double")
    return measures.select("*", F.col("claims").alias("claim_count"), F.col("members").alias("unique_members"),
                           total.alias("total_cost"), F.try_divide(total, F.col("billed_n")).alias("avg_cost_per_claim"))
