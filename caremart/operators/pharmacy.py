"""Pharmacy and payor joins and reports.

Claims and pharmacy claims meet on the member: a many-to-many join whose raw
size is the sum over members of (claims x fills).  The reports only need
counts and sums over that product, so each side is aggregated to one row per
member-level group *before* the join and the measures are multiplied after it:

    COUNT(*)   over the product = n_claims(member) * n_fills(group)
    SUM(p.amt) over the product = sum_fills(group) * n_claims(member)

The join then carries aggregated rows only, and a member holding a third of
all claims costs one row on the claims side.  Where the *result* itself is a
per-member product (A24, A25: providers x fills), ``spread_product_join``
splits a hot member's output over as many tasks as its size needs.  Sums are
exact decimals, so the products equal the sums the product rows would give.

Member ids are text that may be non-numeric; the join key is
``try_cast(member_id AS BIGINT)`` on both sides and rows without a numeric key
drop out, as in the SQL the reports come from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caremart.functions.cleaning import MONEY, safe_long
from caremart.operators.joins import spread_product_join

MK = "__member_key"


def _keyed(df: DataFrame, key: str = "member_id") -> DataFrame:
    return df.withColumn(MK, safe_long(key)).where(F.col(MK).isNotNull())


def _dsum(c: str) -> Column:
    return F.sum(F.col(c).cast(MONEY))


def _money(c: Column) -> Column:
    return c.cast("double")


def claims_with_payor(claims: DataFrame, payor: DataFrame) -> DataFrame:
    """Claims joined to payor rows on equal member id (both text)."""
    p = payor.withColumnRenamed("member_id", "__payor_member")
    return claims.join(p, claims["member_id"] == p["__payor_member"], "inner").drop("__payor_member")


def join_on_member(a: DataFrame, b: DataFrame, a_key: str = "member_id",
                   b_key: str = "member_id") -> DataFrame:
    """Row-level inner join on the safe-cast member key.

    This produces the full many-to-many product; the reports below never call
    it on facts, they aggregate first.  It is the building block for callers
    that really need product rows of small inputs.
    """
    left = _keyed(a, a_key)
    right = _keyed(b, b_key).withColumnRenamed(MK, "__mk_r")
    return left.join(right, left[MK] == right["__mk_r"], "inner").drop("__mk_r")


def _claims_per_member(claims: DataFrame, by_text: bool = True) -> DataFrame:
    keys = ["member_id", MK] if by_text else [MK]
    return _keyed(claims).groupBy(*keys).agg(F.count(F.lit(1)).alias("c_n"))


def _claims_per_member_provider(claims: DataFrame, providers: DataFrame) -> DataFrame:
    """Claims counted per (member text, key, provider id), provider fan-out included."""
    c = _keyed(claims).groupBy("member_id", MK, "ProviderID").agg(F.count(F.lit(1)).alias("c_n"))
    pr = providers.groupBy("provider_id").agg(F.count(F.lit(1)).alias("pr_n"))
    return (c.join(pr, c["ProviderID"] == pr["provider_id"], "inner")
            .select("member_id", MK, "provider_id", (F.col("c_n") * F.col("pr_n")).alias("c_n")))


def member_drug_counts(claims: DataFrame, pharm: DataFrame) -> DataFrame:
    """(member, drug) -> number of claim x fill pairs; most first."""
    c = _claims_per_member(claims)
    p = _keyed(pharm).groupBy(MK, "drug_name").agg(F.count(F.lit(1)).alias("p_n"))
    return (c.join(p, MK, "inner")
            .select("member_id", "drug_name", (F.col("c_n") * F.col("p_n")).alias("DrugCount"))
            .orderBy(F.col("DrugCount").desc(), "member_id", "drug_name"))


def _first_sides(c: DataFrame, p: DataFrame, c_order: list[str], p_order: list[str],
                 n: int) -> tuple[DataFrame, DataFrame]:
    """The rows of both sides that the first ``n`` rows of their product, ordered by member first,
    can come from: the ``n`` smallest members with fills, and ``n`` rows a member on each side
    (every earlier row of a side stands in at least one earlier row of the product)."""
    def head(df: DataFrame, by: str, order: list[str]) -> DataFrame:
        at = F.row_number().over(Window.partitionBy(by).orderBy(*order))
        return df.withColumn("__at", at).where(F.col("__at") <= n).drop("__at")

    members = (c.join(p.select(MK), MK, "left_semi").select("member_id").distinct()
               .orderBy("member_id").limit(n))
    c = head(c.join(F.broadcast(members), "member_id", "left_semi"), "member_id", c_order)  # n members
    p = p.join(F.broadcast(c.select(MK).distinct()), MK, "left_semi")  # at most n keys
    return c, head(p, MK, p_order)


def pharmacy_provider_counts(claims: DataFrame, pharm: DataFrame, providers: DataFrame,
                             n: int | None = None) -> DataFrame:
    """A24 (J3): (member, drug, provider, fill date) -> pair count."""
    c = _claims_per_member_provider(claims, providers)
    p = _keyed(pharm).groupBy(MK, "drug_name", "fill_date").agg(F.count(F.lit(1)).alias("p_n"))
    if n is not None:
        c, p = _first_sides(c, p, ["provider_id"], ["drug_name", "fill_date"], n)
    out = ((spread_product_join(c, p, MK) if n is None else c.join(p, MK))
           .select("member_id", "drug_name", "provider_id", "fill_date",
                   (F.col("c_n") * F.col("p_n")).alias("DrugCount")))
    if n is not None:
        out = out.orderBy("member_id", "drug_name", "provider_id", "fill_date").limit(n)
    return out


def pharmacy_provider_payor_totals(claims: DataFrame, pharm: DataFrame, providers: DataFrame,
                                   payor: DataFrame, n: int | None = None) -> DataFrame:
    """A25 (J4): as A24 plus payor type; pharmacy billed and paid totals."""
    c = _claims_per_member_provider(claims, providers)
    py = _keyed(payor).groupBy(MK, "payor_type").agg(F.count(F.lit(1)).alias("py_n"))
    p = (_keyed(pharm).groupBy(MK, "drug_name", "fill_date")
         .agg(_dsum("billed_amount").alias("p_billed"), _dsum("paid_amount").alias("p_paid")))
    mult = F.col("c_n") * F.col("py_n")
    c = c.join(py, MK, "inner")
    if n is not None:
        c, p = _first_sides(c, p, ["provider_id", "payor_type"], ["drug_name", "fill_date"], n)
    out = ((spread_product_join(c, p, MK) if n is None else c.join(p, MK))
           .select("member_id", "drug_name", "provider_id", "fill_date", "payor_type",
                   _money(F.col("p_billed") * mult).alias("total_billed"),
                   _money(F.col("p_paid") * mult).alias("total_paid")))
    if n is not None:
        out = out.orderBy("member_id", "drug_name", "provider_id", "fill_date", "payor_type").limit(n)
    return out


def pharmacy_claim_detail(claims: DataFrame, pharm: DataFrame, n: int | None = None) -> DataFrame:
    """Pharmacy rows that match claims of the same member.

    Whole-table form: one row per distinct pharmacy row with ``claim_matches``,
    the number of times the row-level join repeats it.  With ``n`` the first
    ``n`` product rows in key order are returned instead, expanded from the
    compact rows (at most ``n`` copies each), so no product is materialised.
    """
    cols = ["claim_id", "drug_name", "billed_amount", "paid_amount", "fill_date"]
    c = _claims_per_member(claims, by_text=False)
    p = _keyed(pharm).groupBy(MK, *cols).agg(F.count(F.lit(1)).alias("p_n"))
    out = (c.join(p, MK, "inner")
           .select(F.col(MK).alias("member_id"), *cols,
                   (F.col("c_n") * F.col("p_n")).alias("claim_matches")))
    if n is None:
        return out
    order = ["member_id", "claim_id", "drug_name", "fill_date", "billed_amount", "paid_amount"]
    top = out.orderBy(*order).limit(n)
    return (top.withColumn("__copy", F.explode(F.array_repeat(
                F.lit(1), F.least(F.col("claim_matches"), F.lit(n)).cast("int"))))
            .drop("__copy", "claim_matches").orderBy(*order).limit(n))


def _monthly_groups(claims: DataFrame, pharm: DataFrame) -> DataFrame:
    c = _claims_per_member(claims, by_text=False)
    p = (_keyed(pharm).groupBy(MK, "claim_id", "drug_name", "fill_date")
         .agg(F.count(F.lit(1)).alias("p_n"),
              _dsum("billed_amount").alias("p_billed"), _dsum("paid_amount").alias("p_paid")))
    return (c.join(p, MK, "inner")
            .select(F.col(MK).alias("member_id"), "claim_id", "drug_name", "fill_date",
                    (F.col("c_n") * F.col("p_n")).alias("claim_count"),
                    (F.col("p_billed") * F.col("c_n")).alias("__billed"),
                    (F.col("p_paid") * F.col("c_n")).alias("__paid")))


def _monthly_select(df: DataFrame) -> DataFrame:
    return df.select("member_id", "claim_id", "claim_count", "drug_name",
                     _money(F.round(F.col("__billed"), 2)).alias("total_billed"),
                     _money(F.round(F.col("__paid"), 2)).alias("total_paid"),
                     F.monthname("fill_date").alias("fill_month"))


def pharmacy_monthly_totals(claims: DataFrame, pharm: DataFrame) -> DataFrame:
    """Per (member, pharmacy claim, drug, fill date): pair count, rounded
    billed and paid totals over the product, month name of the fill."""
    return _monthly_select(_monthly_groups(claims, pharm))


def top_drug_claim(claims: DataFrame, pharm: DataFrame, n: int = 1) -> DataFrame:
    """The A27 group(s) with the largest billed total.

    ``ROW_NUMBER() OVER (ORDER BY total DESC) = 1`` over a global order is a
    top-k: planned as ``TakeOrderedAndProject``, each task keeps its own best
    ``n`` rows and the driver merges ``n`` per task.  Ties go to the smaller
    member, claim, drug and fill date.
    """
    g = _monthly_groups(claims, pharm)
    top = g.orderBy(F.col("__billed").desc(), "member_id", "claim_id", "drug_name", "fill_date").limit(n)
    return _monthly_select(top)


def top_paid_by_payor(claims: DataFrame, payor: DataFrame, n: int = 5) -> DataFrame:
    """Distinct (claim, provider, payor type, paid) with paid > 0, top ``n`` by paid.

    Every task keeps the rows of its first ``n`` distinct ranks per payor type (a partial group limit
    before the shuffle), so the distinct and the final order see few rows.
    """
    j = claims_with_payor(claims.where(F.col("paid_amount") > 0), payor)
    best = Window.partitionBy("payor_type").orderBy(F.col("paid_amount").desc(), "claim_id", "ProviderID")
    return (j.select("claim_id", "ProviderID", "payor_type", "paid_amount").withColumn("__rank", F.dense_rank().over(best))
            .where(F.col("__rank") <= n).drop("__rank").distinct()
            .orderBy(F.col("paid_amount").desc(), "claim_id", "ProviderID", "payor_type")
            .limit(n))
