from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caremart.operators import pharmacy
from tests.conftest import rows

members = st.sampled_from(["1", "2", "3", "x", None, "02"])


@settings(max_examples=8, deadline=None)
@given(claims=st.lists(st.tuples(members, st.sampled_from(["PR1", "PR2"])), max_size=12),
       fills=st.lists(st.tuples(st.integers(1, 5), members, st.sampled_from(["D1", "D2"]),
                                st.sampled_from([10.25, 3.5, 100.0])), max_size=12))
def test_preaggregated_equals_row_level_join(spark, claims, fills):
    c = spark.createDataFrame(claims, "member_id string, ProviderID string")
    p = (spark.createDataFrame(fills, "claim_id int, member_id string, drug_name string, billed_amount double")
         .withColumn("paid_amount", F.col("billed_amount") * 0.5)
         .withColumn("fill_date", F.to_date(F.lit("1996-01-01"))))
    j = pharmacy.join_on_member(c, p.withColumnRenamed("member_id", "p_member"), "member_id", "p_member")
    brute = j.groupBy(c["member_id"], "drug_name").agg(F.count(F.lit(1)).alias("DrugCount"))
    assert rows(pharmacy.member_drug_counts(c, p)) == rows(brute)
    brute_m = (j.groupBy(F.col("__member_key").alias("member_id"), "claim_id", "drug_name", "fill_date")
               .agg(F.count(F.lit(1)).alias("claim_count"),
                    F.round(F.sum("billed_amount"), 2).alias("total_billed")))
    fast = pharmacy.pharmacy_monthly_totals(c, p).select("member_id", "claim_id", "drug_name",
                                                         "claim_count", "total_billed")
    assert rows(fast) == rows(brute_m.select("member_id", "claim_id", "drug_name", "claim_count",
                                             "total_billed"))
    detail = pharmacy.pharmacy_claim_detail(c, p)
    assert (detail.agg(F.sum("claim_matches")).first()[0] or 0) == j.count()


@settings(max_examples=6, deadline=None)
@given(claims=st.lists(st.tuples(members, st.sampled_from(["PR1", "PR2", "PR3"])), max_size=14),
       fills=st.lists(st.tuples(members, st.sampled_from(["D1", None, "D2"]), st.sampled_from(["1996-01-01", "1997-02-03"])),
                      max_size=14), n=st.integers(0, 6))
def test_limited_products_are_the_head_of_the_whole(spark, claims, fills, n):
    c = spark.createDataFrame(claims, "member_id string, ProviderID string")
    p = (spark.createDataFrame(fills, "member_id string, drug_name string, fill_date string")
         .withColumns({"fill_date": F.to_date("fill_date"), "billed_amount": F.lit(2.5), "paid_amount": F.lit(1.0)}))
    pr = spark.createDataFrame([("PR1",), ("PR2",), ("PR2",)], "provider_id string")
    py = spark.createDataFrame([("1", "B"), ("1", "A"), ("02", "A"), ("3", "C")], "member_id string, payor_type string")
    for fn, sides, width in ((pharmacy.pharmacy_provider_counts, (c, p, pr), 4),
                             (pharmacy.pharmacy_provider_payor_totals, (c, p, pr, py), 5)):
        whole = fn(*sides)
        head = whole.orderBy(*whole.columns[:width]).limit(n)
        assert [tuple(r) for r in fn(*sides, n=n).collect()] == [tuple(r) for r in head.collect()]


def test_top_k_ties_are_deterministic(spark):
    c = spark.createDataFrame([("1", "PR1", 5.0, "c1"), ("1", "PR1", 5.0, "c2"), ("2", "PR2", 9.0, "c3"),
                               ("2", "PR2", -1.0, "c4")],
                              "member_id string, ProviderID string, paid_amount double, claim_id string")
    payor = spark.createDataFrame([("1", "A"), ("2", "B")], "member_id string, payor_type string")
    top = pharmacy.top_paid_by_payor(c, payor, n=2).collect()
    assert [r.claim_id for r in top] == ["c3", "c1"]


@settings(max_examples=6, deadline=None)
@given(left=st.lists(st.tuples(st.integers(1, 3), st.integers(0, 20)), max_size=25),
       right=st.lists(st.tuples(st.integers(1, 4), st.integers(0, 20)), max_size=25),
       per_task=st.sampled_from([1, 2, 7, 1000]))
def test_spread_product_join_equals_plain_join(spark, left, right, per_task):
    from caremart.operators.joins import spread_product_join
    a = spark.createDataFrame(left, "k int, a int")
    b = spark.createDataFrame(right, "k int, b int")
    got = rows(spread_product_join(a, b, "k", rows_per_task=per_task).select("k", "a", "b"))
    assert got == rows(a.join(b, "k").select("k", "a", "b"))


def test_a_hot_key_is_split_on_its_larger_side(spark):
    from caremart.operators.joins import spread_product_join
    one = spark.createDataFrame([(1, 0)], "k int, a int")
    many = spark.range(400).select(F.lit(1).alias("k"), F.col("id").cast("int").alias("b"))
    for left, right in ((one, many), (many, one)):
        joined = spread_product_join(left, right, "k", rows_per_task=10)
        assert joined.count() == 400 and joined.select("a", "b").distinct().count() == 400
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wide = spread_product_join(one, many, "k", rows_per_task=10)
        assert wide.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
