import pytest
from pyspark.sql import functions as F

from caremart.operators import params, quality
from caremart.operators.params import InvalidArguments, check_summary_args
from tests.conftest import rows


def _claims(spark):
    data = [("1", "CA", "Inpatient", "Paid", "2024-01-05", 1500.0, 1000.0, 30, "In Network", "PR1"),
            ("2", "NY", "Outpatient", "Denied", "2024-02-10", 500.0, 0.0, 70, "In Network", "PR2"),
            ("2", "NY", "Inpatient", "Paid", "3/3/2024", 2500.0, 2000.0, 70, "Out of Network", "PR1"),
            ("3", "TX", "Emergency", "Pending", "2023-12-31", 9000.0, None, 10, "In Network", "PR3")]
    return spark.createDataFrame(data, "member_id string, State string, Type_of_Service string, "
                                       "payment_status string, date_of_service string, billed_amount double, "
                                       "paid_amount double, AGE int, Network_Status string, ProviderID string")


@pytest.mark.parametrize("args, n_errors", [
    ({"start_date": "2021-03-04", "end_date": "2021-03-04"}, 0),
    ({"start_date": "2021-3-x", "end_date": None}, 2),
    ({"start_date": "2022-05-06", "end_date": "2021-05-06"}, 1),
    ({"states": "WA"}, 1), ({"states": ["wa", 5, "ZZ", "Or"]}, 2),
    ({"min_amount": "much"}, 1), ({"min_amount": -0.01}, 1), ({"min_amount": "0"}, 0),
    ({"payment_statuses": ["Paid", "Lost", None]}, 2), ({"service_types": ("Inpatient",)}, 1),
])
def test_validator_reports_every_error(args, n_errors):
    args = {"start_date": "2021-01-01", "end_date": "2021-06-30"} | args
    if n_errors:
        with pytest.raises(InvalidArguments) as e:
            check_summary_args(**args)
        assert sum(map(len, e.value.problems.values())) == n_errors
        assert all(name in str(e.value) for name in e.value.problems)
    else:
        check_summary_args(**args)


def test_validator_normalises_and_warns():
    kw, warns = check_summary_args("2021-01-01", "2021-06-30", states=["wa", "Or"], min_amount="12.5")
    assert kw["states"] == ["WA", "OR"] and kw["min_amount"] == 12.5 and warns == []
    assert len(check_summary_args("2021-01-01", "2021-06-30", states=[])[1]) == 1
    assert len(check_summary_args("2021-01-01", "2021-06-30", min_amount=9e6)[1]) == 1


def test_summaries(spark):
    c = _claims(spark)
    q1 = rows(params.claims_by_date_range(c, "2024-01-01", "2024-12-31", min_amount=0),
              "Type_of_Service", "claim_count")
    assert q1 == [("Inpatient", 2), ("Outpatient", 1)]
    q4 = params.claims_summary(c, "2024-01-01", "2024-12-31", service_type="Inpatient", min_amount=0)
    assert rows(q4, "State", "claim_count", "avg_billed") == [("CA", 1, 1500.0), ("NY", 1, 2500.0)]
    q7 = params.grouped_summary(c, ["State"], {"billed_amount": {"min": 600, "max": 2000}})
    assert rows(q7, "State") == [("CA",)]
    params.filtered_view(c, "fv_test", "2024-01-01", "2024-12-31", states=["NY"])
    assert rows(params.view_state_totals(spark, "fv_test"), "State", "claim_count") == [("NY", 2)]
    res = params.validated_claims_summary(c, "2024-01-01", "2024-12-31", states=["ny"])
    assert rows(res, "State", "claim_count") == [("NY", 1), ("NY", 1)]


def test_named_query_keeps_identifiers_as_they_are_spelled(spark):
    plans = spark.createDataFrame([("CA", "West"), ("NY", "East")], "St string, Region string")
    cfg = {"queries": {"by_region": {"joins": ["plans ON claims.State = plans.St"],
                                     "group_by": ["plans.Region", "Network_Status"],
                                     "metrics": ["MAX(AGE) AS oldest", "COUNT(DISTINCT State)"],
                                     "order_by": "MAX(AGE) DESC, plans.Region"}}}
    out = params.run_named_query({"claims": _claims(spark), "plans": plans}, cfg, "by_region")
    assert out.columns == ["plans_Region", "Network_Status", "oldest", "count_distinct_state"]
    assert [tuple(r) for r in out.collect()] == [("East", "In Network", 70, 1), ("East", "Out of Network", 70, 1),
                                                 ("West", "In Network", 30, 1), (None, "In Network", 10, 1)]


@pytest.mark.parametrize("n", [1, 1000, 1001])
@pytest.mark.parametrize("nulls", [False, True])
def test_filter_keys_is_the_same_at_any_length(spark, n, nulls):
    from caremart.functions.predicates import filter_keys

    df = spark.createDataFrame([(0,), (1,), (None,), (5000,)], "k int")
    keys = [*range(n), *([None] if nulls else [])]
    kept = {k for k in (0, 1, 5000) if k < n}
    assert {r.k for r in filter_keys(df, "k", keys).collect()} == kept
    assert {r.k for r in filter_keys(df, "k", keys, keep=False).collect()} == {0, 1, 5000, None} - kept


def test_rewrite_by_frame_with_a_repeated_key(spark):
    from caremart.functions.predicates import rewrite_by_key

    df = spark.createDataFrame([("p", "old"), ("q", "old")], "k string, v string")
    mapping = spark.createDataFrame([("p", "a"), ("p", "b")], "k string, v string")
    assert rows(rewrite_by_key(df, "k", "v", mapping)) == [("p", "b"), ("q", "old")]


def test_quality_checks(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, "b", "y")], "id int, k string, v string")
    assert rows(quality.duplicate_keys(df, "k")) == [("a", 2)]
    assert rows(quality.missing_required(df, ["k", "v"]), "id") == [(1,)]
    assert rows(quality.value_distribution(df, "k")) == [("a", 2), ("b", 1)]


def test_period_overlaps_matches_brute_force(spark):
    import random
    rnd = random.Random(7)
    data = []
    for i in range(200):
        k = rnd.choice([1, 1, 1, 2, 3])
        s = rnd.randint(0, 30)
        e = None if rnd.random() < 0.1 else s + rnd.randint(-2, 10)
        data.append((i, k, s, e))
    df = (spark.createDataFrame(data, "id int, k int, s int, e int")
          .select("id", "k", F.date_add(F.lit("2020-01-01").cast("date"), F.col("s")).alias("start"),
                  F.date_add(F.lit("2020-01-01").cast("date"), F.col("e")).alias("end")))
    for half_open in (False, True):
        got = {r.id for r in quality.period_overlaps(df, "k", "start", "end", "id", half_open).collect()}
        want = set()
        for i, k, s, e in data:
            for j, k2, s2, e2 in data:
                reaches = e2 is None or (e2 > s if half_open else e2 >= s)
                if k2 == k and (s2 < s or (s2 == s and j < i)) and reaches:
                    want.add(i)
                    break
        assert got == want
