import datetime as dt

from pyspark.sql import functions as F

from caremart.functions import (age_band, null_sentinel, parse_date, ratio, register_functions,
                                safe_long)
from caremart.functions.cleaning import money_avg, money_sum
from caremart.functions.predicates import apply_filters, filter_keys, rewrite_by_key, update_where
from tests.conftest import rows


def test_sentinels_and_dates(spark):
    df = spark.createDataFrame(
        [("1995-01-05",), ("1/5/1995",), ("12/31/2001",), ("NULL",), ("",), (None,), ("2001-02-30",),
         ("garbage",)], "t string")
    out = df.select("t", null_sentinel("t").alias("s"), parse_date("t").alias("d"),
                    parse_date("t", ["M/d/yyyy"]).alias("us")).collect()
    got = {r.t: (r.s, r.d, r.us) for r in out}
    assert got["NULL"] == (None, None, None)
    assert got[""] == (None, None, None)
    assert got["1995-01-05"][1] == dt.date(1995, 1, 5)
    assert got["1995-01-05"][2] is None
    assert got["1/5/1995"][1:] == (dt.date(1995, 1, 5), dt.date(1995, 1, 5))
    assert got["12/31/2001"][1] == dt.date(2001, 12, 31)
    assert got["2001-02-30"][1] is None and got["garbage"][1] is None


def test_safe_cast_ratio_and_exact_money(spark):
    df = spark.createDataFrame([("12", 1.1, 0), ("x", 2.2, 2), (None, None, 4)], "m string, a double, n int")
    r = df.select(safe_long("m").alias("k"), ratio("a", "n").alias("q")).collect()
    assert [x.k for x in r] == [12, None, None]
    assert [x.q for x in r] == [None, 1.1, None]
    agg = df.agg(money_sum("a").alias("s"), money_avg("a").alias("m")).first()
    assert agg.s == 3.3 and agg.m == 1.65


def test_age_bands_boundaries(spark):
    ages = [None, -1, 0, 17, 18, 34, 35, 54, 55, 64, 65, 120, 121]
    df = spark.createDataFrame([(a,) for a in ages], "AGE int")
    out = {r.AGE: r for r in df.select("AGE", *[age_band("AGE", s).alias(s) for s in
                                               ("basic", "basic_lenient", "detailed", "decade")]).collect()}
    assert out[None].basic == "Unknown" and out[None].basic_lenient == "Senior"
    assert out[None].detailed == "Unknown" and out[None].decade == "65+"
    assert out[-1].detailed == "Invalid" and out[-1].decade == "Under 18" and out[-1].basic == "Pediatric"
    assert out[121].detailed == "Invalid" and out[121].decade == "65+"
    assert out[17].detailed == "Pediatric (0-17)" and out[18].detailed == "Young Adult (18-34)"
    assert out[34].decade == "18-34" and out[35].decade == "35-54" and out[54].detailed == "Adult (35-54)"
    assert out[55].detailed == "Mature Adult (55-64)" and out[64].decade == "55-64"
    assert out[65].detailed == "Senior (65+)" and out[64].basic == "Adult" and out[65].basic == "Senior"


def test_sql_function_matches_column_function(spark):
    name = register_functions(spark, "age_group_t")
    df = spark.createDataFrame([(a,) for a in [None, -5, 3, 20, 40, 60, 70, 130]], "AGE int")
    df.createOrReplaceTempView("ages_t")
    via_sql = rows(spark.sql(f"SELECT AGE, {name}(AGE) AS g FROM ages_t"))
    via_col = rows(df.select("AGE", age_band("AGE", "detailed").alias("g")))
    assert via_sql == via_col


def test_filters_and_rewrites(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y"), ("c", 9, None)], "k string, v int, s string")
    assert rows(apply_filters(df, {"v": {"min": 0, "max": 5}}), "k") == [("a",), ("b",)]
    assert rows(apply_filters(df, {"k": ["a", "c"], "v": {"min": 2}}), "k") == [("c",)]
    assert rows(apply_filters(df, {"s": "x"}), "k") == [("a",)]
    keys = spark.createDataFrame([("b",), ("c",)], "k string")
    assert rows(filter_keys(df, "k", keys), "k") == [("b",), ("c",)]
    assert rows(filter_keys(df, "k", ["a"], keep=False), "k") == [("b",), ("c",)]
    m = spark.createDataFrame([("a", None), ("c", "z")], "k string, s string")
    assert rows(rewrite_by_key(df, "k", "s", m)) == [("a", 1, None), ("b", 5, "y"), ("c", 9, "z")]
    assert rows(rewrite_by_key(df, "k", "s", {"b": "q"}), "s") == [("q",), ("x",), (None,)]
    upd = update_where(df, F.col("v") > 4, {"s": "big", "v": 0})
    assert rows(upd) == [("a", 1, "x"), ("b", 0, "big"), ("c", 0, "big")]


def test_bounded_broadcast_measures_real_bytes(spark):
    from caremart.operators.joins import bounded_broadcast, measured_bytes
    small = spark.range(100).withColumn("s", F.lit("x"))
    assert bounded_broadcast(small)[1] is True
    # 2,000 rows of 10 kB text: ~20 MB although the schema estimate is ~56 kB
    big = spark.range(2000).withColumn("s", F.repeat(F.lit("y"), 10000))
    assert measured_bytes(big) > 20_000_000
    frame, broadcast = bounded_broadcast(big)
    assert broadcast is False and frame.count() == 2000


def test_amounts_below_a_ten_thousandth_add_up(spark):
    small = spark.range(10_000).select(F.lit(0.00004).alias("x"))
    assert rows(small.agg(money_sum("x"), money_avg("x"))) == [(0.4, 0.00004)]
    large = spark.createDataFrame([(3e14,), (4e14,)], "x double")
    assert rows(large.agg(money_sum("x"))) == [(7e14,)]
