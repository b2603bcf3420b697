"""Slowly-changing dimensions on hand-made tables, and against row-by-row models."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caremart.operators import quality, scd
from tests.conftest import rows

COVER = "eligibility_id int, member_id int, eligibility_start_date string, eligibility_end_date string, eligibility_status string"
OPEN = dt.date(9999, 12, 31)
RUN = "2021-09-30"


def day(text):
    return dt.date.fromisoformat(text)


def cover(spark, *facts):
    return spark.createDataFrame(list(facts), COVER)


def started(spark):
    """Two members with one version each, a third with an open end."""
    return scd.scd2_init(cover(spark, (501, 61, "2020-05-01", "2021-04-30", "Active"),
                               (502, 62, "5/1/2020", "4/30/2021", "Suspended"),
                               (503, 63, "2020-11-15", None, "Active")))


def lines(df, *more):
    return sorted(tuple(r) for r in df.select("member_id", "version_number", "eligibility_id", "record_start_date",
                                              "record_end_date", "is_current_record", *more).collect())


def test_run_closes_changed_members_and_enrols_unknown_ones(spark):
    batch = cover(spark, (611, 62, "5/1/2020", "10/31/2021", "Suspended"),  # another end
                  (612, 63, "2020-11-15", None, "Active"),  # nothing new
                  (613, 90, "2021-08-01", None, "Deferred"))
    out = scd.scd2_apply(started(spark), batch, as_of=RUN, as_of_ts="2021-09-30 08:00:00")
    assert lines(out, "change_reason") == [
        (61, 1, 501, day("2020-05-01"), OPEN, True, "Initial Load"),
        (62, 1, 502, day("2020-05-01"), day(RUN), False, "Initial Load"),
        (62, 2, 611, day("2020-05-01"), OPEN, True, "Coverage Suspended"),
        (63, 1, 503, day("2020-11-15"), OPEN, True, "Initial Load"),
        (90, 1, 613, day("2021-08-01"), OPEN, True, "New Enrollment")]
    assert {r["change_reason"]: r["count"] for r in scd.change_summary(out).collect()} == {
        "Initial Load": 3, "Coverage Suspended": 1, "New Enrollment": 1}
    at_run = scd.scd2_apply(started(spark), batch, as_of=RUN, start_policy="as_of")
    for table, overlaps in ((out, 1), (at_run, 0)):
        assert quality.period_overlaps(table, "member_id", "record_start_date", "record_end_date", "eligibility_id",
                                       half_open=True).count() == overlaps


def test_null_against_value_is_a_change_and_nothing_is_none(spark):
    table = started(spark)
    assert scd.scd2_apply(table, cover(spark, (7, 63, "2020-11-15", "2022-01-31", "Active")), as_of=RUN).count() == 4
    assert scd.scd2_apply(table, cover(spark), as_of=RUN).count() == 3
    with pytest.raises(ValueError, match="columns the table lacks"):
        scd.scd2_apply(table, cover(spark).withColumn("extra", F.lit(1)))


@pytest.mark.parametrize("policy", ["source", "as_of", "timeline"])
def test_a_batch_twice_is_the_batch_once(spark, policy):
    batch = cover(spark, (700, 61, "2021-02-01", None, "Deferred"), (701, 61, "2020-08-01", None, "Active"),
                  (702, 61, "2019-01-01", "2019-12-31", "Active"), (703, 95, "1/1/2021", None, "Active"),
                  (704, 95, "2018-06-01", None, "Terminated"))
    once = scd.scd2_apply(started(spark), batch, as_of=RUN, start_policy=policy)
    twice = scd.scd2_apply(once, batch, as_of="2021-12-31", start_policy=policy)
    assert rows(twice.drop("created_timestamp")) == rows(once.drop("created_timestamp"))


# -- changes that arrive late ---------------------------------------------------

def test_late_change_alone_and_with_the_stored_row_give_the_same_table(spark):
    """The later version stays current, the earlier one is put before it, neither is lost."""
    early, same = (812, 63, "2019-11-15", None, "Suspended"), (503, 63, "2020-11-15", None, "Active")
    want = [(63, 1, 503, day("2020-11-15"), OPEN, True), (63, 2, 812, day("2019-11-15"), day("2020-11-15"), False)]
    for batch in ([early], [early, same], [same, early]):
        for policy in ("source", "timeline"):
            out = scd.scd2_apply(started(spark), cover(spark, *batch), as_of=RUN, start_policy=policy)
            assert lines(out.where("member_id = 63")) == want


def test_late_change_splits_the_version_in_force(spark):
    table = scd.scd2_apply(started(spark), cover(spark, (820, 61, "2021-03-01", None, "Deferred")), start_policy="timeline")
    out = scd.scd2_apply(table, cover(spark, (821, 61, "10/1/2020", None, "Suspended"), (822, 61, "2021-06-01", None, "Active")),
                         start_policy="timeline")
    assert lines(out.where("member_id = 61"), "change_reason") == [
        (61, 1, 501, day("2020-05-01"), day("2020-10-01"), False, "Initial Load"),
        (61, 2, 820, day("2021-03-01"), day("2021-06-01"), False, "Eligibility Update"),
        (61, 3, 821, day("2020-10-01"), day("2021-03-01"), False, "Coverage Suspended"),
        (61, 4, 822, day("2021-06-01"), OPEN, True, "Coverage Activated")]
    # an earlier start of an enrolled member takes over the enrolment
    more = cover(spark, (830, 97, "2021-01-01", None, "Active"))
    out = scd.scd2_apply(scd.scd2_apply(table, more, start_policy="timeline"),
                         cover(spark, (831, 97, "2020-01-01", None, "Terminated")), start_policy="timeline")
    assert lines(out.where("member_id = 97"), "change_reason") == [
        (97, 1, 830, day("2021-01-01"), OPEN, True, "Coverage Activated"),
        (97, 2, 831, day("2020-01-01"), day("2021-01-01"), False, "New Enrollment")]


def model(facts, base):
    """In force by (member, start): the fact with the greatest id; each ends where the next starts."""
    holds = {}
    for i, m, start, _, status in sorted(base + facts):
        holds[m, start] = (i, status)
    out = set()
    for m in {m for m, _ in holds}:
        starts = sorted(s for k, s in holds if k == m)
        for s, e in zip(starts, [*starts[1:], None], strict=True):
            out.add((m, day(s), OPEN if e is None else day(e), *holds[m, s], e is None))
    return out


FACTS = st.lists(st.tuples(st.integers(1, 4), st.integers(1, 9), st.sampled_from(["Active", "Terminated", "Deferred"])),
                 min_size=1, max_size=10)


@settings(max_examples=6, deadline=None)
@given(facts=FACTS, cuts=st.lists(st.integers(0, 10), min_size=1, max_size=2), seed=st.randoms())
def test_any_split_in_any_order_gives_the_model(spark, facts, cuts, seed):
    base = [(m, m, "2020-05-01", None, "Active") for m in (1, 2)]
    facts = [(100 + i, m, f"2020-0{s}-01", None, status + str(i)) for i, (m, s, status) in enumerate(facts)]
    shuffled = list(facts)
    seed.shuffle(shuffled)
    bounds = [0, *sorted(min(c, len(facts)) for c in cuts), len(facts)]
    table = scd.scd2_init(cover(spark, *base))
    for a, b in zip(bounds, bounds[1:], strict=False):
        table = scd.scd2_apply(table, cover(spark, *shuffled[a:b]), start_policy="timeline").checkpoint(eager=True)
    got = table.select("member_id", "record_start_date", "record_end_date", "eligibility_id", "eligibility_status",
                       "is_current_record").collect()
    assert {tuple(r) for r in got if r["record_end_date"] > r["record_start_date"]} == model(facts, base)
    assert all(r["record_end_date"] >= r["record_start_date"] for r in got)


@settings(max_examples=5, deadline=None)
@given(batches=st.lists(st.lists(st.tuples(st.integers(1, 5), st.sampled_from([None, "2021-03-31"]),
                                           st.sampled_from(["Active", "Terminated"])), max_size=7), min_size=1, max_size=3))
def test_on_time_runs_keep_history(spark, batches):
    """Versions 1..n, the last one current, and what is closed never changes."""
    table = scd.scd2_init(cover(spark, *[(m, m, "2020-05-01", None, "Active") for m in (1, 2)]))
    for i, batch in enumerate(batches):
        before = set(rows(table.where("NOT is_current_record").drop("created_timestamp")))
        table = scd.scd2_apply(table, cover(spark, *[(50 * i + j + 9, m, "2020-05-01", e, s) for j, (m, e, s) in enumerate(batch)]),
                               as_of=f"2021-0{i + 1}-15").checkpoint(eager=True)
        assert before <= set(rows(table.where("NOT is_current_record").drop("created_timestamp")))
    versions = {}
    for m, n, *_, current in lines(table):
        versions.setdefault(m, []).append((n, current))
    for mine in versions.values():
        assert [n for n, _ in mine] == list(range(1, len(mine) + 1))
        assert [c for _, c in mine] == [False] * (len(mine) - 1) + [True]


def test_several_starts_in_one_batch(spark):
    out = scd.scd2_apply(started(spark), cover(spark, (900, 98, "2021-07-01", None, "Active"), (901, 98, "7/1/2021", None, "Terminated"),
                                               (902, 98, "2021-10-01", None, "Active"), (903, None, "2021-10-01", None, "Active")), as_of=RUN)
    assert lines(out.where("member_id IS NULL OR member_id = 98")) == [
        (98, 1, 901, day("2021-07-01"), day("2021-10-01"), False), (98, 2, 902, day("2021-10-01"), OPEN, True)]


def test_several_current_rows_and_keys_without_one(spark):
    table = scd.scd2_init(cover(spark, (1, 70, "2020-01-01", None, "Active"), (2, 70, "2020-02-01", None, "Deferred"),
                                (3, 71, "2019-01-01", "2019-06-30", "Active")))
    table = table.withColumn("is_current_record", F.col("member_id") == 70)
    out = scd.scd2_apply(table, cover(spark, (8, 70, "2021-01-01", None, "Active"), (9, 71, "2021-01-01", None, "Active")), as_of=RUN)
    assert rows(out, "member_id", "eligibility_id", "is_current_record") == [
        (70, 1, False), (70, 2, False), (70, 8, True), (71, 3, False), (71, 9, True)]


# -- type 1 ------------------------------------------------------------------------

PLAN = "provider_id string, name string, practice_location string, fee int"


def test_upsert_whole_rows_or_columns(spark):
    table = spark.createDataFrame([("X1", "Quay Clinic", "Dock 4", 10), ("X2", "Hill House", "Summit", 20), ("X3", "Old Mill", None, 30)], PLAN)
    batch = spark.createDataFrame([("X2", None, "Valley", 25), ("X5", "New Ward", "Annex", 50), ("X5", "New Ward", "Annex", 40), (None, "?", "?", 0)], PLAN)
    assert rows(scd.scd1_upsert(table, batch)) == [
        ("X1", "Quay Clinic", "Dock 4", 10), ("X2", None, "Valley", 25), ("X3", "Old Mill", None, 30), ("X5", "New Ward", "Annex", 50)]
    part = scd.scd1_upsert(table, batch, update_columns=["name"])
    assert rows(part.where("provider_id = 'X2'")) == [("X2", None, "Summit", 20)]  # a null update is applied
    counts = scd.upsert_summary(table, part, batch.where("fee IN (25, 50)")).first()
    assert tuple(counts) == (4, 2, 1, 1)
    assert rows(scd.affected_rows(table, batch), "provider_id") == [("X2",)]


# -- surrogate keys ----------------------------------------------------------------

SITE = "provider_key int, provider_id string, beds int, region string, start_date date, end_date date, is_current boolean"


def sites(spark, *facts):
    """(key, id, beds, region, start) as current rows."""
    return spark.createDataFrame([(k, i, b, r, day(s), None, True) for k, i, b, r, s in facts], SITE)


def periods(df, *ids):
    found = df.where(F.col("provider_id").isin(*ids)).select("provider_id", "start_date", "end_date", "provider_key", "is_current")
    return sorted((tuple(r) for r in found.collect()), key=lambda t: (t[0], t[1], t[3]))


def test_dimension_update_before_the_stored_version(spark):
    out = scd.scd2_apply_dim(sites(spark, (40, "S1", 12, "west", "2021-02-01")), sites(spark, (41, "S1", 9, "west", "2020-07-01")))
    assert periods(out, "S1") == [("S1", day("2020-07-01"), day("2021-02-01"), 41, False), ("S1", day("2021-02-01"), None, 40, True)]
    visits = spark.createDataFrame([(1, "S1", day("2021-02-01")), (2, "S1", day("2021-01-31")), (3, "S1", day("2020-06-30")), (4, "S9", day("2021-01-01"))],
                                   "visit int, provider_id string, claim_date date")
    assert rows(scd.assign_dim_key(visits, out), "visit", "provider_key") == [(1, 40), (2, 41), (3, None), (4, None)]


def test_dimension_batch_of_many_kinds(spark):
    dim = sites(spark, (1, "S1", 12, "west", "2019-01-01"), (2, "S2", 30, "east", "2019-01-01"))
    gone = spark.createDataFrame([(3, "S3", 5, "east", day("2018-01-01"), day("2018-12-31"), False)], SITE)
    batch = sites(spark, (10, "S1", 14, "west", "2020-03-01"), (11, "S1", 14, "west", "2020-05-01"), (12, "S1", 12, "west", "2020-08-01"),
                  (13, "S2", 30, None, "2020-01-01"), (14, "S3", 5, "east", "2020-01-01"), (15, "S4", 1, "north", "2020-02-02"),
                  (16, "S4", 2, "north", "2020-02-02"), (17, None, 1, "north", "2020-02-02"), (18, "S2", 31, "east", "2019-01-01"))
    out = scd.scd2_apply_dim(dim.union(gone), batch)
    assert periods(out, "S1", "S2", "S3", "S4") == [
        ("S1", day("2019-01-01"), day("2020-03-01"), 1, False), ("S1", day("2020-03-01"), day("2020-08-01"), 10, False),
        ("S1", day("2020-08-01"), None, 12, True),  # 11 repeats 10; 12 is the stored values come back
        ("S2", day("2019-01-01"), day("2019-01-01"), 2, False), ("S2", day("2019-01-01"), day("2020-01-01"), 18, False),
        ("S2", day("2020-01-01"), None, 13, True),
        ("S3", day("2018-01-01"), day("2018-12-31"), 3, False), ("S3", day("2020-01-01"), None, 14, True),
        ("S4", day("2020-02-02"), None, 16, True)]
    assert out.where("provider_id IS NULL").count() == 0
    for again in (batch, batch.where("provider_key % 2 = 0")):
        assert rows(scd.scd2_apply_dim(out, again)) == rows(out)


@settings(max_examples=5, deadline=None)
@given(facts=st.lists(st.tuples(st.integers(1, 3), st.integers(1, 9), st.integers(1, 3)), min_size=1, max_size=9),
       cut=st.integers(0, 9), seed=st.randoms())
def test_dimension_batches_in_any_order(spark, facts, cut, seed):
    """With repeats kept, the periods depend on the facts alone; without, what is in force each day does for one batch."""
    base = [(1, "S1", 0, "r", "2020-05-01"), (2, "S2", 0, "r", "2020-02-01")]
    facts = [(10 + i, f"S{p}", beds, "r", f"2020-0{m}-01") for i, (p, m, beds) in enumerate(facts)]
    holds = {}
    for k, p, beds, _, start in base + facts:
        holds[p, start] = (k, beds)
    shuffled = list(facts)
    seed.shuffle(shuffled)
    table = sites(spark, *base)
    for part in (shuffled[:cut], shuffled[cut:]):
        if part:
            table = scd.scd2_apply_dim(table, sites(spark, *part), keep_repeats=True).checkpoint(eager=True)
    whole = scd.scd2_apply_dim(sites(spark, *base), sites(spark, *facts))
    for out in (table, whole):
        live = [r for r in out.collect() if r["end_date"] is None or r["end_date"] > r["start_date"]]
        assert all(r["end_date"] is None or r["end_date"] >= r["start_date"] for r in out.collect())
        for month in range(1, 13):
            on = dt.date(2020, month, 15)
            for p in {p for p, _ in holds}:
                before = [s for q, s in holds if q == p and day(s) <= on]
                found = [r["beds"] for r in live if r["provider_id"] == p and r["start_date"] <= on and (r["end_date"] is None or on < r["end_date"])]
                assert found == ([holds[p, max(before)][1]] if before else [])
                assert sum(r["is_current"] for r in live if r["provider_id"] == p) == 1
