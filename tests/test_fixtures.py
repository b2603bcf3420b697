"""Expected counts of the fixture tables at sf0.01 (FIXTURES.md section 4)."""

import os

import pytest
from pyspark.sql import functions as F

from caremart.operators import pharmacy, scd

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="sf0.01 data not present")


def test_fixture_counts(spark):
    from caremart.plans.registry import wh
    w = wh(spark, SF)
    c = w.claims
    assert c.count() == 60000 and c.select("claim_id").distinct().count() == 60000
    assert c.where(F.col("billed_amount").isNull()).count() == 1222
    assert c.where(F.col("billed_amount") < 0).count() == 1187
    assert c.where(F.col("denial_reason").isNull()).count() == 9836
    fan_out = pharmacy.pharmacy_claim_detail(c, w.pharmacy_claims).agg(F.sum("claim_matches")).first()[0]
    assert fan_out == 654070
    assert w.eligibility.count() == 1350 and w.eligibility_updates.count() == 450
    cur = scd.scd2_init(w.eligibility)
    changed = scd.scd2_changes(cur, w.eligibility_updates)
    assert changed.count() == 96
    out = scd.scd2_apply(cur, w.eligibility_updates, as_of="2002-01-01")
    assert out.count() == 1596 and out.where("is_current_record").count() == 1500
    assert out.where(F.col("change_reason") == "New Enrollment").count() == 150
    assert w.provider_updates.count() == 20
    assert scd.affected_rows(w.providers, w.provider_updates).count() == 10
    assert scd.scd1_upsert(w.providers, w.provider_updates).count() == 110
