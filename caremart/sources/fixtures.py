"""Claims-domain tables derived from the TPC-H-like test parquet files.

The claims warehouse the library targets (claims, pharmacy claims, payors,
providers, eligibility and their change sets) is not shipped as data.  Each
domain table is defined here as one SQL statement over the raw tables; the same
text runs on Spark and on DuckDB, so the oracle for every registered query can
start from identical inputs.  Every value that would be missing or malformed in
a real claims extract (nulls, ``"NULL"``, ``""``, negative amounts, odd ages, a
non-numeric member id) is planted by a rule, so the work grows with the data.
"""

from __future__ import annotations

RAW_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Only these raw tables feed the claims domain; the first two are facts (they
# grow with the data and are never broadcast).
DOMAIN_SOURCES = ("nation", "customer", "supplier", "part", "orders", "lineitem")
FACT_SOURCES = ("lineitem", "orders")


def _mdy(col: str) -> str:
    """``M/d/yyyy`` text of a timestamp column, written portably."""
    return (f"concat(cast(month({col}) as string), '/', cast(day({col}) as string), "
            f"'/', cast(year({col}) as string))")


# The claims' columns and the joins that their rows come from; the stored table is built from both apart
# (``claims_build``), with the same rows as CLAIMS_SQL.
CLAIMS_COLUMNS = f"""
select
  concat('C', cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string)) as claim_id,
  case when o_custkey % 97 = 0 then 'UNKNOWN' else cast(o_custkey as string) end as member_id,
  concat('PR', cast(l_suppkey as string)) as ProviderID,
  case when l_suppkey % 3 = 0 then 'Hospital' when l_suppkey % 3 = 1 then 'Clinic' else 'Physician' end as Provider_Type,
  n_name as State,
  case when p_type in ('ECONOMY','SMALL') then 'Inpatient' when p_type in ('MEDIUM','LARGE') then 'Outpatient' when p_type = 'PROMO' then 'Emergency' else 'Urgent Care' end as Type_of_Service,
  case when l_linenumber = 6 then {_mdy('o_orderdate')} else cast(cast(o_orderdate as date) as string) end as date_of_service,
  case when l_linenumber = 1 then 'NULL' when l_linenumber = 2 then '' when l_linenumber = 3 then null else {_mdy('o_orderdate')} end as admission_date,
  case when l_linenumber = 1 then 'NULL' when l_linenumber = 2 then '' when l_linenumber = 3 then null else {_mdy('l_shipdate')} end as discharge_date,
  case when l_linenumber = 5 then {_mdy('l_shipdate')} else 'NULL' end as readmission_date,
  case when l_linenumber = 4 then 'NULL' else {_mdy('l_shipdate')} end as paid_date,
  cast(cast(o_orderdate as date) as string) as claim_received_date,
  case when l_quantity = 1 then 0.0 when l_quantity = 2 then -l_extendedprice when l_quantity = 3 then null else l_extendedprice end as billed_amount,
  case when l_returnflag = 'R' then null else l_extendedprice * (1 - l_discount) end as paid_amount,
  case when l_tax = 0 then null else l_tax - 0.04 end as Variance,
  case when p_type in ('ECONOMY','SMALL') then cast(l_quantity as int) - 3 end as Length_of_Stay,
  case when o_custkey % 11 = 0 then null else cast(o_custkey % 130 as int) - 4 end as AGE,
  case when o_custkey % 2 = 0 then 'F' else 'M' end as Sex,
  c_mktsegment as race,
  case when l_linenumber = 5 then 1 else 0 end as readmit_indicator,
  case when l_returnflag = 'R' and l_suppkey % 2 = 0 then 'Not Covered' when l_returnflag = 'R' then 'Missing Authorization' when l_returnflag = 'A' then 'NULL' when l_suppkey % 2 = 0 then '' end as denial_reason,
  case when l_returnflag = 'R' then 'Denied' when l_linestatus = 'F' then 'Paid' else 'Pending' end as payment_status,
  case when o_orderstatus = 'F' then 'Out of Network' else 'In Network' end as Network_Status,
  case when l_suppkey % 7 = 0 then 'NULL' else concat('Facility ', cast(l_suppkey % 20 as string)) end as facility_name,
  case when p_size % 10 = 0 then null else concat('CPT', cast(p_size as string)) end as cpt_code
"""

CLAIMS_JOINS = """from lineitem
join orders on l_orderkey = o_orderkey
join customer on o_custkey = c_custkey
join nation on c_nationkey = n_nationkey
join part on l_partkey = p_partkey
"""

CLAIMS_SQL = CLAIMS_COLUMNS + CLAIMS_JOINS

PHARMACY_CLAIMS_SQL = """
select o_orderkey as claim_id, cast(o_custkey as string) as member_id,
  concat('DRUG_', cast(o_orderkey % 25 as string)) as drug_name,
  o_totalprice as billed_amount, o_totalprice * 0.8 as paid_amount,
  cast(o_orderdate as date) as fill_date
from orders
"""

PAYOR_SQL = """
select cast(c_custkey as string) as member_id, c_mktsegment as payor_type from customer
"""

_SPECIALTY = ("case when s_suppkey % 4 = 0 then 'Cardiology' when s_suppkey % 4 = 1 then 'Pediatrics' "
              "when s_suppkey % 4 = 2 then 'Orthopedics' else 'Family Medicine' end")

PROVIDERS_SQL = f"""
select cast(2000 + s_suppkey as int) as Provider_Plan_ID,
  case when s_suppkey % 17 = 5 then null else s_name end as name,
  {_SPECIALTY} as specialty,
  concat('Site ', cast(s_nationkey as string)) as practice_location,
  cast(s_suppkey % 2 as int) as is_pcp,
  concat('PR', cast(s_suppkey as string)) as provider_id,
  cast(s_suppkey as int) as ID, cast(900000000 + s_suppkey as int) as TaxID
from supplier
"""

PROVIDER_UPDATES_SQL = f"""
select cast(2000 + s_suppkey as int) as Provider_Plan_ID, concat(s_name, ' (rev)') as name,
  {_SPECIALTY} as specialty,
  concat('New Site ', cast(s_nationkey as string)) as practice_location,
  cast(s_suppkey % 2 as int) as is_pcp,
  concat('PR', cast(case when s_suppkey % 10 = 0 then s_suppkey + 1000000 else s_suppkey end as string)) as provider_id,
  cast(s_suppkey as int) as ID, cast(900000000 + s_suppkey as int) as TaxID
from supplier where s_suppkey % 5 = 0
"""

ELIGIBILITY_SQL = """
select cast(c_custkey + 1 as int) as eligibility_id, cast(c_custkey as int) as member_id,
  '1995-01-01' as eligibility_start_date,
  case when c_custkey % 3 = 0 then '1998-06-30' when c_custkey % 7 = 0 then null else '2001-12-31' end as eligibility_end_date,
  case when c_custkey % 3 = 0 then 'Terminated' else 'Active' end as eligibility_status
from customer where c_custkey % 10 <> 9
"""

ELIGIBILITY_UPDATES_SQL = """
select cast(100000 + c_custkey as int) as eligibility_id, cast(c_custkey as int) as member_id,
  '1995-01-01' as eligibility_start_date,
  case when c_custkey % 4 = 0 then '2002-12-31' when c_custkey % 3 = 0 then '1998-06-30' else '2001-12-31' end as eligibility_end_date,
  case when c_custkey % 8 = 0 then 'Suspended' when c_custkey % 3 = 0 then 'Terminated' else 'Active' end as eligibility_status
from customer where c_custkey % 5 = 0 or c_custkey % 10 = 9
"""

# A later batch: a change for each fifth member, and a second one in the other
# date layout for each tenth; some members that the first batch added change too.
ELIGIBILITY_LATER_UPDATES_SQL = """
select cast(300000 + c_custkey as int) as eligibility_id, cast(c_custkey as int) as member_id,
  '2002-03-01' as eligibility_start_date, '2004-12-31' as eligibility_end_date,
  case when c_custkey % 3 = 0 then 'Pending' else 'Active' end as eligibility_status
from customer where c_custkey % 5 = 0
union all
select cast(600000 + c_custkey as int), cast(c_custkey as int), '4/15/2003',
  case when c_custkey % 20 = 0 then null else '2005-06-30' end,
  case when c_custkey % 20 = 0 then 'Suspended' else 'Terminated' end
from customer where c_custkey % 10 = 0 or c_custkey % 50 = 9
"""

# A batch that arrives after the later one although much of it starts earlier: before
# everything that is stored, between stored versions, at a stored start (a correction
# with a greater id, and a stale row with a smaller one), and for unknown members.
ELIGIBILITY_LATE_UPDATES_SQL = """
select cast(900000 + c_custkey as int) as eligibility_id, cast(c_custkey as int) as member_id,
  '1994-03-01' as eligibility_start_date, '1994-12-31' as eligibility_end_date, 'Pending' as eligibility_status
from customer where c_custkey % 4 = 0
union all
select cast(1200000 + c_custkey as int), cast(c_custkey as int), '9/15/2002', null,
  case when c_custkey % 2 = 0 then 'Suspended' else 'Active' end
from customer where c_custkey % 5 = 0
union all
select cast(1500000 + c_custkey as int), cast(c_custkey as int), '2002-03-01', '2005-03-31', 'Active'
from customer where c_custkey % 15 = 0
union all
select cast(50000 + c_custkey as int), cast(c_custkey as int), '2002-03-01', '2001-01-31', 'Terminated'
from customer where c_custkey % 25 = 0
union all
select cast(1800000 + c_custkey as int), cast(c_custkey as int), '2001-06-01', '2003-04-14', 'Active'
from customer where c_custkey % 50 = 9
union all
select cast(2100000 + c_custkey as int), cast(5000000 + c_custkey as int),
  case when c_custkey % 60 = 0 then '2003-01-01' else '3/31/1999' end, null, 'Active'
from customer where c_custkey % 30 = 0
"""

# Surrogate-key provider dimension (type 2) and its change rows: every
# supplier is a provider valid from 1995-01-01; every fifth supplier moves to a
# new state on 1998-06-15 (new surrogate key), and a tenth of those are
# providers the dimension has never seen.
DIM_PROVIDER_SQL = """
select cast(s_suppkey as int) as provider_key,
  concat('PR', cast(s_suppkey as string)) as provider_id,
  s_name as provider_name,
  case when s_suppkey % 4 = 0 then 'Cardiology' when s_suppkey % 4 = 1 then 'Pediatrics' when s_suppkey % 4 = 2 then 'Orthopedics' else 'Family Medicine' end as specialty,
  n_name as state,
  date '1995-01-01' as start_date,
  cast(null as date) as end_date,
  true as is_current
from supplier join nation on s_nationkey = n_nationkey
"""

DIM_PROVIDER_UPDATES_SQL = """
select cast(1000000 + s_suppkey as int) as provider_key,
  concat('PR', cast(case when s_suppkey % 10 = 0 then s_suppkey + 1000000 else s_suppkey end as string)) as provider_id,
  s_name as provider_name,
  case when s_suppkey % 4 = 0 then 'Cardiology' when s_suppkey % 4 = 1 then 'Pediatrics' when s_suppkey % 4 = 2 then 'Orthopedics' else 'Family Medicine' end as specialty,
  n_name as state,
  date '1998-06-15' as start_date,
  cast(null as date) as end_date,
  true as is_current
from supplier join nation on (s_nationkey + 1) % 25 = n_nationkey
where s_suppkey % 5 = 0
"""

# Updates of the same dimension that arrive later but start earlier; some repeat what
# is in force at their start, some correct the version that starts on 1998-06-15.
DIM_PROVIDER_LATE_UPDATES_SQL = """
select cast(2000000 + s_suppkey as int) as provider_key,
  concat('PR', cast(s_suppkey as string)) as provider_id, s_name as provider_name,
  'Oncology' as specialty, n_name as state, date '1996-02-01' as start_date,
  cast(null as date) as end_date, true as is_current
from supplier join nation on s_nationkey = n_nationkey where s_suppkey % 5 <= 1
union all
select cast(3000000 + s_suppkey as int), concat('PR', cast(s_suppkey as string)), s_name,
  case when s_suppkey % 4 = 0 then 'Cardiology' when s_suppkey % 4 = 1 then 'Pediatrics' when s_suppkey % 4 = 2 then 'Orthopedics' else 'Family Medicine' end,
  n_name, case when s_suppkey % 2 = 0 then date '1994-01-01' else date '1997-01-01' end, cast(null as date), true
from supplier join nation on s_nationkey = n_nationkey where s_suppkey % 3 = 0
union all
select cast(4000000 + s_suppkey as int), concat('PR', cast(s_suppkey as string)), s_name,
  'Radiology', n_name, date '1998-06-15', cast(null as date), true
from supplier join nation on (s_nationkey + 2) % 25 = n_nationkey where s_suppkey % 15 = 0
"""

DOMAIN_SQL = {
    "claims": CLAIMS_SQL,
    "pharmacy_claims": PHARMACY_CLAIMS_SQL,
    "payor": PAYOR_SQL,
    "providers": PROVIDERS_SQL,
    "provider_updates": PROVIDER_UPDATES_SQL,
    "eligibility": ELIGIBILITY_SQL,
    "eligibility_updates": ELIGIBILITY_UPDATES_SQL,
    "eligibility_later_updates": ELIGIBILITY_LATER_UPDATES_SQL,
    "eligibility_late_updates": ELIGIBILITY_LATE_UPDATES_SQL,
    "dim_provider": DIM_PROVIDER_SQL,
    "dim_provider_updates": DIM_PROVIDER_UPDATES_SQL,
    "dim_provider_late_updates": DIM_PROVIDER_LATE_UPDATES_SQL,
}

# Names the reference's notebooks use for the same tables.
ALIASES = {"fact_pharm": "pharmacy_claims", "providerlist": "providers"}


def cte_prefix(*names: str) -> str:
    """``WITH`` clause defining the named domain tables, for oracle SQL."""
    parts = []
    for n in names:
        base = ALIASES.get(n, n)
        parts.append(f"{n} AS ({DOMAIN_SQL[base].strip()})")
    return "WITH " + ",\n".join(parts) + "\n"
