"""The rows of the stored claims, for large source tables.

``CLAIMS_SQL`` joins in its textual order and its columns are some five times as wide as the rows they come from.
Built as it stands, every join deals out all claims so far and the layout by month deals out the wide ones.
Here the same inner joins run with the small sides first, the month's exchange carries source columns only, and the
claims' columns are computed behind it.  Exchanges get as many partitions as the largest table's files ask for, so a
task's rows stay the same whatever the size; AQE joins small ones up and splits skewed ones.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caremart.session import shuffle_parts
from caremart.sources.fixtures import CLAIMS_COLUMNS

PART_BYTES = 4 << 20  # of the largest table's files, for a task of a join before Spark joins small partitions up
ROWS_VIEW = "caremart_claim_rows"


def claim_rows(raw: Mapping[str, DataFrame]) -> DataFrame:
    """The joined source rows of all claims, with the columns that ``CLAIMS_COLUMNS`` reads."""
    line = raw["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice",
                                  "l_discount", "l_returnflag", "l_tax", "l_linestatus")
    part = raw["part"].select("p_partkey", "p_type", "p_size")
    nation = raw["nation"].select("n_nationkey", "n_name")
    members = raw["customer"].select("c_custkey", "c_nationkey", "c_mktsegment").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")).drop("c_nationkey", "n_nationkey")
    orders = raw["orders"].select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus").join(
        members, F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")
    return (line.join(part, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey")
            .join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey"))


def write_claims(raw: Mapping[str, DataFrame], files_bytes: int, write: Callable[[DataFrame], None]) -> None:
    """``write`` the claims' rows, gathered by the month of their order.

    ``rebalance`` makes few files a month and splits a month that holds much more than the others; that the rows'
    folders follow the order's month is a matter of file sizes alone, the folders come from the claim's own date.
    """
    rows = claim_rows(raw).withColumn("__month", F.year("o_orderdate") * 12 + F.month("o_orderdate")).hint("rebalance", "__month")
    rows.createOrReplaceTempView(ROWS_VIEW)
    spark = rows.sparkSession
    try:
        with shuffle_parts(spark, files_bytes, PART_BYTES):
            write(spark.sql(f"{CLAIMS_COLUMNS} from {ROWS_VIEW}"))
    finally:
        spark.catalog.dropTempView(ROWS_VIEW)
