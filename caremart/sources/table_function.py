"""Claims as a SQL table function.

``claims_in(first, last, states, least)`` gives the claims of a date range, of some states, from an
amount on.  The optimiser puts its query in place of each call, with the call's own arguments: several
calls with different ranges fit into one query, each reads only its months, and no view has to be
published again between them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from caremart.sources.layout import DAY, MONTH, YEAR, has_months, with_month

FUNCTION = "claims_in"
ARGUMENTS = ("first DATE COMMENT 'earliest service day, or null', last DATE COMMENT 'latest service day, or null', "
             "states ARRAY<STRING> COMMENT 'states, or null for all', least DOUBLE COMMENT 'least billed amount, or null'")


def register_claims_function(spark: SparkSession, claims: DataFrame, name: str = FUNCTION) -> str:
    """Make the function ``name`` over ``claims`` known to SQL; returns its name.

    The relation behind it has a name of its own, so views of the caller are neither used nor replaced.
    """
    source = f"{name}_{uuid.uuid4().hex}"
    (claims if has_months(claims) else with_month(claims)).createOrReplaceTempView(source)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.table(source).schema.fields)
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}({ARGUMENTS})
        RETURNS TABLE ({columns})
        RETURN SELECT * FROM {source}
        WHERE ({name}.first IS NULL OR {YEAR} * 12 + {MONTH} >= year({name}.first) * 12 + month({name}.first))
          AND ({name}.last IS NULL OR {YEAR} * 12 + {MONTH} <= year({name}.last) * 12 + month({name}.last))
          AND ({name}.first IS NULL OR {DAY} >= {name}.first) AND ({name}.last IS NULL OR {DAY} <= {name}.last)
          AND ({name}.states IS NULL OR array_contains({name}.states, State))
          AND ({name}.least IS NULL OR billed_amount >= {name}.least)""")
    return name
