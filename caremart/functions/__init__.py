"""Column-level functions: cleaning, dates, money, bands, predicates."""

from caremart.functions.bands import age_band, register_functions
from caremart.functions.cleaning import (
    flag,
    money_avg,
    money_sum,
    null_sentinel,
    parse_date,
    ratio,
    safe_double,
    safe_long,
)
from caremart.functions.predicates import (
    apply_filters,
    filter_keys,
    in_date_range,
    rewrite_by_key,
    to_date_value,
    update_where,
)

__all__ = [
    "age_band", "register_functions", "flag", "money_avg", "money_sum", "null_sentinel",
    "parse_date", "ratio", "safe_double", "safe_long", "apply_filters", "filter_keys",
    "in_date_range", "rewrite_by_key", "to_date_value", "update_where",
]
