"""Sources and sinks: table resolution, fixtures, previews, writes."""

from caremart.sources.fixtures import DOMAIN_SQL, cte_prefix
from caremart.sources.tables import (
    Warehouse,
    change_set,
    empty_table,
    load_or_init_scd2,
    preview,
    register_view,
    shared_path,
    table,
    write_path,
    write_table,
)

__all__ = [
    "DOMAIN_SQL", "cte_prefix", "Warehouse", "change_set", "empty_table", "load_or_init_scd2",
    "preview", "register_view", "shared_path", "table", "write_path", "write_table",
]
