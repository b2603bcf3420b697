import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from caremart.session import get_session

    wh_dir = tempfile.mkdtemp(prefix="caremart-test-warehouse-")
    spark = get_session("local[4]", 8, app_name="caremart-tests",
                        extra={"spark.sql.warehouse.dir": wh_dir})
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="caremart-test-ckpt-"))
    yield spark
    spark.stop()


def rows(df, *cols):
    """Collected rows as tuples, sorted (order-insensitive comparisons)."""
    sel = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in sel.collect()), key=lambda t: tuple((x is None, str(x)) for x in t))
