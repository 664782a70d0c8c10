import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from infrarisk.session import ensure_checkpoint_dir, get_spark, importable

    s = get_spark("local[4]", app="infrarisk-tests", shuffle_partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(importable(s))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def example_request(spark):
    """The modelled service's example request (fixed values), as one nested record."""
    import datetime as dt

    from infrarisk.schema import REQUEST

    row = ("Metrovale", dt.datetime(2026, 2, 25, 18, 0, 0),
           (41.3, 48.0, True, 12.4), (91.2, 97.5, 18.6, 27.0), (34.2, 31.5, 5), (82.1, 9), 13800.0)
    return spark.createDataFrame([row], REQUEST)
