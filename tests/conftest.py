import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from marketlens.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    import tempfile
    warehouse = tempfile.mkdtemp(prefix="ml-warehouse-")  # catalog tables of tests stay out of the repo
    return local_session("*", shuffle_partitions=8, extra={"spark.sql.warehouse.dir": warehouse})
