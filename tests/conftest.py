from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from skirmish.session import build_session

    warehouse = tempfile.mkdtemp(prefix="run-warehouse-", dir="/tmp")
    s = build_session(master="local[4]", app="skirmish-tests", shuffle_partitions=4,
                      extra={"spark.sql.warehouse.dir": warehouse})
    yield s
    s.stop()
