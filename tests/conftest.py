import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from inkloom.session import session

    s = session("tests", "4", **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false", "spark.sql.warehouse.dir": "/tmp/inkloom-warehouse"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
