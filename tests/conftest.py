import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from marlstone.session import session, ship

    shared = tmp_path_factory.mktemp("shared")
    s = session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": f"file://{shared}", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": f"file://{shared}/warehouse"})
    s.sparkContext.setLogLevel("ERROR")
    return ship(s)


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF
