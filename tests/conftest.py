import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lodestrata.session import session

    conf = {"spark.driver.memory": "6g", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")), "spark.ui.showConsoleProgress": "false"}
    s = session("local[8]", 8, **conf)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
