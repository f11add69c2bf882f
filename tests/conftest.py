import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tallyjoin.session import local_session

    shared = tmp_path_factory.mktemp("shared")
    return local_session(4, **{"spark.driver.memory": "4g", "spark.sql.warehouse.dir": f"{shared}/warehouse", "spark.checkpoint.dir": f"file://{shared}/checkpoints"})
