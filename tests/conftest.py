import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from plantscribe.session import create

    own = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = create("tests", master="local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.sql.warehouse.dir": f"{own}/warehouse", "spark.checkpoint.dir": f"{own}/shared", "spark.local.dir": f"{own}/local", "spark.ui.enabled": "false", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
