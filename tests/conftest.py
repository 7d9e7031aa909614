import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from mailflow.session import build_session
    ckpt = tempfile.mkdtemp(prefix="mailflow-test-ckpt-")
    s = build_session(master="local[*]", shuffle_partitions=8,
                      extra={"spark.checkpoint.dir": ckpt,
                             "spark.driver.memory": "4g"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from mailflow.sources.fixtures import FixtureTables
    return FixtureTables(spark, SF_SMALL)


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="mailflow-test-")
