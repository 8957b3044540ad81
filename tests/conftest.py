import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from deedwork.session import Tables, build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("checkpoints"))
    session = build_session("local[8]", **{"spark.checkpoint.dir": root})
    yield session
    session.stop()


@pytest.fixture()
def tables(spark):
    return Tables(spark, SMALL)
