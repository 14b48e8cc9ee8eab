import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from triagelake.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session("local[4]", app_name="triagelake-tests", shuffle_partitions=8,
                      extra={"spark.driver.memory": "4g",
                             "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint"))})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_small():
    return SF_SMALL
