import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vicinage.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="4g", app="tests")
    session.conf.set("spark.sql.shuffle.partitions", "2")
    # tables of a few rows: compiling their plans would take most of the time
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    yield session
    session.stop()
