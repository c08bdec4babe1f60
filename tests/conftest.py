from __future__ import annotations

import os
import sys

import pytest

os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark():
    from batonflow.session import local_session

    os.environ["BENCH_DRIVER_MEMORY"] = "6g"
    session = local_session(4, "tests")
    yield session
    session.stop()
