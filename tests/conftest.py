from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import local_session

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = local_session("8", "tests", **{"spark.local.dir": folder, "spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": f"{folder}/shared"})
    yield session
    session.stop()
