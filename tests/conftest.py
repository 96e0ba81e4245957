import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quillspark.session import local_session

    session = local_session(4, memory="4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tiny():
    return TINY
