import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lexloom.session import local_session

    s = local_session("8", spark__sql__shuffle__partitions="4")
    yield s
    s.stop()
