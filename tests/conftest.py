import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from larkspan.session import local_session

    s = local_session(4, spark__driver__memory="6g", spark__sql__shuffle__partitions="4")
    yield s
    s.stop()
