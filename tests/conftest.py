import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from corvane.session import session

    s = session("tests", cores=4, shuffle_partitions=4)
    yield s
    s.stop()
