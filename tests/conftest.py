import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from lexmill.session import build  # noqa: E402

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    return build("8", "tests", partitions=4)


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"
