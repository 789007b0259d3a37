import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))

from lexigauge.session import local_session  # noqa: E402

os.environ["LEXIGAUGE_TEST_KEY"] = "x"  # workers get what is set before the session starts


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", partitions=4)
