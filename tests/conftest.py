import os
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]
os.environ["PYTHONPATH"] = os.pathsep.join([*sys.path[:2], os.environ.get("PYTHONPATH", "")])  # for Spark's own Python processes


@pytest.fixture(scope="session")
def spark():
    from compare import session

    s = session(cores=4, partitions=3)
    s.sparkContext.setLogLevel("ERROR")
    return s
