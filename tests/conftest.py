import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark():
    from fathom.session import local_session

    session = local_session(cpus=8, shuffle_partitions=8, memory="6g", **{"spark.checkpoint.dir": "/tmp/checkpoints"})
    yield session
    session.stop()
