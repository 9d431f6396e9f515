import os
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parents[1]}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from shutterlake.session import local_session

    with tempfile.TemporaryDirectory() as d:
        s = local_session(app="tests", cpus=4, shuffle_partitions=4, checkpoint_dir=f"file://{d}")
        s.sparkContext.setLogLevel("ERROR")
        yield s
        s.stop()


@pytest.fixture
def rows(spark):
    """Rows of tuples as a DataFrame under a schema."""
    return lambda data, schema: spark.createDataFrame(data, schema)
