import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMOKE_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from parcelscope.session import get_session
    s = get_session("local[8]", "parcelscope-tests", {"spark.sql.shuffle.partitions": "8"})
    if not s.conf.get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="parcelscope-tests-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def smoke_dir():
    if not os.path.isdir(SMOKE_DIR):
        pytest.skip("test data not present")
    return SMOKE_DIR


@pytest.fixture(scope="session")
def smoke_model(spark, smoke_dir):
    from parcelscope.sources.model import model_for
    return model_for(spark, smoke_dir)
