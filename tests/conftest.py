import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from sparkpanel.session import checkpoint_dir, get_spark
    s = get_spark("sparkpanel-tests", "local[4]", 4, {"spark.driver.memory": "4g"})
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="sp-ckpt-"))
    checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture
def tmpdir_path():
    return tempfile.mkdtemp(prefix="sp-test-")
