import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gatewatch.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session(master="local[4]", shuffle_partitions=4, app_name="gatewatch-tests")
    # tests only: no cluster-provided checkpoint folder, so use a scratch one
    if not s.conf.get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ckpt")))
    yield s
    s.stop()


def rows(df, *cols):
    """Collect selected columns as a list of tuples (test helper)."""
    sel = df.select(*cols) if cols else df
    return [tuple(r) for r in sel.collect()]
