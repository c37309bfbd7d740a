import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from commsight.session import get_session

    s = get_session("local[4]", 4, app_name="commsight-tests",
                    extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="commsight-test-ckpt-")})
    yield s
    s.stop()


def rows(df, *cols):
    """Sorted list of tuples, for order-insensitive comparisons."""
    cols = cols or df.columns
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
