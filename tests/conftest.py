import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ventanilla.session import get_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[*]", 8, app_name="ventanilla-tests",
                    extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="ventanilla-test-ckpt-")})
    yield s
    s.stop()


def rows(df, *cols):
    """Collect the given columns as a list of tuples (small test frames only)."""
    return [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]
