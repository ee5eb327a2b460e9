import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
FIXTURES = os.path.join(os.path.dirname(os.path.abspath(__file__)), "fixtures")


@pytest.fixture(scope="session")
def spark():
    from docmill.session import checkpoint_dir, get_session, remove_scratch
    scratch = tempfile.mkdtemp(prefix="docmill-tests-")
    s = get_session("local[*]", 8, app_name="docmill-tests", extra={"spark.local.dir": scratch})
    checkpoint_dir(s)
    yield s
    remove_scratch(s)
    s.stop()


@pytest.fixture(scope="session")
def checkout_html():
    with open(os.path.join(FIXTURES, "checkout_like.html"), encoding="utf-8") as f:
        return f.read()


def plan_text(df) -> str:
    """The formatted physical plan, as printed by ``DataFrame.explain``."""
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()
