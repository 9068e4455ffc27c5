import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from orderlark.session import local_session, shared_root  # noqa: E402

SF = "/root/testdata/sf0.01"
SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(app="orderlark-tests")
    shared_root(session)
    yield session
    session.stop()


@pytest.fixture
def forced_skew(spark):
    """Treat every key above a few rows as heavy, so the second way is taken."""
    from orderlark.operators.skew import GROUP_ROWS_CONF

    spark.conf.set(GROUP_ROWS_CONF, "10")
    yield
    spark.conf.unset(GROUP_ROWS_CONF)


def rows_of(df, digits=6):
    """Rows as sorted tuples with floats rounded, for order-free comparison."""

    def norm(v):
        if isinstance(v, float):
            return round(v, digits)
        if isinstance(v, list):
            return tuple(norm(x) for x in v)
        return v

    cols = sorted(df.columns)
    return sorted((tuple(norm(r[c]) for c in cols) for r in df.select(*cols).collect()), key=repr)
