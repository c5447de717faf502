import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from assayer.plans.catalog import Catalog  # noqa: E402
from assayer.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    yield session
    session.stop()


@pytest.fixture
def people(spark):
    """Two null names, one null id, a duplicate id."""
    return spark.createDataFrame(
        [(1, "ann", 10.0), (2, None, 20.0), (2, "bob", None), (None, None, 40.0)], "id bigint, name string, amount double"
    )


@pytest.fixture
def catalog(spark, people):
    return Catalog(spark, {"people": people, "nobody": people.where("id > 99")})


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r])


def plan_of(df) -> str:
    """The formatted physical plan as text."""
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()
