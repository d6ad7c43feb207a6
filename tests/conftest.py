import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from cairn.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # small tables too go through several partitions, as on a cluster, where what isn't dealt alike does not meet
    session = local_session(4, "4g", **{"spark.sql.shuffle.partitions": "4", "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    yield session
    session.stop()


@pytest.fixture
def rows():
    """The rows of a DataFrame as sorted tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((x is None, str(type(x)), x) for x in t))
