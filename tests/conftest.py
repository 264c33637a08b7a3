import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("TZ", "UTC")

from directed_extract.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", "4g", **{"spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4"})
    yield s
    s.stop()


@pytest.fixture
def rows():
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
