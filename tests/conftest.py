from __future__ import annotations

import datetime as dt
import os
import sys
import uuid

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lakemart.session import local_session, work_folder  # noqa: E402
from lakemart.sources.storage import create_database  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, partitions=4, memory="4g")


@pytest.fixture
def db(spark):
    """A fresh database below the shared folder."""
    name = f"t_{uuid.uuid4().hex[:12]}"
    create_database(spark, name, work_folder(spark, name))
    return name


@pytest.fixture
def frame(spark):
    def build(rows, schema):
        return spark.createDataFrame(rows, schema)

    return build


@pytest.fixture
def rows():
    """The rows of a frame as a sorted list of tuples."""

    def collect(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in picked.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))

    return collect


@pytest.fixture
def day():
    return lambda d, hour=0: dt.datetime(2024, 1, d, hour)
