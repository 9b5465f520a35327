from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from cohortlens.session import local_session

    session = local_session("*", shuffle_partitions=8, app_name="cohortlens-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_cells(spark):
    """Clean fixture cells at sf0.001 (materialised once)."""
    from cohortlens.sources.fixture import fixture_tables

    return fixture_tables(spark, SF_SMALL)
