import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from echotide.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "echotide-tests")


@pytest.fixture(scope="session")
def reviews(spark):
    from echotide.plans import catalog

    return catalog.enriched(spark, SMALL)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def texts(spark, values, column="content"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, {column} string")
