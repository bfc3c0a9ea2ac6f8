import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from checks.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4)


@pytest.fixture(scope="session")
def files(spark):
    """files({path: text}) -> files frame."""
    from pyspark.sql import functions as F

    from ravelin.sources.files import from_table

    def build(texts):
        df = spark.createDataFrame(list(texts.items()), "p string, t string")
        return from_table(df, F.col("p"), F.col("t"))

    return build


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())
