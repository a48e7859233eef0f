import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gradewright.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a column on one row."""

    def run(*cols):
        row = spark.range(1).select(*cols).first()
        return row[0] if len(cols) == 1 else tuple(row)

    return run


def rows(df, *cols):
    got = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in got.collect()), key=str)
