import pytest

import __spark_entry__ as entry
from gradewright.session import shared_folder


def test_every_query_has_its_sql():
    assert set(entry.registered.REGISTRY) <= set(entry.oracle_sql())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


class Session:
    """Stands in for a session whose cluster names a shared folder."""

    def __init__(self, value):
        self.conf = {"spark.checkpoint.dir": value}


def test_shared_folder_comes_from_the_session():
    assert shared_folder(Session("/shared/cp/"), "x") == "/shared/cp/gradewright/x"
    with pytest.raises(ValueError):
        shared_folder(Session(""), "x")
