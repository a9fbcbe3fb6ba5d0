import pytest

from tests.compare import assert_equal
from tidemark.plans.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    if name == "resume_match":  # the smallest tables have none
        sf_dir = "/root/testdata/sf0.01"
    assert_equal(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__ as e

    assert {r["status"] for r in e.entry(spark).collect()} <= {"registered", "responding", "waiting", "closed"}
