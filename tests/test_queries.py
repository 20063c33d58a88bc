import pytest
from oracle import compare

from sluice.plans.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    compare(spark, "/root/testdata/sf0.001", QUERIES[name], ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert {r["chunk_seq"] for r in __spark_entry__.entry(spark).collect()} >= {1}
    assert set(QUERIES) <= set(__spark_entry__.queries())
