import pytest
from oracle import rows_of, same

from ledgerline import plans


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_matches_its_sql(name, spark, data):
    same(plans.QUERIES[name], plans.ORACLES[name], spark, data)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_without_sql_runs(name, spark, data):
    """Every row is made; what the rows are is held against plain versions in the tests of the operators."""
    found = plans.QUERIES[name](spark, data)
    rows = found.collect()
    assert rows and len({r.__fields__ == found.columns for r in rows}) == 1


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_partitioning_does_not_change_results(spark, data):
    """The same rows in another order and number of partitions give the same versions and thresholds."""
    from ledgerline.operators import versions

    rows = spark.read.parquet(f"{data}/lineitem.parquet").selectExpr("l_orderkey AS document", "l_linenumber", "l_partkey")
    a = versions.digest(rows, "document", ["l_linenumber", "l_partkey"], ["l_linenumber", "l_partkey"])
    b = versions.digest(rows.orderBy("l_partkey").repartition(7), "document", ["l_linenumber", "l_partkey"], ["l_linenumber", "l_partkey"])
    assert rows_of(a) == rows_of(b)
