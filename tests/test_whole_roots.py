"""Neighbourhood queries over all customers."""

from loomgraph.plans import CORE_QUERIES


def test_all_customers_are_roots(spark, small):
    n = spark.read.parquet(f"{small}/customer.parquet").count()
    assert CORE_QUERIES["khop_frontier"](spark, small).filter("hop = 0").count() == n
