import pytest

from compare import oracle_rows, spark_rows
from logstrata.llm import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_sql(spark, name, sf):
    d = f"/root/testdata/{sf}"
    assert spark_rows(catalogue.queries()[name](spark, d)) == oracle_rows(catalogue.oracle_sql()[name], d)
