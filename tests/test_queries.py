"""Every query against its SQL on the same tables; those without SQL must at least run."""

import pytest

from heronry.plans import catalogue

from .differential import duck, rows


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_sql(spark, sf_dir, name):
    assert rows(catalogue.QUERIES[name](spark, sf_dir)) == duck(sf_dir, catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_rows(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
