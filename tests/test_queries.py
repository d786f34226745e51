"""Every query against its SQL at the smallest scale; those without SQL must give rows."""

import pytest

from tests.duck import DATA, check
from tilth.plans import registry

SF = "sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, str(DATA / SF))
    if name in registry.ORACLE_SQL:
        check(df, registry.ORACLE_SQL[name], SF)
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5 * 366
    assert set(entry.oracle_sql()) <= set(entry.queries())
