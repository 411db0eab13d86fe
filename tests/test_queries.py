"""Every query that has SQL gives the rows that DuckDB gives; the others give rows."""

import pytest
from oracle import SF_DIR, same

from quire.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in ORACLES:
        assert (what := same(df, con, ORACLES[name])) is None, what
    else:
        assert df.count() >= 0 and df.columns


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
