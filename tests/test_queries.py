"""Every registered query of the reference's operators runs; those with SQL give DuckDB's rows."""

from __future__ import annotations

import pytest
from oracle import connection, rows

from ragspark.plans import catalog


@pytest.fixture(scope="module")
def con(data):
    return connection(data)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, con, name):
    got = catalog.QUERIES[name](spark, data).toPandas()
    if name in catalog.SQL:
        assert rows(got) == rows(con.execute(catalog.SQL[name]).fetchdf())
    else:
        assert len(got.columns) > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 40
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_optional_subpackage():
    import importlib
    import sys

    import __spark_entry__

    saved = {k: sys.modules.pop(k) for k in list(sys.modules) if k.startswith("ragspark.llm")}
    sys.modules["ragspark.llm"] = None
    try:
        bare = importlib.reload(__spark_entry__)
        assert set(bare.queries()) == set(catalog.QUERIES)
    finally:
        del sys.modules["ragspark.llm"]
        sys.modules.update(saved)
        importlib.reload(__spark_entry__)
