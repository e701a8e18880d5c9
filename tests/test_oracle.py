"""Every registered query against its SQL on the smallest tables."""

import check
import pytest

from flowlens.plans import REGISTRY

MODELS = {n for n in REGISTRY if REGISTRY[n].sql is None}


@pytest.fixture(scope="module")
def con(sf):
    return check.duck(sf)


@pytest.mark.parametrize("name", [n for n in REGISTRY if n not in MODELS])
def test_query_matches_sql(spark, con, sf, name):
    ok, text = check.compare(spark, con, name, REGISTRY[name], sf)
    assert ok, text


def test_unchecked_queries_are_few():
    assert len(MODELS) <= 12, sorted(MODELS)


def test_entry_returns_rows(spark):
    import __spark_entry__ as driver

    assert set(driver.oracle_sql()) <= set(driver.queries())
    out = driver.entry(spark)
    assert out.columns == ["protocol", "sessions", "packets", "anomalies", "anomaly_rate"] and out.count() == 3
