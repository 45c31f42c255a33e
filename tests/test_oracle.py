"""Every registered query against its DuckDB SQL (the driver's check)."""

import pytest

import __spark_entry__ as E
from paths import SF_CHECK, SF_SMALL
from oracle_compare import compare, duck
from shopflow.plans.catalog import QUERIES
from shopflow.plans.oracle import ORACLE_SQL

KEYS = sorted(QUERIES)


def test_every_query_has_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE_SQL) <= set(E.oracle_sql())


@pytest.fixture(scope="module")
def cons():
    return {SF_SMALL: duck(SF_SMALL), SF_CHECK: duck(SF_CHECK)}


@pytest.mark.parametrize("sf_dir", [SF_SMALL, SF_CHECK])
@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, cons, key, sf_dir):
    problems = compare(spark, key, sf_dir, E.queries(), E.oracle_sql(), cons[sf_dir])
    assert not problems, problems


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["date", "pv", "uv"]
    assert df.count() > 0


def test_buy_count_distribution_test_bounds(spark, cons):
    # SURVEY: bounds are a parameter; 5/10/20 in tests.
    from shopflow.operators import buy_count_distribution
    from shopflow.plans import catalog, oracle

    lo, label = oracle._bucket_sql((5, 10, 20))
    sql = oracle._bigint_count_if(oracle._q(
        f"SELECT {lo} AS bucket_lo, {label} AS bucket, count(*) AS users FROM u GROUP BY bucket_lo, bucket",
        oracle._PER_USER,
    ))
    got = sorted(tuple(r) for r in buy_count_distribution(catalog.actions(spark, SF_CHECK), (5, 10, 20)).collect())
    want = sorted(cons[SF_CHECK].sql(sql).fetchall())
    assert got == want and len(got) > 1
