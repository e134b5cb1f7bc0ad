"""Every query against the SQL that DuckDB answers it by."""

import decimal

import pytest

from skein.plans import catalogue


def shown(x):
    if x is None or isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float, decimal.Decimal)):
        return f"{float(x):.6f}"
    return str(x)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(shown(v[k]) for k in order) for v in values)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_agrees_with_sql(spark, oracle, small, name):
    df = catalogue.QUERIES[name](spark, small)
    got = df.collect()
    result = oracle.execute(catalogue.SQL[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, got) == rows(names, result.fetchall())


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(catalogue.QUERIES) == set(catalogue.SQL)


def test_entry_is_stable(spark):
    import __spark_entry__ as e

    assert [tuple(r) for r in e.entry(spark).collect()] == [("Customer#000000065", 67)]
    assert set(e.oracle_sql()) <= set(e.queries())
