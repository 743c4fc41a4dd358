"""Every registered query with a SQL twin gives the same whole result."""

import pytest

import __spark_entry__ as entry
from oracle_check import compare, duck

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", list(SQL))
def test_same_rows(spark, con, sf, name):
    ok, note = compare(spark, con, sf, entry.queries()[name], SQL[name])
    assert ok, note


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["nome", "preco_medio", "desvio_padrao", "total_jogos"]
    assert df.count() == 31


def test_every_query_names_what_it_covers():
    from acervo.plans.registry import ENTRIES

    assert all(e.covers for e in ENTRIES.values())
