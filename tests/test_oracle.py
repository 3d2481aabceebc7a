"""Every query with an oracle gives the oracle's rows at sf0.01; the others run and keep a stable schema."""

import math

import pytest

from tessera.plans import registry

SF = "/root/testdata/sf0.01"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return float(value) if type(value).__name__ == "Decimal" else value


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    relation = duck.sql(SQL[name])
    assert rows(df.columns, df.collect()) == rows(relation.columns, relation.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()
