"""Every query against its SQL; those without SQL must run and return rows."""

from __future__ import annotations

import pytest

import oracle
from sedgework import queries as own

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connection(SF)


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query(spark, con, name):
    df = own.QUERIES[name](spark, SF)
    if name in own.SQL:
        assert oracle.difference(df, con, own.SQL[name]) == ""
    else:
        assert df.count() > 0
