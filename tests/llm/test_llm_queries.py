"""Registered queries of the training-data operators against their DuckDB oracles, on whole tables."""

import pytest
from oracle_check import digest, duck

from tracehound.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.QUERIES) == list(range(1, 14))
    assert set(Q.ORACLES) == set(Q.QUERIES) - {"op1_toxicity", "op6_nearest", "op9_quality"}


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = Q.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(Q.ORACLES[name])
    columns = [d[0] for d in res.description]
    expected = res.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert len(rows) == len(expected)
    assert digest(df.columns, rows)[0] == digest(columns, expected)[0]
