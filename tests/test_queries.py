"""Every query runs on the smallest tables and agrees with its SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from winnow.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
QUICK = ["turn_grouping", "rollout_turn_grouping", "token_tiers", "holdout_split", "greedy_selection", "entity_coverage", "probe_ndcg", "judge_aggregate", "tfidf_relevance", "pareto_frontier", "compaction_event_detect"]


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want = con.execute(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    rows = lambda d: sorted(map(repr, (tuple(round(float(x), 5) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in d[columns].astype(object).itertuples(index=False))))
    assert rows(want) == rows(got)
