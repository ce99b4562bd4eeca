import re

import pytest

import __spark_entry__ as entry
from tests import oracle
from weftwork.plans import ground_queries, jobs, rule_queries, text_queries

PARTS = (text_queries.R, rule_queries.R, ground_queries.R, jobs.R)
NAMES = [n for p in PARTS for n in p.queries]


@pytest.fixture(scope="module")
def duck(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, duck, name):
    got, want = entry.queries()[name](spark, sf).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert oracle.rows(got) == oracle.rows(want)
    assert len(got)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert not [n for n in NAMES if n not in entry.oracle_sql()]


def test_plans(spark, sf):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for query in (rule_queries.priority_topk, rule_queries.capped_topn, rule_queries.quota_sample):
        assert "WindowGroupLimit" in plan(query(spark, sf))
    assert plan(rule_queries.diverse_sample(spark, sf)).count("WindowGroupLimit") >= 4  # of keys and of categories
    for query in (ground_queries.mention_join, ground_queries.intent_reply):
        assert "NestedLoop" not in plan(query(spark, sf))
    assert plan(ground_queries.intent_reply(spark, sf)).count("Exchange hashpartitioning") <= 2  # the tables' own join
    scan = plan(rule_queries.category_histogram(spark, sf))
    assert "ReadSchema: struct<lang:string>" in scan
    for name in NAMES:  # no Python on executors, but for the chunks of cooldowns and JSON arrays, whose plans are cut behind them
        if "stream" not in name and not name.startswith("job_"):
            assert not re.search("Python|Pandas|Arrow", plan(entry.queries()[name](spark, sf))), name
