import pytest

from tests.helpers import SF, same
from textlathe.plans import registry


def test_every_sql_has_its_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, name):
    same(spark, name, registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows and any(x is not None for x in rows[0])


@pytest.mark.parametrize("name", ["lexical_rank", "p2_found", "link_check", "multiset_jaccard", "token_delta", "describe_stats"])
def test_plans_have_no_pairwise_join(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_scan_reads_few_columns(spark):
    plan = registry.QUERIES["cond_prob"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_returnflag:string,l_linestatus:string>" in plan
