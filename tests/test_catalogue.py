import pytest

from tests.oracle import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def known():
    from gleaner.plans import catalogue, catalogue_mail

    return catalogue.QUERIES | catalogue_mail.QUERIES, catalogue.ORACLE_SQL | catalogue_mail.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(known()[0]))
def test_query_equals_its_sql(spark, con, name):
    queries, sql = known()
    if name in sql:
        n, m, extra, missing = differences(spark, con, queries[name], sql[name], SF)
        assert n == m and not extra and not missing, (n, m, extra, missing)
    else:
        queries[name](spark, SF).collect()


def test_plans_have_no_cartesian_product(spark):
    from gleaner.plans import catalogue

    for name in ("retrieve_best_passage", "exact_duplicates", "tokenize_stats", "cluster_tfidf_labels"):
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
