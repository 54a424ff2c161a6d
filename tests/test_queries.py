"""Every query outside the subpackage llm, held against its SQL."""

import pytest

from quarryline.plans.queries import ORACLE_SQL, QUERIES
from tests.conftest import SF_DIR


def rows(names, values, columns):
    at = [names.index(c) for c in columns]
    return sorted(str(tuple(r[i] for i in at)) for r in values)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, spark, duck):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    cursor = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert rows(df.columns, df.collect(), columns) == rows(names, cursor.fetchall(), columns)


def test_sample_draws_rows_of_the_table(spark):
    drawn = QUERIES["sample_commits"](spark, SF_DIR)
    whole = QUERIES["filter_not"](spark, SF_DIR).columns
    assert drawn.columns == whole and 0 < drawn.count() < 600


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 603
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_chain_has_no_python(spark):
    plan = QUERIES["full_chain"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
