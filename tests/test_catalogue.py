"""Every query of the catalogue against its SQL, on the smallest tables."""

import os

import pytest

from tidemark.plans import catalogue

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def shown(x):
    if isinstance(x, float):
        return f"{x:.9g}"
    return str(x)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows(spark, db, name):
    got = catalogue.queries()[name](spark, SF)
    want = db.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted(tuple(shown(r[c]) for c in columns) for r in got.collect())
    assert rows == sorted(tuple(map(shown, r)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_ann_recall(spark):
    assert catalogue.queries()["ann_recall"](spark, SF).first().recall >= 0.85


def test_policy_filter_stands_below_scoring(spark):
    plan = catalogue.queries()["retrieve_filtered"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("score") < plan.index("LeftSemi")
