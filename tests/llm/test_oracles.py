"""The corpus operators beside their SQL: on the smallest tables, and on rows that the tables don't have."""

import os

import numpy as np
import pytest

from tidemark.llm import queries

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


def same(spark, name, sf_dir, files):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{files}')")
    want = db.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = queries.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    key = lambda r: tuple(map(str, r))
    assert sorted([tuple(r[c] for c in columns) for r in got.collect()], key=key) == sorted(want.fetchall(), key=key)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_on_the_tables(spark, name):
    same(spark, name, SF, f"{SF}/documents.parquet")


@pytest.mark.parametrize("sizes", [{"a": 400, "b": 100, None: 25}, {"hot": 300, "b": 77, "c": 1, "é": 50}, {"only": 40}])
def test_mixtures_of_unequal_sources(spark, tmp_path, sizes):
    """Weights of 4:2:1, which repeat in a short period; such as don't, so that the whole run is scheduled; one source."""
    rows = [(-5 + 3 * k, s) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    spark.createDataFrame(rows, "doc_id long, source string").write.parquet(str(tmp_path / "documents.parquet"))
    same(spark, "op5_mixing", str(tmp_path), f"{tmp_path}/documents.parquet/*.parquet")


def test_repeats_by_windows(spark, tmp_path):
    rng = np.random.default_rng(6)
    random = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
    a, b = random(900), random(420)
    texts = [a, random(30) + a[200:] + "é" + b, b + random(10) + b, "y" * 950, None, "", a[:399], random(700), "ß" * 300, random(50) + a[100:560] + random(3) + a[100:560]]
    rows = [(i // 2, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    same(spark, "op7_repeats", str(tmp_path), f"{tmp_path}/documents.parquet/*.parquet")
