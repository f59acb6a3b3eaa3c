"""The queries of the catalog against their SQL on the smallest tables, and the stream transform."""

import math

import numpy as np
import pytest

import __spark_entry__ as entry_point
from vecengine.operators.decomposition import PCA
from vecengine.plans import catalog
from vecengine.sources import tables
from vecengine.streaming.transforms import transform_stream

DIR = "/root/testdata/sf0.001"
SLOW = {"kernel_centered"}


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, (int, float)) and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-4))


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLE_SQL) - SLOW))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    r = c.execute(catalog.ORACLE_SQL[name])
    at = [[d[0] for d in r.description].index(k) for k in columns]
    want = sorted((tuple(x[i] for i in at) for x in r.fetchall()), key=str)
    got = sorted((tuple(x[k] for k in columns) for x in df.collect()), key=str)
    assert len(got) == len(want)
    assert sum(not all(map(same, x, y)) for x, y in zip(got, want, strict=True)) == 0


def test_entry(spark):
    assert entry_point.entry(spark).count() == 4000
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_stream_equals_table(spark, tmp_path):
    e = catalog.embeddings(spark, DIR)
    m = PCA(4).fit(e)
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    transform_stream(stream, m.transform, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.id: r.z for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.id: r.z for r in m.transform(e).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    with pytest.raises(ValueError):
        transform_stream(tables.checked(e), m.transform, "x", "y")


def test_neighbours_are_found_once(spark):
    """The three nearest are the first of the eight: one search for both."""
    df = catalog.QUERIES["anti_join_neighbors"](spark, DIR)
    assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
