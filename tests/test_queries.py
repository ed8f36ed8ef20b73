"""Every registered query of the library itself against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from plumbline import catalog
from plumbline.plans import search_queries


@pytest.fixture(scope="module")
def duck(sf):
    for f in os.listdir(sf):
        duckdb.sql(f"CREATE OR REPLACE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return duckdb


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(float(r[i])) if isinstance(r[i], float) else repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    if name not in catalog.oracle_sql():
        assert rows
        return
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert normal(rows, df.columns) == normal(want.fetchall(), want.columns)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "id", "score", "rank"] and df.count() > 0
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) <= set(__spark_entry__.queries())


def test_no_query_pairs_everything(spark, sf):
    for name in ("o54_o82_boilerplate_docs", "o112_dense_topk", "o113_sparse_topk"):
        plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name


def pairs_by_sql(path):
    rows = duckdb.sql(f"SELECT item_id, doc_id FROM '{path}/benchmark.parquet' b JOIN '{path}/documents.parquet' d ON contains(d.text, b.text)").fetchall()
    return sorted(rows)


@pytest.mark.parametrize("size", [search_queries.BROADCAST_BYTES, 0])
def test_cases_are_all_that_contain(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(search_queries, "BROADCAST_BYTES", size)
    items = ["short first then unquestionably", "alpha", "two words", "absent here now", None, "x " * 10_050 + "lastinnertoken end"]
    docs = ["a short first then unquestionablyglued", "alphabet of two wordsmiths", items[5] + "ing", None, "alpha"]
    for name, key, texts in (("benchmark", "item_id", items), ("documents", "doc_id", docs)):
        pq.write_table(pa.table({key: list(range(len(texts))), "text": pa.array(texts, pa.string())}), f"{tmp_path}/{name}.parquet")
    for path in (str(tmp_path), "/root/testdata/sf0.1"):
        got = sorted((r.query_id, r.id) for r in search_queries._cases(spark, path).collect())
        assert got and got == pairs_by_sql(path)
