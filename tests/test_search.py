"""Searches compare vectors in blocks of bounded size, and find what comparing every pair finds."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import search
from parlance.operators.stats import top
from parlance.plans import catalogue

SF = "/root/testdata/sf0.001"
SEARCHES = ["A46_confidence", "T08_newest_first", "V03_nearest", "V03_search", "V05_intent_rerank"]


def blockwise(df):
    """Whether vectors meet in cells, not as rows of a join of all pairs."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return "FlatMapCoGroupsInArrow" in plan and "zip_with" not in plan


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(search, "ROWS", 40)
    monkeypatch.setattr(search, "QUERIES", 1)


@pytest.mark.parametrize("name", SEARCHES)
def test_searches_in_blocks_give_the_rows_of_sql(spark, small_blocks, name):
    got = catalogue.QUERIES[name](spark, SF)
    assert blockwise(got)
    con = duckdb.connect()
    for t in ("embeddings", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(SF, t)}.parquet'")
    want = con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(want.fetchall())


def brute(c, queries, k):
    rows = c.join(queries, "upload_id").withColumn("similarity", F.round(search.cosine(F.col("embedding"), F.col("query")), 5))
    return top(rows, ["query_id"], k, F.desc("similarity"), "upload_id", "chunk_index").drop("embedding", "query")


def test_nearest_finds_what_all_pairs_find(spark, small_blocks):
    """Copies, near copies, equal rounded cosines, no vector, null in one, other lengths, conversations of one side only."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 6))
    rows = []
    for i in range(300):
        v = base[i % 12] + (0 if i % 3 == 0 else 3e-6 if i % 3 == 1 else 0.3) * rng.normal(size=6)
        vector = None if i % 41 == 0 else [*map(float, v[:3])] if i % 37 == 0 else [None, *map(float, v[1:])] if i % 43 == 0 else [] if i % 47 == 0 else [*map(float, v)]
        rows.append((i, None if i % 53 == 0 else i % 4, (i * 7) % 300, f"x{i}", vector))
    c = spark.createDataFrame(rows, "vec_id long, upload_id long, chunk_index int, note string, embedding array<float>")
    asked = [(i, u, [*map(float, base[i % 12] * 2)] if i % 5 else [1.0, 2.0, 3.0] if i % 2 else None, -i) for i, u in enumerate([0, 1, 2, 2, 2, 0, 9, None, 1, 2, 2])]
    queries = spark.createDataFrame(asked, "query_id int, upload_id long, query array<double>, own int")
    for k in (1, 7, 500):
        got, want = search.nearest(c, queries, k), brute(c, queries, k)
        assert sorted(got.columns) == sorted(want.columns) and blockwise(got)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(got.columns).collect()))


def test_nearest_takes_vectors_of_zeros(spark):
    """They have no direction: NaN, the largest, as in SQL; the search does not fail by them."""
    c = spark.createDataFrame([(0, 0, [1.0, 0.0]), (0, 1, [0.0, 0.0]), (0, 2, [1.0, 1.0])], "upload_id long, chunk_index int, embedding array<float>")
    q = spark.createDataFrame([(0, 0, [1.0, 0.0])], "query_id int, upload_id long, query array<float>")
    got = search.nearest(c, q, 2).orderBy("rank").collect()
    assert [(r["chunk_index"], repr(r["similarity"])) for r in got] == [(1, "nan"), (0, "1.0")]
