"""Every query with SQL gives the same rows as it; few of them run here, all of them with FULL=1."""

import json
import os

import duckdb
import pytest

from parlance.plans import catalogue
from parlance.sources import fixtures, ingest

SF = "/root/testdata/sf0.001"
FEW = ["A03_date_stats", "A08_participants", "A12_favourite_tokens", "A21_inside_phrases", "A29_conflict_resolution", "A41_health_score", "W17_chunks", "V03_search", "X11_language", "S04_whatsapp", "S05_telegram"]


def plain(x):
    return float(f"{x:.9g}") if isinstance(x, float) else x.isoformat() if hasattr(x, "isoformat") else x


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL) if os.environ.get("FULL") else FEW)
def test_same_rows_as_sql(spark, db, name):
    got = catalogue.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = db.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == names
    a = sorted([tuple(repr(plain(r[c])) for c in names) for r in got.collect()])
    b = sorted([tuple(repr(plain(r[columns.index(c)])) for c in names) for r in want.fetchall()])
    assert a == b


def test_each_query_has_sql_or_a_reason():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


def test_exports_hold_every_message(spark):
    n = fixtures.messages_from_events(spark, SF).count()
    docs = [json.loads(r["document"]) for r in catalogue.QUERIES["K07_documents"](spark, SF).collect()]
    assert sum(len(d["messages"]) for d in docs) == n and all(len(d["messages"]) == d["meta"]["total_messages"] for d in docs)
    assert catalogue.QUERIES["S13_document_export"](spark, SF).count() == n
    two = [json.loads(r["document"]) for r in ingest.document(fixtures.messages_from_events(spark, SF), 2).collect()]
    assert [len(d["messages"]) for d in two] == [min(2, d["meta"]["total_messages"]) for d in two]
