"""Registered queries against their SQL, and the pipeline stage by stage."""

import os

import duckdb
import pytest
from helpers import clashing, documents, edge_rows, prose

import corpus_pipeline
from ledgerloom.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, db, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    cursor = db.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in cursor.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == want


def test_stages_keep_the_columns_of_documents(spark, scratch):
    docs = clashing(documents(spark, [*edge_rows(), *[(100 + i, prose(200 + i, 90), "en", "ab"[i % 2]) for i in range(12)]]))
    os.makedirs(f"{scratch}/benchmark.parquet")
    bench = spark.createDataFrame([(1, " ".join(prose(203, 90).split()[:40]))], "item_id long, text string")
    bench.write.mode("overwrite").parquet(f"{scratch}/benchmark.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, scratch)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{scratch}/{name}")
        docs = spark.read.parquet(f"{scratch}/{name}")
        counts.append(docs.count())
    # 6 edge rows and 12 others pass the rules; copies of prose(1, 120) leave one; one row holds the test item
    assert counts[:3] == [18, 15, 14] and docs.where("doc_id = 103").isEmpty()
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, scratch).orderBy("start").collect()
    assert len(ids) == counts[3] and [r.doc_id for r in ids] == sorted(r.doc_id for r in ids)


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 100
