"""The registered queries and the pipeline on the smallest tables."""

import duckdb
import pytest
from check import TABLES, canonical
from test_near_dedup import brute_kept

import corpus_pipeline
from matloom.llm import decontaminate, secret_scan
from matloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = canonical([tuple(r) for r in df.select(*cols).collect()])
    assert got == canonical(db.sql(ORACLES[name]).select(*[f'"{c}"' for c in cols]).fetchall())


def test_stages(spark, ws):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at, columns = docs, docs.columns
    ids = lambda df: [r[0] for r in df.select("doc_id").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before, at = at, ws.save(stage(spark, at, SF)).df
        if name == "near_dedup":
            assert sorted(ids(at)) == brute_kept([tuple(r) for r in before.select("doc_id", "text").collect()])
        if name == "decontamination":
            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            leaked = {r[0] for r in decontaminate.find_leaks(before, bench).select("doc_id").collect()}
            assert leaked and set(ids(at)) == set(ids(before)) - leaked
        if name == "secret_scan":
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            assert sorted(ids(at)) == sorted(ids(before))
            assert secret_scan.find_secrets(at, labels).where("n_assign + n_access + n_hex > 0").count() == 0
        if name != "packing":
            assert at.columns == columns
        else:
            assert set(ids(at)) == set(ids(before))
