"""The registered queries on the smallest tables: SQL where there is some, else brute force."""

from pathlib import Path

import pytest

from gridloom.llm import queries as Q

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query_runs_on_whole_tables(name, spark, sf):
    out = Q.queries()[name](spark, sf).toPandas()
    pages, docs = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("pages", "documents"))
    if name.startswith("op6_"):
        assert {"doc_id", "item_id"} <= set(out.columns)
    else:
        assert len(out) == (pages if name.startswith("op9_") else docs).count()
    sql = Q.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for p in Path(sf).glob("*.parquet"):
            con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
        want = con.sql(sql).df()
        cols = sorted(out.columns)
        as_rows = lambda x: sorted(map(tuple, x[cols].astype(str).values.tolist()))
        assert cols == sorted(want.columns) and as_rows(out) == as_rows(want)


def test_pipeline_has_its_stages():
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "benchmark_decontamination", "secret_scans", "byte_bpe"]
