import pytest

import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["group_id", "size", "members"]


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 60


@pytest.mark.parametrize("name", ["normalize_v2_gap", "duplicate_groups", "doc_jaccard_capped", "stratified_sample", "intra_sim", "knn_edges"])
def test_query_against_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    want = con.sql(entry.oracle_sql()[name])
    at = [want.columns.index(c) for c in cols]
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(repr(tuple(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i] for i in at)) for r in want.fetchall())
