"""Queries on tables of other shapes than the given ones, against their SQL."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from newsloom.plans import catalogue, checks  # noqa: E402, F401

SF = "/root/testdata/sf0.001"


def differences(spark, folder, name):
    """Rows of the query that the SQL lacks, and the other way, over a folder of tables that are files or folders of files."""
    con = duckdb.connect()
    for t in os.listdir(folder):
        path = f"{folder}/{t}"
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    df = catalogue.QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    got = {tuple(r[c] for c in columns) for r in df.collect()}
    want = set(con.sql(f"select {', '.join(columns)} from ({catalogue.ORACLE_SQL[name]})").fetchall())
    return got - want, want - got


@pytest.mark.parametrize("name", ["indexer_stream", "session_stream"])
def test_streams_read_tables_of_many_files(spark, tmp_path, name):
    for t in ("documents", "events"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(60).repartition(3).write.parquet(f"{tmp_path}/{t}.parquet")
    assert differences(spark, tmp_path, name) == (set(), set())
    assert catalogue.QUERIES[name](spark, str(tmp_path)).count() == 60


@pytest.mark.parametrize("name", ["newest_run", "promoted_order", "promoted_snapshot", "promotion_rollup", "stored_runs", "trending_topics"])
def test_days_of_times_near_midnight(spark, tmp_path, name):
    """Every event moves to the end of its day, some to its last half second, which the SQL counts to the next one."""
    for t in ("documents", "embeddings"):
        os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    con = duckdb.connect()
    con.sql(f"""copy (select * replace (date_trunc('day', ts) + to_microseconds(86400000000 - 1 - event_id * 79190 % 1000000) as ts, user_id % 50 as user_id)
    from '{SF}/events.parquet') to '{tmp_path}/events.parquet' (format parquet)""")
    assert differences(spark, tmp_path, name) == (set(), set())


def test_similarities_that_round_alike_are_ties(spark, tmp_path):
    rows = [(i, [1.0, (0.3 - i * 1e-6 if i else 0.0)]) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert differences(spark, tmp_path, "cosine_topk") == (set(), set())
