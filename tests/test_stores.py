"""Claims, commits and the vector store under several writers."""

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

from pyspark.sql import functions as F

from newsloom.sources import store
from newsloom.sources.commits import CommitLog

VECTOR = "item_id string, item_hash string, model string, published_at timestamp, title string, source_name string, embedding array<float>"


def vectors(spark, *rows, model="m"):
    return spark.createDataFrame([(i, "h", model, datetime(2024, 1, 1), "t", "s", [float(x)]) for i, x in rows], VECTOR)


def values(df):
    return {(r["item_id"], r["model"]): r["embedding"][0] for r in df.collect()}


def test_claims_of_writers_at_once_differ(spark, tmp_path):
    logs = [CommitLog(spark, str(tmp_path)) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda log: [log.claim() for _ in range(10)], logs))
    assert sorted(n for g in got for n in g) == list(range(1, 41))


def test_two_writers_that_look_at_once(spark, tmp_path):
    """Both see no claim and try the same number; the second is told so and takes the next."""
    a, b = CommitLog(spark, str(tmp_path)), CommitLog(spark, str(tmp_path))
    seen = b._names("claimed")
    b._names = lambda kind, real=b._names: seen if kind == "claimed" else real(kind)  # what b saw before a claimed
    assert (a.claim(), b.claim()) == (1, 2)
    b.publish(2)
    assert a.committed() == [2]
    a.publish(1)
    assert a.committed() == [1, 2]


def test_a_new_vector_replaces_the_old(spark, tmp_path):
    path = str(tmp_path / "v")
    store.upsert_vectors(vectors(spark, ("a", 9), ("b", 1)), path)
    store.upsert_vectors(vectors(spark, ("a", 2), ("c", 3), ("c", 3)), path)  # a smaller one, and a row twice
    store.upsert_vectors(vectors(spark, ("a", 7), model="other"), path)
    assert values(store.vectors(spark, path)) == {("a", "m"): 2.0, ("b", "m"): 1.0, ("c", "m"): 3.0, ("a", "other"): 7.0}


def test_compaction_keeps_what_comes_meanwhile(spark, tmp_path):
    path = str(tmp_path / "v")
    log = CommitLog(spark, path)
    store.upsert_vectors(vectors(spark, ("a", 1), ("b", 1)), path)
    store.upsert_vectors(vectors(spark, ("b", 2)), path)
    late = log.claim()  # a writer that began before the compaction and ends after it
    assert store.compact_vectors(spark, path) == late + 1 and log.committed() == [late + 1]
    store._write_bucketed(vectors(spark, ("a", 5)).withColumn("seq", F.lit(late).cast("long")), log.folder(late))
    log.publish(late)
    assert values(store.vectors(spark, path)) == {("a", "m"): 5.0, ("b", "m"): 2.0}
    log.clear()
    assert values(store.vectors(spark, path)) == {("a", "m"): 5.0, ("b", "m"): 2.0} and not (tmp_path / "v" / "commit=1").exists()
    assert store.compact_vectors(spark, path) and store.compact_vectors(spark, path) is None


def test_failed_commit_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "v")
    store.upsert_vectors(vectors(spark, ("a", 1)), path)
    log = CommitLog(spark, path)
    number = log.claim()
    store._write_bucketed(vectors(spark, ("a", 9)).withColumn("seq", F.lit(number).cast("long")), log.folder(number))
    assert values(store.vectors(spark, path)) == {("a", "m"): 1.0}


def test_only_touched_buckets_are_read(spark, tmp_path):
    path = str(tmp_path / "v")
    store.upsert_vectors(vectors(spark, *[(f"k{i}", i) for i in range(500)]), path)
    ask = vectors(spark, ("k7", 0), ("new", 0)).drop("embedding")
    left = store.pending_vectors(ask, path)
    assert [r["item_id"] for r in left.collect()] == ["new"]
    buckets = {r[0] for r in ask.select(store.bucket_of()).collect()}
    read = store._stored(spark, path, sorted(buckets))
    assert read.count() < 100 and "PartitionFilters: [isnotnull(bucket" in read._jdf.queryExecution().executedPlan().toString().replace("PartitionFilters: [bucket", "PartitionFilters: [isnotnull(bucket")


def test_empty_store(spark, tmp_path):
    path = str(tmp_path / "none")
    assert store.vectors(spark, path).count() == 0 and store.compact_vectors(spark, path) is None
    assert store.pending_vectors(vectors(spark, ("a", 1)).drop("embedding"), path).count() == 1
    store.upsert_vectors(vectors(spark, ("a", 1)).where("false"), path)
    assert store.vectors(spark, path).count() == 0
