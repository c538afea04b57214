"""Clusters of tables of any length against one fold over all items."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom.operators import cluster, similarity
from newsloom.plans import catalogue

ITEM = (
    "id string, ord long, scope string, event_type string, published_at timestamp, title string, "
    "entities struct<projects:array<string>,tokens:array<string>,chains:array<string>,topics:array<string>,people:array<string>>, "
    "entity_confidence map<string,map<string,string>>, embedding array<float>"
)
START = datetime(2024, 3, 1)


def items(spark, seed, n, names, words, vectors=False, spread=40):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        buckets = {b: [x for x in names if r.random() < 0.3] for b in ("projects", "tokens", "chains", "topics")}
        levels = {b: {x: r.choice(["strong", "medium", "weak"]) for x in xs} for b, xs in buckets.items()}
        at = START + timedelta(hours=r.choice([r.uniform(0, spread * 24), 24 * r.randrange(spread)]))
        title = " ".join(r.choices(words, k=r.randrange(5)))
        vector = [r.uniform(-1, 1) for _ in range(3)] if vectors and r.random() < 0.4 else None
        rows.append((f"i{i}", i, r.choice(["a", "b"]), r.choice(["exploit", "listing", "unknown"]), at, title, (*buckets.values(), []), levels, vector))
    return spark.createDataFrame(rows, ITEM)


def groups(rows, *keys):
    return {tuple(r["ids"]) for r in rows.groupBy(*keys).agg(F.sort_array(F.collect_list("id")).alias("ids")).collect()}


@pytest.mark.parametrize("case", [(1, 150, [], ["alpha", "beta", "gamma", "delta", "x1"]), (2, 150, ["P", "Q", "R"], ["a1", "b2"]), (3, 120, ["P"], [f"word{i}" for i in range(30)], True), (4, 60, [], [])], ids=["titles", "entities", "vectors", "nothing"])
def test_timeline_equals_one_fold(spark, case):
    rows = items(spark, *case[:3], case[3] or [""], *case[4:])
    assert groups(cluster.assign_timeline(rows, "scope"), "scope", "head_id") == groups(cluster.assign(rows, "scope"), "scope", "cluster_no")
    every = rows.withColumn("scope", F.lit("all"))
    assert groups(cluster.assign_timeline(rows), "head_id") == groups(cluster.assign(every, "scope"), "cluster_no")


def test_heads_are_the_newest_items(spark):
    rows = items(spark, 5, 80, ["P", "Q"], ["a1", "b2", "c3"])
    made = cluster.assign_timeline(rows).join(rows.drop("scope"), "id")
    newest = made.groupBy("head_id").agg(F.max_by("id", F.struct("published_at", (-F.col("ord")).alias("o"))).alias("newest")).collect()
    assert newest and all(r["head_id"] == r["newest"] for r in newest)


def test_components_keep_what_could_meet(spark):
    """Chains of shared names within 48 hours are one component, a longer gap or another scope is not."""
    hour = lambda h: START + timedelta(hours=h)
    rows = [("a", "s", hour(0), ["n"]), ("b", "s", hour(47), ["n", "m"]), ("c", "s", hour(94), ["m"]), ("d", "s", hour(143), ["m"]), ("e", "t", hour(0), ["n"]), ("f", "s", hour(190), ["m"]), ("g", "s", hour(5), [])]
    found = cluster.components(spark.createDataFrame(rows, "id string, scope string, published_at timestamp, features array<string>"))
    label = {r["id"]: r["component"] for r in found.collect()}
    assert label["a"] == label["b"] == label["c"] and label["d"] == label["f"] != label["a"] and set(label) == {"a", "b", "c", "d", "f"}


def test_empty_timeline(spark):
    none = items(spark, 1, 3, ["P"], ["a"]).where("ord < 0")
    assert cluster.assign_timeline(none, "scope").collect() == []


def test_whole_fixture_is_clustered_as_one_pool(spark):
    """No day parts the items: the query's clusters are those of one fold over sf0.01."""
    sf = "/root/testdata/sf0.01"
    rows = catalogue._items(spark, sf).drop("content").withColumn("scope", F.lit("all"))
    whole = cluster.assign(rows, "scope").groupBy("cluster_no").agg(F.substring(F.md5(F.array_join(F.array_sort(F.collect_list("id")), "|").cast("binary")), 1, 10).alias("e"))
    assert {r["event_id"] for r in catalogue.cluster_events(spark, sf).select("event_id").collect()} == {r["e"] for r in whole.collect()}


def test_pairs_within_reach(spark):
    rows = items(spark, 6, 40, ["P"], ["a"])
    plain = rows.select("id", "event_type", "published_at").collect()
    want = {(a["id"], b["id"]) for a in plain for b in plain if a["id"] < b["id"] and abs(a["published_at"] - b["published_at"]) <= timedelta(hours=48) and (a["event_type"] == b["event_type"] or "unknown" in (a["event_type"], b["event_type"]))}
    assert {(r[0], r[1]) for r in similarity.candidate_pairs(rows).select("a.id", "b.id").collect()} == want


def test_pairs_keep_their_tasks(spark):
    """Few bytes go in and many pairs come out, so tasks are not merged by what goes in."""
    rows = items(spark, 6, 40, ["P"], ["a"])
    pairs = similarity.candidate_pairs(rows)
    assert pairs.count() > 40 and pairs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("name", ["pair_gate", "daily_ranking", "feed_page", "explain"])
def test_items_are_normalised_once(spark, name, monkeypatch):
    """All that a query plans, staged or returned, scans the documents once."""
    staged, planned = catalogue.store.staged, []
    monkeypatch.setattr(catalogue.store, "staged", lambda df, to: (planned.append(df), staged(df, to))[1])
    planned.append(catalogue.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert sum(df._jdf.queryExecution().sparkPlan().toString().count("documents.parquet") for df in planned) == 1
    assert planned[-1].count() > 0


def test_merged_roll_up_equals_roll_up(spark):
    rows = items(spark, 7, 120, ["P", "Q", "r"], ["a1", "b2"]).withColumns({
        "summary": F.when(F.col("ord") % 7 == 0, None).otherwise(F.concat(F.lit("s"), (F.col("ord") % 9).cast("string"))), "importance_score": F.col("ord") % 4 / 10, "credibility_score": F.lit(0.5),
    })
    names = ["event_id", "title", "event_type", "first_seen_at", "last_updated_at", "importance_score", "avg_credibility", "entities", "key_points", "risks", "n_items"]
    for keys in (["scope"], ["scope", "event_type"], ["ord"]):
        data = rows.withColumn("kind", F.col("event_type"))
        keys = ["kind" if k == "event_type" else k for k in keys]
        if keys == ["ord"]:
            data, keys = data.withColumn("each", F.col("ord")), ["each"]
        one = cluster.roll_up(cluster.rollup_input(data), *keys).select(*keys, *names).collect()
        other = cluster.merged_roll_up(data, *keys).select(*keys, *names)
        assert sorted(one, key=repr) == sorted(other.collect(), key=repr)
    assert cluster.merged_roll_up(rows.limit(0), "scope").isEmpty()
