"""Hand-computed rows, folds against brute force, sessions, stores and streams."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom.operators import normalize as norm
from newsloom.plans import fixtures as fx
from newsloom.functions import text as tx
from newsloom.operators import cluster, rank, vocab
from newsloom.operators.normalize import normalize
from newsloom.plans.feed import Session, expired, fill_limits, step
from newsloom.schema import PROFILE, PROMOTED, RAW_ITEM
from newsloom.sources import store
from newsloom.sources.feeds import SourceError, TableFeed, filled_meta, page_meta, unwrapped
from newsloom.vocabulary import Lexicon, merged, read_overlay

COLUMNS = [c.split()[0] for c in RAW_ITEM.split(", ")]
NOW = datetime(2024, 6, 1)


def raw(spark, *rows):
    return spark.createDataFrame([tuple(r.get(c) for c in COLUMNS) for r in rows], RAW_ITEM)


def items(spark, *rows):
    return normalize(raw(spark, *rows), Lexicon(), F.lit(NOW)).collect()


@pytest.mark.parametrize(
    ("text", "alias", "hit"),
    [("buy sol now", "sol", True), ("console", "sol", False), ("币sol币", "sol", True), ("sol2", "sol", False), ("sol.", "sol", True), ("新融资轮", "融资", True), ("x", "", False), ("pump.fun!", "pump.fun", True), ("pumpxfun", "pump.fun", False)],
)
def test_contains_alias(spark, text, alias, hit):
    row = spark.createDataFrame([(text, alias)], "t string, a string").select(tx.contains_alias(F.col("t"), alias).alias("x"), tx.contains_column(F.col("t"), F.col("a")).alias("y")).first()
    assert (row["x"], row["y"]) == (hit, hit)


@pytest.mark.parametrize(
    ("text", "alias", "hit"),
    [("the agent left", "agent", False), ("an agent with ai tools", "agent", True), ("autonomous agent", "agent", True), ("bond yield and defi yield", "yield", False), ("yield farming", "yield", True), ("yield in staking", "yield", True), ("low yield", "yield", False)],
)
def test_guarded_topics(spark, text, alias, hit):
    assert spark.createDataFrame([(text,)], "t string").select(tx.contains_topic(F.col("t"), alias)).first()[0] is hit


def test_levels_types_and_importance(spark):
    a, b, c, d = items(
        spark,
        {"id": "1", "title": "Solana exploit", "content": "solana was hit", "source_name": "official", "tags": [("token", "Solana", "sol")]},
        {"id": "2", "title": "FOMC", "content": "rate cut", "source_name": "media"},
        {"id": "3", "title": "embassy", "content": "drone news"},
        {"id": "4", "title": "", "content": "kamino wrote", "publish_time": "1704067200"},
    )
    assert a["entity_confidence"]["projects"]["Solana"] == "strong" and a["entity_confidence"]["topics"]["Exploit"] == "medium"
    assert a["event_type"] == "exploit" and a["credibility_score"] == 0.95
    assert a["importance_score"] == pytest.approx(0.20 + 0.18 + 0.18 + 0.10 + 0.04 + 0.08 + 0.45 * 0.24, abs=0.006)
    assert b["event_type"] == "macro" and c["event_type"] == "unknown"
    assert d["entity_confidence"]["projects"]["Kamino"] == "weak" and d["published_at"] == datetime(2024, 1, 1)


def test_ids_times_and_nulls(spark):
    rows = items(spark, {"title": "t", "source_url": "u"}, {"id": "", "publish_time": "1704067200000"}, {"id": "0", "publish_time": "2024-01-01T00:00:00Z"}, {})
    assert rows[0]["id"] == __import__("hashlib").md5(b"tu").hexdigest()[:12] and rows[0]["published_at"] == NOW
    assert rows[1]["published_at"] == rows[2]["published_at"] == datetime(2024, 1, 1) and rows[2]["id"] == "0"
    assert rows[3]["title"] == "" and rows[3]["entities"]["projects"] == []


def brute_clusters(rows):
    groups, out = [], []
    for r in rows:
        scores = [g.score(r) for g in groups]
        best = max(scores, default=0.0)
        if best >= cluster.MERGE_AT:
            at = scores.index(best)
            groups[at].add(r)
        else:
            at = len(groups)
            groups.append(cluster._Group(r))
        out.append(at)
    return out


def test_cluster_fold():
    rng, rows = random.Random(1), []
    for i in range(60):
        w = {f"w_{k}": {rng.choice("abc"): rng.choice([0.4, 0.7, 1.0])} if rng.random() < 0.7 else {} for k in cluster.MATCH}
        rows.append({"event_type": rng.choice(["listing", "funding", "unknown"]), "published_at": NOW - timedelta(hours=i), "title_set": set(rng.sample("pqrstu", 2)), **w})
    assert cluster.fold(rows) == brute_clusters(rows)
    far = [dict(rows[0]), dict(rows[0], published_at=NOW - timedelta(hours=49))]
    assert cluster.fold(far) == [0, 1]
    assert cluster.fold([]) == []


def plain_order(rows):
    """Best first; then each time the first of the best by score against likeness to the last five picks."""
    share = {"projects": 0.34, "tokens": 0.20, "topics": 0.20, "chains": 0.10}

    def like(a, b):
        s = sum(w * (len(a[k] & b[k]) / len(a[k] | b[k]) if a[k] and b[k] else 0.0) for k, w in share.items())
        return min(1.0, s + (0.16 if a["event_type"] == b["event_type"] else 0.0))

    left, picked = list(rows), []
    while left:
        worth = [0.78 * r["score"] - (1 - 0.78) * max((like(r, p) for p in picked[-5:]), default=0.0) for r in left]
        picked.append(left.pop(0 if len(rows) <= 2 or not picked else worth.index(max(worth))))
    return picked


def test_rerank_equals_plain_order(spark):
    rng = random.Random(4)
    buckets = ("projects", "tokens", "topics", "chains", "people")
    rows, want = [], {}
    for user, n in (("a", 1), ("b", 2), ("c", 3), ("d", 25), ("e", 25), ("f", 9)):
        mine = [{"event_id": f"{user}{i}", "score": round(1 - i * 0.03 * rng.random(), 4), "event_type": rng.choice("xyz"), **{b: {x for x in "PQR" if rng.random() < 0.4} for b in buckets}} for i in range(n)]
        mine.sort(key=lambda r: -r["score"])
        rows += [(user, r["event_id"], i + 1, r["score"], r["event_type"], tuple(sorted(r[b]) for b in buckets)) for i, r in enumerate(mine)]
        want |= {(user, r["event_id"]): i + 1 for i, r in enumerate(plain_order(mine))}
    ranked = spark.createDataFrame(rows, "user_id string, event_id string, raw_rank long, score double, event_type string, entities struct<" + ",".join(f"{b}:array<string>" for b in buckets) + ">")
    made = rank.rerank(ranked)
    assert {(r["user_id"], r["event_id"]): r["rank"] for r in made.collect()} == want
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString() and rank.rerank(ranked.limit(0)).isEmpty()
    second = rank.page_of(made.where("user_id = 'f'"), 1, 4).orderBy("rank").select("page", "place", "rank", "has_more").collect()
    assert [tuple(r) for r in second] == [(1, i, 5 + i, True) for i in range(4)]


def test_sessions():
    events = [(f"e{i}", (f"i{i}",)) for i in range(7)]
    session, seen, more = Session("s", "p"), [], True
    while more:
        session, page, more = step(session, 3, lambda s, n: (events, ""), 0.0)
        assert not set(page) & set(seen)
        seen += page
        if not page:
            break
    assert seen == [e for e, _ in events]
    assert expired(Session("s", "p", updated=0), 1801) and not expired(Session("s", "p"), 1800) and not expired(Session("s", "p"), 9e9, ttl=0)
    assert fill_limits(20) == {"latest": 20, "trending": 20, "interest": 10, "project": 10, "pool": 40, "top_k": 12}


def test_arguments_and_meta(spark):
    feed = TableFeed(raw(spark).withColumn("published_at", F.lit(NOW)).withColumn("feed_type", F.lit("")))
    with pytest.raises(ValueError):
        feed.trending("nothing")
    with pytest.raises(SourceError):
        unwrapped({"code": 500})
    assert unwrapped({"code": 2000, "data": {"a": 1}}) == {"a": 1}
    assert page_meta({"cursor": None, "has_more": 1}) == {"has_more": 1} and filled_meta({"has_more": 1})["has_more"] is True
    assert feed.latest(10).count() == 0


def test_overlay(spark, tmp_path):
    assert merged({"A": ["a"]}, {"A": [" a ", "b"], "C": ["", " "], "D": ["d"]}) == {"A": ["a", "b"], "D": ["d"]}
    (tmp_path / "x.json").write_text(json.dumps({"token_aliases": {"NEW": ["new coin"]}}))
    assert Lexicon().overlaid(read_overlay(spark, str(tmp_path / "x.json"))).tokens["NEW"] == ["new coin"]
    assert read_overlay(spark, str(tmp_path / "none.json")) == {} and read_overlay(spark, None) == {}


def test_candidate_names(spark):
    rows = spark.createDataFrame([("project", " “Foo” – Bar & Baz  account "), ("event_keyword", "Bridge hack incident"), ("token", "abc"), ("topic", "the  etf market")], "c string, n string")
    got = rows.select(tx.category_key(F.col("c"), tx.candidate_key(F.col("n"))), tx.review_name(F.col("c"), F.col("n"))).collect()
    assert got[0][0].endswith("bar and baz") and got[1][0] == "bridge hack" and got[2][1] == "ABC" and got[3][1] == "The ETF Market"
    assert spark.range(1).select(tx.title_case(F.lit("pump.fun x1y"))).first()[0] == "Pump.Fun X1Y"


def promoted_row(status, stale=0, evaluated=1):
    return ("token", f"n-{status}", status, 1, 1, 1, 1, 1.0, [], [], [], 1, 1, evaluated, stale, None, None, None)


def test_lifecycle(spark):
    old = spark.createDataFrame([promoted_row("active"), promoted_row("cooling", 1), promoted_row("archived", 5), promoted_row("odd")], PROMOTED)
    none = vocab.promoted(spark.createDataFrame([], "run_id long, created_at timestamp, category string, canonical_name string, mention_count long, doc_count long, aliases array<string>, evidence_titles array<string>, source_names array<string>"))
    seen = spark.createDataFrame([], "category string, canonical_name string, last_seen_run_id long")
    got = {r["canonical_name"]: (r["status"], r["stale_cycles"]) for r in vocab.lifecycle(none, old, seen, 2, F.lit(NOW)).collect()}
    assert got == {"n-active": ("cooling", 1), "n-cooling": ("archived", 2), "n-archived": ("archived", 6), "n-odd": ("cooling", 1)}
    again = {r["canonical_name"]: r["stale_cycles"] for r in vocab.lifecycle(none, old, seen, 1, F.lit(NOW)).collect()}
    assert again["n-active"] == 0 and again["n-cooling"] == 1
    document = json.loads(vocab.export_document(old).first()["value"])
    assert document["token_aliases"] == {"N-ACTIVE": ["n-active"]} and document["topic_aliases"] == {}


def test_stores(spark, tmp_path):
    root = str(tmp_path)
    assert store.vectors(spark, f"{root}/v").count() == 0 and store.snapshot(spark, f"{root}/p").count() == 0
    new = spark.createDataFrame([("a", "h", "m", NOW, "t", "s", [1.0])], "item_id string, item_hash string, model string, published_at timestamp, title string, source_name string, embedding array<float>")
    store.upsert_vectors(new, f"{root}/v")
    store.upsert_vectors(new, f"{root}/v")
    assert store.vectors(spark, f"{root}/v").count() == 1
    a = spark.createDataFrame([promoted_row("active")], PROMOTED)
    assert store.upsert_promoted(a, f"{root}/p") == 1
    assert store.upsert_promoted(a.withColumn("run_hits", F.lit(9).cast("long")), f"{root}/p") == 2
    assert [r["run_hits"] for r in store.snapshot(spark, f"{root}/p").collect()] == [9]
    c = spark.createDataFrame([("token", "x", 1, 1, ["x"], ["t"], ["s"])], "category string, canonical_name string, mention_count long, doc_count long, aliases array<string>, evidence_titles array<string>, source_names array<string>")
    assert store.append_run(c, f"{root}/r", "m", 3) == 1 and store.append_run(c, f"{root}/r", "m", 3) == 2
    assert vocab.recent(store.run_candidates(spark, f"{root}/r"), store.runs(spark, f"{root}/r"), 1).count() == 1


def test_streams(spark, tmp_path):
    from newsloom.streaming.indexer import index_stream, replay, session_stream

    shape = "item_id string, item_hash string, model string, published_at timestamp, title string, source_name string"
    rows = [(str(i % 3), "h", "m", NOW, "t", "s") for i in range(6)]
    spark.createDataFrame(rows, shape).write.parquet(str(tmp_path / "in"))
    embed = lambda df: df.withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    for n in range(2):
        index_stream(spark.readStream.schema(shape).parquet(str(tmp_path / "in")), embed, str(tmp_path / "out"), str(tmp_path / f"c{n}")).awaitTermination()
    assert store.vectors(spark, str(tmp_path / "out")).count() == 3
    asked = "user_id string, at long, most int, offered array<string>"
    spark.createDataFrame([("u", 1, 2, ["a", "b", "c"]), ("u", 2, 2, ["b", "d"]), ("w", 1, 2, ["a"])], asked).coalesce(1).write.parquet(str(tmp_path / "ask"))
    pages = replay(session_stream(spark.readStream.schema(asked).parquet(str(tmp_path / "ask"))), "pages", str(tmp_path / "cs")).collect()
    assert sorted((r["user_id"], r["page"], tuple(r["events"])) for r in pages) == [("u", 0, ("a", "b")), ("u", 1, ("c", "d")), ("w", 0, ("a",))]


def test_profile_texts(spark):
    p = spark.createDataFrame([("u", [], [], [], [], [], "medium")], PROFILE)
    assert "Interests: crypto market\nFollowed projects: none" in p.select(tx.profile_query(F.lit(" x "))).first()[0]
    assert p.select(tx.profile_summary()).first()[0] == "risk: medium"


def test_summary_is_that_of_the_whole_collapsed_text(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choices(["a", "é", "𝒳", " ", "\n", " ", "  "], weights=[6, 1, 1, 2, 1, 1, 1], k=n)) for n in [*range(0, 12), *rng.choices(range(100, 260), k=300)]]
    texts += ["a" * 119 + " b", "a" * 120 + " ", "a" * 120 + " b", " " * 5000 + "a" * 120 + "\n" * 5000, "a" * 119 + " " * 5000 + "b" * 9, " \n"]
    for text, short in spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.summary(F.col("t"))).collect():
        clean = " ".join(text.split())
        assert short == clean[:120] + ("..." if len(clean) > 120 else "")


def test_normalisation_cuts_a_text_into_words_once(spark):
    """Its plan looks no alias of one word up in a text, and no filter on what comes of the words is moved below them."""
    raw = spark.createDataFrame([("1", "that was it", "this is from la with tion", "2024-01-01")], "id string, title string, content string, publish_time string")
    made = norm.normalize(raw, fx.LEXICON, F.lit(None).cast("timestamp")).select("id", F.explode("entity_confidence").alias("bucket", "m")).where("size(m) > 0")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "(?<![a-z0-9])" not in plan and plan.count("regexp_extract_all") == 2
    assert {r["bucket"]: r["m"] for r in made.collect()} == {"projects": {"Alpha": "medium"}, "tokens": {"TAU": "weak"}, "chains": {"With": "strong"}, "topics": {"Origin": "strong"}}
