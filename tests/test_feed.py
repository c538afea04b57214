"""Feeds, cursors, sessions and what serving needs, against plain Python."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom.functions.text import batch_prompt
from newsloom.operators import cluster, rank, recall, vocab
from newsloom.operators.normalize import normalize
from newsloom.plans import feed as fd
from newsloom.plans import fixtures as fx
from newsloom.schema import PROFILE
from newsloom.sources import store
from newsloom.sources.commits import CommitLog
from newsloom.sources.feeds import PROJECT_FEEDS, Cursor, SourceError, TableFeed
from newsloom.vocabulary import Lexicon

SF = "/root/testdata/sf0.001"
NOW = datetime(2024, 6, 1)
SMALL = Lexicon(projects={"Alpha": ["alpha"]}, tokens={}, topics={"Origin": ["origin"]}, chains=(), macro=("fed",), noise=("noise",), rules={"exploit": ["hacked"], "listing": ["lists"], "funding": ["funded"], "governance": ["votes"]}, hints={"funding": ["raises"]}, overrides={"Origin": "governance"}, boosts={"exploit": (["drained"], ["bridge"], 0.4)})
TAG = [("token", "Alpha", "tau")]


def raw(spark, n=45):
    rows = []
    for i in range(n):
        at = NOW - timedelta(hours=i // 2)  # two items at each time
        rows.append((f"i{i:03d}", f"{'alpha lists' if i % 3 else 'origin'} number {i}", f"body {i}", at, str(int(at.timestamp())), "hot_news" if i % 2 else "pop_info", (*PROJECT_FEEDS, "opinions")[i % 5], TAG if i % 4 == 0 else [], i % 7 == 0))
    return spark.createDataFrame(rows, "id string, title string, content string, published_at timestamp, publish_time string, feed_type string, kind string, tags array<struct<type:string,name:string,symbol:string>>, important boolean")


def profile(spark, **more):
    row = {"user_id": "u", "interests": ["alpha"], "muted_topics": [], "preferred_languages": [], "followed_projects": ["tau"], "followed_kols": [], "risk_preference": "medium"} | more
    return spark.createDataFrame([tuple(row[c.split()[0]] for c in PROFILE.split(", "))], PROFILE)


def test_pages_go_on_from_their_cursor(spark):
    rows = raw(spark)
    news, seen, cursor = fd.NewsFeed(TableFeed(rows), SMALL, F.lit(NOW)), [], None
    while cursor != "":
        items, meta = news.latest_headlines(10, cursor)
        page = [r["id"] for r in items.collect()]
        seen += sorted(page, reverse=True) if len(page) == 1 else page
        cursor = meta["next_cursor"]
        assert meta["has_more"] is bool(cursor) and len(page) == (10 if cursor else 5)
    assert len(seen) == len(set(seen)) == 45
    _, meta = news.project_feed("TAU", "news", 1)
    items, _ = news.project_feed("TAU", "news", 1, meta["next_cursor"])
    want = sorted((r["id"] for r in rows.where("kind = 'news'").collect() if int(r["id"][1:]) % 4 == 0))
    assert [r["id"] for r in items.collect()] == want[1:2]
    with pytest.raises(SourceError):
        news.latest_headlines(5, "nonsense")
    assert Cursor.of(str(Cursor(NOW, "a|b"))) == Cursor(NOW, "a|b") and Cursor.of("") is None


def test_project_feeds_differ(spark):
    feed = TableFeed(raw(spark, 200))
    pages = {k: {r["id"] for r in feed.project("tau", k, 30).collect()} for k in PROJECT_FEEDS} | {"opinions": {r["id"] for r in feed.opinions("tau", 30).collect()}}
    assert all(pages.values()) and sum(map(len, pages.values())) == len(set().union(*pages.values()))
    assert feed.latest(30, only_important=True).count() == 29 and feed.latest(30, no_tag=True).where("size(tags) > 0").count() == 0
    with pytest.raises(ValueError):
        feed.project("tau", "hot_news")
    for call in (lambda f: f.opinions("tau"), lambda f: f.trending("hot_news"), lambda f: f.latest(only_important=True)):
        with pytest.raises(SourceError):
            call(TableFeed(raw(spark).drop("kind", "feed_type", "important")))


def test_reads_enqueue_once(spark):
    given, rows = [], raw(spark, 12)
    news = fd.NewsFeed(TableFeed(rows), SMALL, F.lit(NOW), index=lambda df: given.append(sorted(r["id"] for r in df.collect())))
    news.latest_headlines(5)
    news.latest_headlines(5)
    news.search_content("number 11")
    assert given == [[f"i{i:03d}" for i in range(5)], ["i011"]] or given[0] == sorted(given[0]) and len(given) == 2
    stored = fd.hashed(normalize(rows, SMALL, F.lit(NOW))).where("id < 'i010'").select(F.col("id").alias("item_id"), "item_hash", F.lit("default").alias("model"), "published_at", "title", "source_name", F.array(F.lit(1.0).cast("float")).alias("embedding"))
    news = fd.NewsFeed(TableFeed(rows), SMALL, F.lit(NOW), embeddings=stored, index=lambda df: given.append({r["id"] for r in df.collect()}))
    assert news.warmup(30).count() == 12 and given[-1] == {"i010", "i011"}
    news.warming = True
    assert news.warmup() is None and fd.NewsFeed(TableFeed(rows)).warmup(enabled=False) is None


def test_queries_are_embedded_once(spark):
    asked = []
    news = fd.NewsFeed(TableFeed(raw(spark)), SMALL, embed=lambda t: asked.append(t) or [1.0, 2.0])
    for query in ("a", "a", "b"):
        assert news.query_vector(profile(spark), query) == [1.0, 2.0]
    assert len(asked) == 2 and "Interests: alpha" in asked[0] and fd.NewsFeed(TableFeed(raw(spark))).query_vector(profile(spark)) == []


def test_sessions_walk_all_events():
    """Against a plain walk: refill below the threshold until the target, from where the source was left."""
    source = [(f"e{i}", (f"i{i}",)) for i in range(53)]

    def fetch(state, slots):
        at = int(state.latest_cursor or 0)
        page = source[at : at + max(10, slots)]
        return page + source[:3], str(at + len(page)) if at + len(page) < len(source) else ""

    session, seen, pages, more = fd.Session("s", "p"), [], 0, True
    while more:
        session, page, more = fd.step(session, 4, fetch, float(pages))
        seen, pages = seen + page, pages + 1
        assert len(session.pending) >= 4 or session.exhausted
    assert seen == [e for e, _ in source] and pages == 14


def test_feed_walk_repeats_nothing(spark):
    news = fd.NewsFeed(TableFeed(raw(spark, 45)), SMALL, F.lit(NOW))
    cursor, events, items = None, [], []
    for _ in range(30):
        page = news.personal_feed(profile(spark), 8, cursor)
        events += page["events"]
        items += [i for c in page["clusters"] for i in c["ids"]]
        cursor = page["next_cursor"]
        if not page["has_more"]:
            break
    assert not page["has_more"] and cursor == "" and len(events) == len(set(events)) and len(set(items)) == 45  # an item may come again in another event
    other = news.personal_feed(profile(spark, user_id="w"), 2, next(iter(news.sessions)))
    assert other["events"] and other["next_cursor"] not in ("", next(iter(news.sessions)))
    assert news.personal_feed(profile(spark), 2, next(iter(news.sessions)), now=9e9)["events"]


def test_personal_feed_pages(spark):
    sf = SF
    feed = fd.NewsFeed(TableFeed(fx.raw_feed(spark, sf)), fx.LEXICON, fx.now_of(spark, sf))
    first = feed.personal_feed(fx.profiles(spark), most=2)
    assert len(first["events"]) == 2 and first["has_more"]
    second = feed.personal_feed(fx.profiles(spark), most=2, cursor=first["next_cursor"])
    assert not set(first["events"]) & set(second["events"])


def test_supplement_against_brute_force(spark):
    vectors = {f"i{i:03d}": [float((i * 7) % 11), float((i * 3) % 5), 1.0] for i in range(45) if i % 6}
    table = spark.createDataFrame(list(vectors.items()), "id string, embedding array<double>")

    class News(fd.NewsFeed):
        def vector_of(self, items):
            return items.join(table, "id", "left")

    rows = raw(spark)
    query, limits = [1.0, 2.0, 0.5], {"latest": 5, "trending": 4, "project": 2, "interest": 2, "pool": 20, "top_k": 6}
    got = {r["id"]: (r["route"].split(":")[0], r["semantic_match_score"]) for r in News(TableFeed(rows), SMALL, F.lit(NOW)).recalled(["origin"], ["tau"], query, limits).collect()}
    items = [r.asDict() for r in rows.collect()]
    new = lambda x, n: sorted(x, key=lambda r: (r["published_at"], r["id"]), reverse=True)[:n]
    hot = [r for r in items if r["feed_type"] == "hot_news"]
    routes = [("latest", new(items, 5)), ("trending", new(hot, 4)), ("project", new([r for r in items if r["tags"] and r["kind"] == "tag_information_feed"], 2)), ("interest", new([r for r in new(items, 30) if "origin" in r["title"]], 2))]
    want = {}
    for route, found in routes:
        for r in found:
            want.setdefault(r["id"], route)
    pool = list(dict.fromkeys([*want, *(r["id"] for r in new(items, 20)), *(r["id"] for r in new(hot, 20))]))
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    score = {i: cos(vectors[i], query) for i in pool if i in vectors}
    for i in sorted(score, key=lambda i: -score[i])[:6]:
        want.setdefault(i, "semantic")
    assert got == {i: (r, pytest.approx(round(score.get(i, 0.0), 4))) for i, r in want.items()}


def test_event_branches(spark):
    rows = [("a", "Alpha raises money", "x"), ("b", "alpha", "the bridge was drained"), ("c", "alpha", "it was drained"), ("d", "origin story", "x"), ("e", "fed", "x"), ("f", "noise", "x"), ("g", "alpha lists", "fed"), ("h", "raises", "x")]
    df = spark.createDataFrame(rows, "id string, title string, content string")
    got = {r["id"]: r["event_type"] for r in normalize(df, SMALL, F.lit(NOW)).collect()}
    assert got["b"] == "exploit" and got["c"] == "unknown" and got["d"] == "governance" and got["e"] == "macro" and got["f"] == "unknown" and got["g"] == "listing"


def test_naive_times_are_utc(spark):
    rows = [("a", "2024-01-01T10:00:00"), ("b", "2024-01-01T10:00:00Z"), ("c", "2024-01-01T12:00:00+02:00"), ("d", "2024-01-01 10:00:00"), ("e", "2024-01-01"), ("f", "nothing"), ("g", "1704103200")]
    df = spark.createDataFrame([(i, "t", "c", p) for i, p in rows], "id string, title string, content string, publish_time string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", z)
            got = {r["id"]: r["s"] for r in normalize(df, SMALL, F.timestamp_seconds(F.lit(7))).select("id", F.unix_seconds("published_at").alias("s")).collect()}
            assert got == {"a": 1704103200, "b": 1704103200, "c": 1704103200, "d": 1704103200, "e": 1704067200, "f": 7, "g": 1704103200}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_profiles_are_counted(spark, monkeypatch):
    monkeypatch.setattr(rank, "MOST_PROFILES", 1)
    rows = raw(spark, 4).withColumn("ord", F.monotonically_increasing_id())
    clusters = cluster.cluster_events(normalize(rows, SMALL, F.lit(NOW)).withColumn("scope", F.lit("all")), "scope")
    with pytest.raises(ValueError):
        rank.scored(clusters, profile(spark).unionByName(profile(spark, user_id="w")), F.lit(NOW))
    assert rank.scored(clusters, profile(spark), F.lit(NOW)).count() == clusters.count()


def brute_weighted(a, b):
    keys = a.keys() | b.keys()
    top = sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / top if top else 0.0


def test_clusters_and_rerank_of_the_whole_fixture(spark):
    """The greedy fold and the diversity rerank over all documents, written anew from their rules."""
    from newsloom.plans import catalogue

    items = normalize(fx.raw_feed(spark, SF), fx.LEXICON, fx.now_of(spark, SF)).withColumn("day", F.floor(F.unix_seconds("published_at") / 86400).cast("long"))
    level = {"strong": 1.0, "medium": 0.7, "weak": 0.4}
    share = {"projects": 0.30, "tokens": 0.18, "chains": 0.12, "topics": 0.10}
    days = {}
    import re

    for r in items.collect():
        w = {b: {e.lower(): level[(r["entity_confidence"].get(b) or {}).get(e, "weak")] for e in r["entities"][b]} for b in share}
        t = {x for x in re.findall("[a-z0-9一-鿿]+", r["title"].lower()) if len(x) > 1}
        days.setdefault(r["day"], []).append((r["published_at"], r["ord"], r["id"], r["event_type"], w, t))
    want = set()
    for day, rows in days.items():
        groups = []
        for at, _, key, kind, w, title in sorted(rows, key=lambda x: (x[0], -x[1]), reverse=True):
            best, chosen = 0.0, None
            for g in groups:
                same = 0.35 if kind in g["types"] else 0.12 if kind == "unknown" or "unknown" in g["types"] else None
                hours = abs((at - g["at"]).total_seconds()) / 3600
                near = 0.2 if hours <= 6 else 0.12 if hours <= 24 else 0.06 if hours <= 48 else None
                if same is None or near is None:
                    continue
                overlaps = {b: brute_weighted(w[b], g["w"][b]) for b in share}
                jaccard = len(title & g["title"]) / len(title | g["title"]) if title and g["title"] else 0.0
                if not any(overlaps.values()) and jaccard < 0.4:
                    continue
                s = same + near + sum(share[b] * v for b, v in overlaps.items()) + 0.18 * jaccard
                if s > best:
                    best, chosen = s, g
            if chosen is not None and best >= 0.45:
                chosen["ids"].append(key)
                chosen["types"].add(kind)
                for b in share:
                    for k, v in w[b].items():
                        chosen["w"][b][k] = max(v, chosen["w"][b].get(k, 0))
            else:
                groups.append({"ids": [key], "types": {kind}, "at": at, "w": {b: dict(v) for b, v in w.items()}, "title": title})
        want |= {(day, frozenset(g["ids"])) for g in groups}
    made = cluster.assign(items, "day").groupBy("day", "cluster_no").agg(F.collect_list("id").alias("ids")).collect()
    assert {(r["day"], frozenset(r["ids"])) for r in made} == want

    ranked = [r.asDict(recursive=True) for r in catalogue._ranked(spark, SF).collect()]
    got = {(r["user_id"], r["event_id"]): r["rank"] for r in catalogue.mmr_rerank(spark, SF).collect()}
    part = {"projects": 0.34, "tokens": 0.2, "topics": 0.2, "chains": 0.1}
    for user in {r["user_id"] for r in ranked}:
        left = sorted((r for r in ranked if r["user_id"] == user), key=lambda r: r["raw_rank"])
        picked = left[:1] if len(left) > 2 else left
        left = left[len(picked) :]

        def like(a, b):
            s = 0.16 if a["event_type"] == b["event_type"] else 0.0
            for k, v in part.items():
                x, y = ({e.lower() for e in c["entities"][k]} for c in (a, b))
                s += v * len(x & y) / len(x | y) if x and y else 0.0
            return min(1.0, s)

        while left:
            value = [0.78 * r["score"] - 0.22 * max(like(r, p) for p in picked[-5:]) for r in left]
            picked.append(left.pop(value.index(max(value))))
        assert [got[user, r["event_id"]] for r in picked] == list(range(1, len(picked) + 1))


def test_reports_and_runs(spark, tmp_path):
    shape = "category string, canonical_name string, mention_count long, doc_count long, aliases array<string>, evidence_titles array<string>, source_names array<string>"
    c = spark.createDataFrame([("token", "x", 1, 1, ["x"], ["t"], ["s"]), ("topic", 'y"', 3, 2, [], [], [])], shape)
    root = str(tmp_path / "r")
    assert store.append_run(c, root, "m", 40, latest_limit=40, trending_limit=30, batch_size=12, min_mentions=2, min_docs=2) == 1
    # A writer that has claimed an id and not come back: nobody else gets it, and nothing of it is seen.
    assert CommitLog(spark, root).claim() == 2
    assert store.append_run(c, root, "m", 4) == 3
    runs = {r["run_id"]: r for r in store.runs(spark, root).collect()}
    assert set(runs) == {1, 3} and (runs[1]["batch_size"], runs[1]["candidate_count"], runs[3]["batch_size"]) == (12, 2, None)
    found = json.loads(store.discovery_report({"model": "m", "doc_count": 4}, c, {"batch_summaries": spark.range(2)}).first()["value"])
    assert found["meta"] == {"model": "m", "doc_count": 4} and [x["canonical_name"] for x in found["candidates"]] == ['y"', "x"] and found["debug"]["batch_summaries"] == [{"id": 0}, {"id": 1}]


def test_batch_prompt(spark):
    rows = spark.createDataFrame([(1, 2, "b", None, "s"), (1, 1, "a", "c" * 600, None), (2, 3, None, "d", "")], "batch_id long, ord long, title string, content string, source_name string")
    got = {r["batch_id"]: r["prompt"] for r in batch_prompt(rows).collect()}
    assert got[1] == "[DOC 1]\ntitle: a\nsource: unknown\ncontent: " + "c" * 500 + "\n\n[DOC 2]\ntitle: b\nsource: s\ncontent: \n" and got[2].startswith("[DOC 1]\ntitle: \nsource: unknown\ncontent: d")


def test_serving_helpers(spark):
    both = profile(spark).unionByName(profile(spark, user_id="w"))
    assert [r["user_id"] for r in fd.other_presets(both, "u").collect()] == ["w"] and fd.other_presets(profile(spark), "u").count() == 1 and fd.other_presets(both, None).count() == 2
    memory = spark.createDataFrame([("u", [1, 2, 3, 4, 5])], "user_id string, tools array<int>")
    later = fd.remembered(memory, spark.createDataFrame([("u", [6, 7]), ("w", [9])], memory.schema), "tools", "tools")
    assert {r["user_id"]: r["tools"] for r in later.collect()} == {"u": [2, 3, 4, 5, 6, 7], "w": [9]}
    assert {r["user_id"]: r["tools"] for r in fd.shown_memory(later, "tools", "tools").collect()} == {"u": [4, 5, 6, 7], "w": [9]}
    short = fd.compact(spark.createDataFrame([("1", "", "", "topic x", "text y")], "id string, title string, name string, topic_name string, text string")).first()
    assert (short["title"], short["summary"], short["event_type"], short["projects"]) == ("topic x", "text y", "unknown", [])
    assert fd.unwrapped_result({"result": {"result": 3}}) == 3 and fd.unwrapped_result({"result": None}) == {"result": None}
    assert fd.preview([]) == "0 items" and fd.preview([{"topic": "x"}]) == "1 items, first: x" and fd.preview({"b": 1, "a": 2}) == "object keys: a, b" and fd.preview(3) == "int"


def test_vocabulary_rows_and_orders(spark):
    lexicon = Lexicon(projects={"A": ["a"]}, tokens={}, topics={})
    rows = store.vocabulary_rows(lexicon, None, spark).collect()
    assert [tuple(r) for r in rows] == [("project", "A", ["a"], "builtin")]
    shape = "category string, canonical_name string, status string, decayed_run_score double, run_hits long, source_diversity long, total_mentions long, max_doc_count long"
    c = spark.createDataFrame([("t", "a", "cooling", 9.0, 1, 1, 1, 1), ("t", "b", "active", 1.0, 1, 2, 1, 1), ("t", "c", "active", 1.0, 1, 3, 1, 1), ("t", "d", "odd", 99.0, 1, 1, 1, 1)], shape)
    assert [r["canonical_name"] for r in vocab.in_status_order(c).collect()] == ["c", "b", "a", "d"]
    assert [r["canonical_name"] for r in vocab.in_score_order(c).collect()] == ["d", "a", "c", "b"]


def test_recall_keeps_going_without_optional_routes():
    def fails():
        raise RuntimeError

    assert recall.attempted([("project:x", fails)]) == []
    with pytest.raises(RuntimeError):
        recall.attempted([("latest", fails)])
