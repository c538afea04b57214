"""All queries of the engine over the fixture views, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scores import jaccard
from ..functions.text import batch_prompt, title_tokens
from ..operators import cluster, rank, recall, similarity, vocab
from ..operators.normalize import alias_hits, base_items, normalize, with_entities
from ..sources.feeds import Cursor, TableFeed, first_of_each
from ..sources import store
from ..streaming import indexer
from ..vocabulary import Lexicon
from . import fixtures as fx
from .feed import NewsFeed
from .fixtures import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None, *views: str):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = sql(oracle, *views) if views else oracle
        return f

    return register


def _feed(spark: SparkSession, sf_dir: str) -> TableFeed:
    return TableFeed(fx.raw_feed(spark, sf_dir), fx.topic_days(spark, sf_dir))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(fx.raw_feed(spark, sf_dir), fx.LEXICON, fx.now_of(spark, sf_dir))


def _short(rows: DataFrame) -> DataFrame:
    return rows.select("id", "title", F.unix_seconds("published_at").alias("at_s"))


@query("SELECT id, title, at_s FROM raw ORDER BY at_s DESC LIMIT 30", "raw")
def latest_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(_feed(spark, sf_dir).latest(50))


@query("SELECT id, title, at_s FROM raw ORDER BY at_s DESC LIMIT 30 OFFSET 30", "raw")
def latest_page2(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = _feed(spark, sf_dir)
    last = feed.latest(30).orderBy("published_at").select("published_at", "id").first()
    return _short(feed.latest(30, Cursor(last["published_at"], last["id"])))


@query("SELECT id, title, at_s FROM raw WHERE feed_type = 'hot_news' ORDER BY at_s DESC LIMIT 20", "raw")
def trending_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(_feed(spark, sf_dir).trending("hot_news", 20))


@query("SELECT id, title, at_s FROM raw WHERE doc_id % 5 = 0 AND kind = 'tag_information_feed' ORDER BY at_s DESC LIMIT 20", "raw")
def project_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(_feed(spark, sf_dir).project("TAU", limit=20))


@query("SELECT id, title, at_s FROM raw WHERE doc_id % 5 = 0 AND kind = 'news' ORDER BY at_s DESC LIMIT 20", "raw")
def project_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(_feed(spark, sf_dir).project("tau", "news"))


@query("SELECT id, title, at_s FROM raw WHERE doc_id % 5 = 0 AND kind = 'opinions' ORDER BY at_s DESC LIMIT 10", "raw")
def project_opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(_feed(spark, sf_dir).opinions("tau", 10))


@query("""SELECT event_type, n, day_start_ts AS _day_start_ts FROM (SELECT epoch(ts)::BIGINT // 86400 * 86400 AS day_start_ts, event_type, count(*) AS n
FROM events GROUP BY ALL) ORDER BY day_start_ts DESC, event_type LIMIT 10""")
def trending_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feed(spark, sf_dir).topics(10)


@query("SELECT id, title, at_s FROM (SELECT * FROM raw ORDER BY at_s DESC LIMIT 30) WHERE contains(lower(title), 'the') OR contains(lower(content), 'the') ORDER BY at_s DESC LIMIT 20", "raw")
def search_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(_feed(spark, sf_dir).search(" The ", 20))


@query("""SELECT id, title, s || CASE WHEN length(c) > 120 THEN '...' ELSE '' END AS summary, '' AS url, source_type, source_name, 'unknown' AS author, at_s, language,
CASE WHEN doc_id % 5 < 2 THEN 'tau' ELSE '' END AS raw_tags, credibility_score FROM (SELECT *, substr(c, 1, 120) AS s, CASE source_type WHEN 'twitter' THEN 0.6
WHEN 'media' THEN 0.8 WHEN 'official' THEN 0.95 ELSE 0.5 END::DOUBLE AS credibility_score FROM (SELECT *, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS c FROM raw))""", "raw")
def normalize_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select(
        "id", "title", "summary", "url", "source_type", "source_name", "author", F.unix_seconds("published_at").alias("at_s"), "language", F.array_join("raw_tags", "|").alias("raw_tags"), "credibility_score"
    )


@query("SELECT id, bucket, canonical, alias, in_title, in_body FROM hits", "hits")
def alias_hits_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alias_hits(fx.raw_feed(spark, sf_dir), fx.LEXICON.frame(spark))


@query("SELECT id, bucket, string_agg(canonical, '|' ORDER BY canonical) AS names FROM ent GROUP BY id, bucket", "ent")
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = ["projects", "tokens", "chains", "topics"]
    rows = _items(spark, sf_dir).select("id", F.explode(F.array(*[F.struct(F.lit(b).alias("bucket"), F.col("entities")[b].alias("e")) for b in buckets])).alias("s"))
    return rows.where(F.size("s.e") > 0).select("id", "s.bucket", F.array_join(F.array_sort("s.e"), "|").alias("names"))


@query("SELECT id, bucket, canonical AS entity, level FROM conf", "conf")
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _items(spark, sf_dir).select("id", F.explode("entity_confidence").alias("bucket", "m"))
    return rows.select("id", "bucket", F.explode("m").alias("entity", "level"))


WIDE = 20_000


@query(f"""WITH run AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS b, list_distinct(regexp_extract_all(lower(substr(text, 1, 60)), '[a-z0-9]+')) AS t FROM documents),
word AS (SELECT w FROM (SELECT unnest(b) AS w FROM run) GROUP BY w ORDER BY count(*) DESC, w LIMIT {WIDE}),
hit AS (SELECT doc_id, w, bool_or(t) AS t, bool_or(b) AS b FROM (SELECT doc_id, unnest(t) AS w, true AS t, false AS b FROM run UNION ALL SELECT doc_id, unnest(b), false, true FROM run) WHERE w IN (FROM word) GROUP BY ALL
  UNION ALL SELECT doc_id, 'Alpha', NULL, NULL FROM documents WHERE doc_id % 5 = 0)
SELECT CAST(doc_id AS VARCHAR) AS id, count(*) AS n, count(*) FILTER (t AND b) AS strong, count(*) FILTER (t IS NULL OR (t AND NOT b)) AS medium, count(*) FILTER (b AND NOT t) AS weak,
  md5(string_agg(w, '|' ORDER BY w)) AS names FROM hit GROUP BY doc_id""")
def entities_large_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with levels under a vocabulary overlaid with the 20,000 commonest words of the texts."""
    runs = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1))
    words = fx.table(spark, sf_dir, "documents").select(F.explode(runs).alias("w")).groupBy("w").count().orderBy(F.desc("count"), "w").limit(WIDE)
    none = Lexicon(projects={}, tokens={}, topics={}, chains=())
    lexicon = none.overlaid({"entity_aliases": {r["w"]: [r["w"]] for r in words.collect()}})
    found = with_entities(base_items(fx.raw_feed(spark, sf_dir), F.lit(None).cast("timestamp")), lexicon, one_pass=True)
    levels, names = F.map_values(F.col("entity_confidence")["projects"]), F.col("entities")["projects"]
    of = lambda level: F.size(F.filter(levels, lambda x: x == level)).cast("long").alias(level)
    return found.where(F.size(names) > 0).select("id", F.size(names).cast("long").alias("n"), *[of(x) for x in ("strong", "medium", "weak")], F.md5(F.array_join(F.array_sort(names), "|").cast("binary")).alias("names"))


@query("SELECT id, event_type FROM items", "items")
def event_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("id", "event_type")


@query("SELECT id, importance_score FROM items", "items")
def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("id", "importance_score")


@query("SELECT md5(content) AS key, min(ord) AS ord FROM raw GROUP BY 1", "raw")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.raw_feed(spark, sf_dir).select(F.md5(F.col("content").cast("binary")).alias("key"), "ord")
    return first_of_each(rows, F.col("key"), F.col("ord"))


@query("SELECT md5(content) AS key, max(ord) AS ord FROM raw GROUP BY 1", "raw")
def dedupe_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.keep_last(fx.raw_feed(spark, sf_dir).select(F.md5(F.col("content").cast("binary")).alias("key"), "ord"), "key")


@query("""SELECT key, ord FROM (SELECT md5(content) AS key, ord, row_number() OVER (PARTITION BY md5(content)
ORDER BY doc_id % 7 DESC, doc_id % 3 DESC, at_s DESC, ord) AS n FROM raw) WHERE n = 1""", "raw")
def best_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.raw_feed(spark, sf_dir).select(
        F.md5(F.col("content").cast("binary")).alias("key"), "ord", "published_at", (F.col("ord") % 7 / 10).alias("semantic_match_score"), (F.col("ord") % 3 / 10).alias("importance_score")
    )
    return recall.best_variant(rows, "key").select("key", "ord")


@query("""SELECT id, arg_min(route, o) AS route FROM (
SELECT id, 'latest' AS route, 0 AS o FROM (SELECT id FROM raw ORDER BY at_s DESC LIMIT 20) UNION ALL
SELECT id, 'trending', 1 FROM (SELECT id FROM raw WHERE feed_type = 'hot_news' ORDER BY at_s DESC LIMIT 20) UNION ALL
SELECT id, 'project', 2 FROM (SELECT id FROM raw WHERE doc_id % 5 = 0 AND kind = 'tag_information_feed' ORDER BY at_s DESC LIMIT 10) UNION ALL
SELECT id, 'interest', 3 FROM (SELECT id FROM (SELECT * FROM raw ORDER BY at_s DESC LIMIT 30) WHERE contains(lower(title), 'the') OR contains(lower(content), 'the') ORDER BY at_s DESC LIMIT 10) UNION ALL
SELECT id, 'semantic', 4 FROM hits12
) GROUP BY id""", "hits12")
def recall_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recalled(spark, sf_dir).select("id", "route")


def _news(spark: SparkSession, sf_dir: str) -> NewsFeed:
    """The feed over the fixture, with a stored vector for each of its items."""
    class Vectors(NewsFeed):
        def vector_of(self, items: DataFrame) -> DataFrame:
            return items.join(fx.item_vectors(spark, sf_dir), "id", "left")

    return Vectors(_feed(spark, sf_dir), fx.LEXICON, fx.now_of(spark, sf_dir))


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return [float(x) for x in fx.table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()["embedding"]]


def _recalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = {"latest": 20, "trending": 20, "project": 10, "interest": 10, "pool": 30, "top_k": 12}
    rows = _news(spark, sf_dir).recalled(["the"], ["tau"], _query_vector(spark, sf_dir), limits)
    return rows.withColumn("route", F.split("route", ":")[0])


@query("SELECT id, round(score, 4) AS semantic_match_score FROM pool WHERE id IN (SELECT id FROM hits12) OR base", "hits12")
def semantic_supplement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of all candidates: those of the other routes, and the pool's nearest to the query."""
    return _recalled(spark, sf_dir).select("id", "semantic_match_score")


_COSINE = """SELECT v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.e), 4) AS semantic_match_score
FROM embeddings v, (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0) q"""


@query(f"{_COSINE} ORDER BY 2 DESC, 1 LIMIT 20")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fx.table(spark, sf_dir, "embeddings")
    q = v.where("vec_id = 0").select("embedding").first()["embedding"]
    return recall.top_similar(recall.similar(v.select("vec_id", "embedding"), q), 20, "vec_id", by="semantic_match_score").select("vec_id", "semantic_match_score")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def embed_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fx.table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return recall.pending(fx.table(spark, sf_dir, "documents").select("doc_id"), v, "doc_id")


def _embedded(spark: SparkSession, sf_dir: str, value) -> DataFrame:
    """Vectors of one number for each document."""
    return fx.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("item_id"), F.md5(F.col("text").cast("binary")).alias("item_hash"), F.lit("m").alias("model"), F.timestamp_seconds(F.lit(fx.EPOCH)).alias("published_at"),
        F.substring("text", 1, 60).alias("title"), F.col("source").alias("source_name"), F.array(value.cast("float")).alias("embedding"), F.col("doc_id"),
    )


@query("""SELECT CAST(doc_id AS VARCHAR) AS item_id, md5(text) AS item_hash, CAST(CASE WHEN doc_id % 4 = 0 THEN -2 WHEN doc_id % 3 = 0 THEN -1 ELSE n_chars END AS DOUBLE) AS value FROM documents""")
def upsert_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors after two rounds of replacement, with a compaction between them."""
    path = store.scratch(spark, "vectors")
    store.upsert_vectors(_embedded(spark, sf_dir, F.col("n_chars")).drop("doc_id"), path)
    store.upsert_vectors(_embedded(spark, sf_dir, F.lit(-1)).where("doc_id % 3 = 0").drop("doc_id"), path)
    store.compact_vectors(spark, path)
    store.upsert_vectors(_embedded(spark, sf_dir, F.lit(-2)).where("doc_id % 4 = 0").drop("doc_id"), path)
    return store.vectors(spark, path).select("item_id", "item_hash", F.element_at("embedding", 1).cast("double").alias("value"))


@query("SELECT CAST(doc_id AS VARCHAR) AS item_id FROM documents WHERE doc_id % 5 <> 0")
def pending_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a vector in a store that has every fifth one's."""
    path, rows = store.scratch(spark, "vectors"), _embedded(spark, sf_dir, F.col("n_chars"))
    store.upsert_vectors(rows.where("doc_id % 5 = 0").drop("doc_id"), path)
    return store.pending_vectors(rows.drop("embedding", "doc_id"), path).select("item_id")


@query("""SELECT r.run_id, r.doc_count, c.category, c.canonical_name, c.mention_count FROM (VALUES (1, 40), (2, 50)) r(run_id, doc_count) JOIN run_candidates c ON c.run_id = (SELECT max(run_id) FROM runs)""", "runs", "run_candidates")
def stored_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest day's candidates written as two discovery runs, read back with their run rows."""
    rows, days = fx.run_candidates(spark, sf_dir)
    newest, root = rows.join(days.agg(F.max("run_id").alias("run_id")), "run_id"), store.scratch(spark, "runs")
    for count in (40, 50):
        store.append_run(newest, root, "m", count)
    return store.runs(spark, root).select("run_id", "doc_count").join(store.run_candidates(spark, root).select("run_id", "category", "canonical_name", "mention_count"), "run_id")


def _neighbours(rows: DataFrame, reach: int = 3) -> DataFrame:
    """(a, b) structs of each item and the ``reach`` that arrive next."""
    packed = rows.select("ord", F.struct(*rows.columns).alias("s"))
    left = packed.select(F.col("s").alias("a"), F.explode(F.array(*[F.col("ord") + k for k in range(1, reach + 1)])).alias("ord"))
    return left.join(packed.withColumnRenamed("s", "b"), "ord").select("a", "b")


@query("""SELECT a.id AS a, b.id AS b, round(CASE WHEN len(a.t) = 0 OR len(b.t) = 0 THEN 0 ELSE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) END::DOUBLE, 6) AS score
FROM tokens a JOIN tokens b ON b.ord BETWEEN a.ord + 1 AND a.ord + 3""", "tokens")
def title_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _neighbours(fx.raw_feed(spark, sf_dir).select("id", "ord", title_tokens(F.col("title")).alias("t")))
    return pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.round(jaccard(F.col("a.t"), F.col("b.t")), 6).alias("score"))


_OVERLAP = """SELECT p.a, p.b, p.bucket, sum(least(coalesce(x.w, 0), coalesce(y.w, 0))) / nullif(sum(greatest(coalesce(x.w, 0), coalesce(y.w, 0))), 0) AS s
FROM (SELECT a.id AS a, b.id AS b, k.bucket FROM raw a JOIN raw b ON b.ord BETWEEN a.ord + 1 AND a.ord + 3, (VALUES ('projects'), ('tokens'), ('chains'), ('topics')) k(bucket)) p
JOIN (SELECT DISTINCT bucket, key FROM weights) u ON u.bucket = p.bucket
LEFT JOIN weights x ON x.id = p.a AND x.bucket = u.bucket AND x.key = u.key LEFT JOIN weights y ON y.id = p.b AND y.bucket = u.bucket AND y.key = u.key GROUP BY p.a, p.b, p.bucket"""


@query(f"SELECT a, b, bucket, round(coalesce(s, 0), 6) AS score FROM ({_OVERLAP})", "raw", "weights")
def weighted_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["projects", "tokens", "chains", "topics"]
    pairs = _neighbours(similarity.with_weights(_items(spark, sf_dir)).select("id", "ord", *[f"w_{k}" for k in names]))
    score = lambda k: F.struct(F.lit(k).alias("bucket"), F.round(similarity.weighted_jaccard(F.col(f"a.w_{k}"), F.col(f"b.w_{k}")), 6).alias("score"))
    return pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.explode(F.array(*map(score, names))).alias("s")).select("a", "b", "s.bucket", "s.score")


@query(f"""SELECT a, b, round(CASE WHEN e = 0 THEN 0 WHEN o = 0 AND t < 0.4 THEN 0 ELSE e + 0.2::DOUBLE + o + 0.18 * t END, 6) AS score FROM (
SELECT x.a, x.b, x.o, CASE WHEN i.event_type = j.event_type THEN 0.35 WHEN 'unknown' IN (i.event_type, j.event_type) THEN 0.12 ELSE 0 END::DOUBLE AS e,
CASE WHEN len(m.t) = 0 OR len(n.t) = 0 THEN 0 ELSE len(list_intersect(m.t, n.t)) / len(list_distinct(list_concat(m.t, n.t))) END::DOUBLE AS t
FROM (SELECT a, b, sum(coalesce(s, 0) * CASE bucket WHEN 'projects' THEN 0.3 WHEN 'tokens' THEN 0.18 WHEN 'chains' THEN 0.12 ELSE 0.1 END::DOUBLE) AS o FROM ({_OVERLAP}) GROUP BY a, b) x
JOIN items i ON i.id = x.a JOIN items j ON j.id = x.b JOIN tokens m ON m.id = x.a JOIN tokens n ON n.id = x.b)""", "items", "weights", "tokens")
def pair_match_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _neighbours(similarity.with_weights(_items(spark, sf_dir)).drop("content", "summary"))
    return pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.round(similarity.match_score("a", "b"), 6).alias("score"))


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).withColumn("day", F.floor(F.unix_seconds("published_at") / 86400).cast("long"))


@query("""SELECT event_id, head_id, title, event_type, importance_score, n_items, points, risks FROM rolled""", "rolled")
def cluster_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greedy clusters of all items, whatever their number."""
    return cluster.cluster_timeline(_items(spark, sf_dir)).select("event_id", "head_id", "title", "event_type", "importance_score", "n_items", F.array_join("key_points", "|").alias("points"), F.size("risks").alias("risks"))


#: Rows that a task makes pairs of, each with a few hundred others.
ROWS_PAIRED = 20_000


@query("""SELECT a.id AS a, b.id AS b FROM items a JOIN items b ON a.id < b.id AND abs(a.at_s - b.at_s) <= 172800 AND (a.event_type = b.event_type OR 'unknown' IN (a.event_type, b.event_type))""", "items")
def pair_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of items that are near in time and may be of one type."""
    items = store.staged(_items(spark, sf_dir).select("id", "event_type", "published_at"), "items")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-items.count() // ROWS_PAIRED))
    return similarity.near_pairs(items, parts).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cluster.rollup_input(_days(spark, sf_dir)).withColumn("kind", F.col("event_type"))
    return cluster.roll_up(rows, "kind", "day")


@query("SELECT event_id, event_type, day, title, first_at, last_at, importance_score, round(avg_credibility, 6) AS avg_credibility, n_items, CASE WHEN event_type = 'exploit' THEN 1 ELSE 0 END AS risks FROM clusters", "clusters")
def cluster_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = ["id", "ord", "title", "summary", "event_type", "published_at", "importance_score", "credibility_score", "entities", "day"]
    rows = store.staged(_days(spark, sf_dir).select(*used, F.col("event_type").alias("kind")), "items")
    return cluster.merged_roll_up(rows, "kind", "day").select(
        "event_id", "event_type", "day", "title", F.unix_seconds("first_seen_at").alias("first_at"), F.unix_seconds("last_updated_at").alias("last_at"), "importance_score",
        F.round("avg_credibility", 6).alias("avg_credibility"), "n_items", F.size("risks").alias("risks"),
    )


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.scored(_clusters(spark, sf_dir), fx.profiles(spark), fx.now_of(spark, sf_dir))


@query("SELECT event_id, " + ", ".join(f"round({s}, 6) AS {s}" for s in rank.WEIGHTS) + " FROM signals", "signals")
def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("event_id", *[F.round(F.col("signals")[s], 6).alias(s) for s in rank.WEIGHTS])


@query("SELECT event_id, round(" + " + ".join(f"{w} * {s}" for s, w in rank.WEIGHTS.items()) + ", 3) AS score FROM signals", "signals")
def feed_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = sum((w * F.col("signals")[s] for s, w in rank.WEIGHTS.items()), F.lit(0.0))
    return _scored(spark, sf_dir).select("event_id", F.round(total, 3).alias("score"))


@query("""SELECT a, b, round(least(coalesce(s, 0) + same, 1), 6) AS score FROM (
SELECT p.a, p.b, p.same, (SELECT sum(w * n / u) FROM (SELECT k.w, count(*) FILTER (c = 2) AS n, count(*) AS u, max(la) AS la, max(lb) AS lb FROM (
  SELECT t.bucket, t.key, count(*) AS c, max(CASE WHEN t.event_type = p.ta AND t.day = p.da THEN 1 ELSE 0 END) AS la, max(CASE WHEN t.event_type = p.tb AND t.day = p.db THEN 1 ELSE 0 END) AS lb
  FROM terms t WHERE (t.event_type = p.ta AND t.day = p.da) OR (t.event_type = p.tb AND t.day = p.db) GROUP BY t.bucket, t.key) q
  JOIN (VALUES ('projects', 0.34), ('tokens', 0.2), ('topics', 0.2), ('chains', 0.1)) k(bucket, w) ON k.bucket = q.bucket GROUP BY k.bucket, k.w) WHERE la = 1 AND lb = 1) AS s
FROM (SELECT event_id AS a, event_type AS ta, day AS da, lead(event_id) OVER o AS b, lead(event_type) OVER o AS tb, lead(day) OVER o AS db,
  CASE WHEN event_type = lead(event_type) OVER o THEN 0.16 ELSE 0 END AS same FROM clusters WINDOW o AS (PARTITION BY day ORDER BY event_id)) p WHERE p.b IS NOT NULL)""", "clusters", "terms")
def pair_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _clusters(spark, sf_dir).select("day", F.struct("event_id", "event_type", "entities").alias("a"))
    pairs = c.withColumn("b", F.lead("a").over(Window.partitionBy("day").orderBy("a.event_id"))).where("b is not null")
    return pairs.select(F.col("a.event_id").alias("a"), F.col("b.event_id").alias("b"), F.round(similarity.redundancy(F.col("a"), F.col("b")), 6).alias("score"))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's feed of the fixture profile: ``user_id`` is the user and the day."""
    rows = _scored(spark, sf_dir).withColumn("user_id", F.concat_ws("/", "user_id", F.col("day").cast("string")))
    return rank.raw_ranked(rows)


def _ranked_once(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """What a rerank needs of ``_ranked``, and ``more``, staged: for queries that read it several times, each of which would normalise all items anew."""
    return store.staged(_ranked(spark, sf_dir).select("user_id", "event_id", "raw_rank", "score", "event_type", "entities", *more), "ranked")


@query("SELECT user_id, event_id, raw_rank, rank FROM \"order\"", "order")
def mmr_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.rerank(_ranked(spark, sf_dir))


_SHARES = ", ".join(f"round({w}::DOUBLE * o.{n}, 4) AS {n}" for n, w in rank.WEIGHTS.items())


@query(f"""SELECT o.user_id, o.rank, o.raw_rank, o.event_id, o.title, o.event_type, round(o.score, 3) AS score, {_SHARES},
  CASE WHEN list_contains(o.projects, 'beta') THEN 'Beta' ELSE '' END AS matched_projects,
  array_to_string(list_filter(['Alpha', 'Origin', 'With'], lambda x: list_contains(list_concat(o.projects, o.tokens, o.topics, o.chains), lower(x))), '|') AS matched_interests,
  CASE WHEN list_contains(o.topics, 'state') THEN 'State' ELSE '' END AS matched_mutes,
  coalesce((SELECT string_agg(bucket || ':' || canonical || ':' || level, '|' ORDER BY bucket || ':' || canonical || ':' || level) FROM conf c WHERE c.id = f.id), '') AS evidence
FROM (SELECT r.*, importance AS importance_score FROM "order" r) o JOIN (SELECT event_type, day, arg_min(id, (at_s, ord)) AS id FROM (SELECT *, at_s // 86400 AS day FROM items) GROUP BY ALL) f ON f.event_type = o.event_type AND f.day = o.day""", "order", "conf", "items")
def explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ranked_once(spark, sf_dir, "title", "signals", "followed_projects", "interests", "muted_topics", "items")
    made = rank.explained(rows, rank.rerank(rows))
    joined = lambda c: F.array_join(c, "|").alias(c)
    evidence = F.array_join(F.array_sort(F.transform("evidence", lambda e: F.concat_ws(":", e["bucket"], e["name"], e["level"]))), "|")
    shares = [F.col("contributions")[n].alias(n) for n in rank.WEIGHTS]
    return made.select("user_id", "rank", "raw_rank", "event_id", "title", "event_type", F.round("score", 3).alias("score"), *shares, *map(joined, ("matched_projects", "matched_interests", "matched_mutes")), evidence.alias("evidence"))


@query("""SELECT CAST((rank - 1) // 2 AS INTEGER) AS page, CAST((rank - 1) % 2 AS INTEGER) AS place, event_id, n > ((rank - 1) // 2 + 1) * 2 AS has_more
FROM (SELECT *, count(*) OVER () AS n FROM "order" WHERE day = (SELECT max(day) FROM "order")) WHERE rank <= 6""", "order")
def feed_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three pages of the newest day's feed."""
    rows = _ranked_once(spark, sf_dir, "day")
    today = rows.join(rows.agg(F.max("day").alias("day")), "day")
    order = store.staged(rank.rerank(today), "order")
    return reduce(DataFrame.unionByName, [rank.page_of(order, page, 2) for page in range(3)]).select("page", "place", "event_id", "has_more")


def _known(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(Lexicon().known_keys(), "category string, key string")


@query("SELECT category, key, key AS canonical_name, mention_count, doc_count FROM candidates", "candidates")
def candidate_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.aggregated(fx.mentions(spark, sf_dir), _known(spark)).select("category", "key", "canonical_name", "mention_count", "doc_count")


@query("""SELECT category, name AS key, string_agg(alias, '|' ORDER BY n DESC, o) AS aliases FROM (SELECT category, name, alias, count(*) AS n, min(ord) AS o
FROM mentions WHERE (category, name) IN (SELECT category, key FROM candidates) GROUP BY ALL) GROUP BY ALL""", "mentions", "candidates")
def candidate_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.aggregated(fx.mentions(spark, sf_dir), _known(spark)).select("category", "key", F.array_join("aliases", "|").alias("aliases"))


@query("""SELECT (SELECT count(*) FROM mentions) AS mentions, 0 AS filtered, 0 AS known, count(*) AS keys, count(*) FILTER (n < 2 OR d < 2) AS below_threshold
FROM (SELECT category, name, count(*) AS n, count(DISTINCT title) AS d FROM mentions GROUP BY ALL)""", "mentions")
def discovery_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.discovery_counters(fx.mentions(spark, sf_dir), _known(spark))


@query("SELECT batch_id, category, count(*) AS n FROM mentions GROUP BY ALL", "mentions")
def batch_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.batch_histogram(fx.mentions(spark, sf_dir)).select("batch_id", F.explode("categories").alias("category", "n"))


@query("""SELECT category, key, CAST(sum(mention_count) AS BIGINT) AS mention_count FROM (SELECT category, CASE WHEN key = 'name 2' THEN 'name 3' ELSE key END AS key, mention_count
FROM candidates WHERE key <> 'name 1') GROUP BY ALL""", "candidates")
def review_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = vocab.aggregated(fx.mentions(spark, sf_dir), _known(spark))
    made = c.where("key in ('name 1', 'name 2')").select(
        F.concat_ws("::", "category", "canonical_name").alias("source_id"), F.when(F.col("key") == "name 1", "drop").otherwise("merge").alias("action"),
        F.col("category").alias("final_category"), F.when(F.col("key") == "name 2", "name 3").otherwise("").alias("final_canonical_name"), F.array().cast("array<string>").alias("final_aliases"), F.lit(1).alias("ord"),
    )
    return vocab.reviewed(c, made).select("category", "key", "mention_count")


def _recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.recent(*fx.run_candidates(spark, sf_dir))


@query("SELECT category, canonical_name, run_hits, total_mentions, max_doc_count, source_diversity, round(decay, 3) AS decayed_run_score FROM promoted", "promoted")
def promotion_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.promoted(_recent(spark, sf_dir)).select("category", "canonical_name", "run_hits", "total_mentions", "max_doc_count", "source_diversity", F.round("decayed_run_score", 3).alias("decayed_run_score"))


def _lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot after one run: names of the older runs were there before, one third of them cooling, one third archived."""
    candidates, runs = fx.run_candidates(spark, sf_dir)
    n = F.substring("canonical_name", 6, 4).cast("int")
    state = F.when(n % 3 == 0, "active").when(n % 3 == 1, "cooling").otherwise("archived")
    none, texts = F.lit(None), F.array().cast("array<string>")
    old = candidates.select(F.concat(F.col("category"), F.when(n % 2 == 0, "").otherwise("-old")).alias("category"), "canonical_name", state.alias("status")).distinct().select(
        "category", "canonical_name", "status", *[F.lit(1).cast("long").alias(c) for c in ("run_hits", "total_mentions", "max_doc_count", "source_diversity")], F.lit(1.0).alias("decayed_run_score"),
        *[texts.alias(c) for c in ("aliases", "evidence_titles", "source_names")], *[F.lit(1).cast("long").alias(c) for c in ("last_seen_run_id", "last_qualified_run_id", "last_evaluated_run_id", "stale_cycles")],
        *[none.cast("timestamp").alias(c) for c in ("cooling_started_at", "archived_at", "promoted_at")],
    )
    recent = _recent(spark, sf_dir)
    seen = recent.groupBy("category", "canonical_name").agg(F.max("run_id").alias("last_seen_run_id"))
    run_id = runs.agg(F.max("run_id")).first()[0]
    return vocab.lifecycle(vocab.promoted(recent), old, seen, run_id, F.timestamp_seconds(F.lit(fx.EPOCH)))


_LIFE = """SELECT coalesce(p.category, o.category) AS category, coalesce(p.canonical_name, o.canonical_name) AS canonical_name,
CASE WHEN p.category IS NOT NULL THEN 'active' WHEN o.status = 'archived' THEN 'archived' WHEN o.status = 'cooling' THEN 'archived' ELSE 'cooling' END AS status,
CASE WHEN p.category IS NOT NULL THEN 0 ELSE 2 END AS stale_cycles FROM promoted p FULL JOIN (SELECT DISTINCT category || CASE WHEN n % 2 = 0 THEN '' ELSE '-old' END AS category, canonical_name,
CASE n % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'cooling' ELSE 'archived' END AS status FROM (SELECT *, CAST(substr(canonical_name, 6) AS INTEGER) AS n FROM run_candidates)) o
ON o.category = p.category AND o.canonical_name = p.canonical_name"""


@query(_LIFE, "promoted")
def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lifecycle(spark, sf_dir).select("category", "canonical_name", "status", "stale_cycles")


@query(f"SELECT status, count(*) AS n FROM ({_LIFE}) GROUP BY status", "promoted")
def export_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.status_counts(_lifecycle(spark, sf_dir))


@query(f"SELECT category, canonical_name AS key, canonical_name AS aliases FROM ({_LIFE}) WHERE status = 'active'", "promoted")
def export_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.exported(_lifecycle(spark, sf_dir)).select("category", "key", F.array_join("aliases", "|").alias("aliases"))


@query("SELECT max(run_id) AS latest_run_id FROM runs", "runs")
def newest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.newest_run(fx.run_candidates(spark, sf_dir)[1])


@query("""SELECT category, key AS canonical_name, row_number() OVER (ORDER BY doc_count DESC, mention_count DESC, category, key) AS place FROM candidates""", "candidates")
def candidate_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vocab.aggregated(fx.mentions(spark, sf_dir), _known(spark))
    return rows.select("category", "canonical_name", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*vocab.count_order())).cast("long").alias("place"))


@query("""SELECT category, name AS key, array_to_string(list_sort(list(DISTINCT title))[1:5], '|') AS titles, array_to_string(list_sort(list(DISTINCT source))[1:8], '|') AS sources
FROM mentions WHERE (category, name) IN (SELECT category, key FROM candidates) GROUP BY ALL""", "mentions", "candidates")
def candidate_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vocab.aggregated(fx.mentions(spark, sf_dir), _known(spark))
    return rows.select("category", "key", F.array_join("evidence_titles", "|").alias("titles"), F.array_join("source_names", "|").alias("sources"))


_PLACED = """row_number() OVER (ORDER BY round(decay, 4) DESC, run_hits DESC, source_diversity DESC, total_mentions DESC, max_doc_count DESC, category, canonical_name)"""


@query(f"SELECT category, canonical_name, {_PLACED} AS place FROM promoted", "promoted")
def promoted_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*vocab.score_order())).cast("long")
    return vocab.promoted(_recent(spark, sf_dir)).select("category", "canonical_name", place.alias("place"))


@query("""SELECT * FROM (
SELECT 'cleaning' AS reason, category, name AS canonical_name, n AS count, NULL::BIGINT AS doc_count, row_number() OVER (ORDER BY n DESC, category, name) AS place
  FROM (SELECT category, name, count(*) AS n FROM odd WHERE noise GROUP BY ALL) UNION ALL
SELECT 'existing', category, title, n, NULL, row_number() OVER (ORDER BY n DESC, category, title) FROM (SELECT category, 'name 3' AS title, count(*) AS n FROM odd WHERE name = 'name 3' GROUP BY ALL) UNION ALL
SELECT 'threshold', category, key, n, d, row_number() OVER (ORDER BY d DESC, n DESC, category, key) FROM (
  SELECT category, key, count(*) AS n, count(DISTINCT title) AS d FROM odd WHERE NOT noise AND name <> 'name 3' GROUP BY ALL) WHERE n < 40 OR d < 40) WHERE place <= 10""", "odd")
def discovery_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.discovery_examples(fx.odd_mentions(spark, sf_dir), _odd_known(spark), 40, 40).select("reason", "category", "canonical_name", "count", "doc_count", F.col("place").cast("long").alias("place"))


def _odd_known(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, "name 3") for c in ("project", "token", "topic", "event_keyword")], "category string, key string")


@query("""SELECT category, key, count(*) AS mention_count, count(DISTINCT title) AS doc_count FROM odd WHERE NOT noise AND name <> 'name 3' GROUP BY ALL HAVING count(*) >= 2 AND count(DISTINCT title) >= 2""", "odd")
def noisy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roll-up of mentions with noise, names of the vocabulary, suffixes and rewrites."""
    return vocab.aggregated(fx.odd_mentions(spark, sf_dir), _odd_known(spark)).select("category", "key", "mention_count", "doc_count")


@query("SELECT batch_id, count(*) AS n_docs, md5(string_agg(chunk, chr(10) ORDER BY ord)) AS prompt_md5 FROM (SELECT *, '[DOC ' || row_number() OVER (PARTITION BY batch_id ORDER BY ord) || ']' || chr(10) || 'title: ' || title || chr(10) || 'source: ' || source_name || chr(10) || 'content: ' || substr(content, 1, 500) || chr(10) AS chunk FROM (SELECT *, doc_id // 12 AS batch_id FROM raw)) GROUP BY batch_id", "raw")
def batch_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.raw_feed(spark, sf_dir).withColumn("batch_id", F.floor(F.col("ord") / 12).cast("long"))
    n = rows.groupBy("batch_id").agg(F.count("*").alias("n_docs"))
    return batch_prompt(rows).join(n, "batch_id").select("batch_id", "n_docs", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


@query("SELECT DISTINCT CAST(doc_id AS VARCHAR) AS item_id, md5(text) AS item_hash FROM documents")
def indexer_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector index that a stream over the documents fills."""
    rows = fx.table_stream(spark, sf_dir, "documents")
    items = rows.select(
        F.col("doc_id").cast("string").alias("item_id"), F.md5(F.col("text").cast("binary")).alias("item_hash"), F.lit("m").alias("model"),
        F.timestamp_seconds(F.lit(fx.EPOCH)).alias("published_at"), F.substring("text", 1, 60).alias("title"), F.col("source").alias("source_name"), "n_chars",
    )
    path = store.scratch(spark, "vectors")
    embed = lambda df: df.withColumn("embedding", F.array(F.col("n_chars").cast("float")))
    indexer.index_stream(items, embed, path, store.scratch(spark, "indexer")).awaitTermination()
    return store.vectors(spark, path).select("item_id", "item_hash")


@query("""SELECT CAST(user_id AS VARCHAR) AS user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS page, CAST(event_id AS VARCHAR) AS events, false AS has_more FROM events""")
def session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a stream of requests, one for each event, that offers it and what was offered with the one before."""
    rows = fx.table_stream(spark, sf_dir, "events")
    asked = rows.select(F.col("user_id").cast("string").alias("user_id"), (F.lit(fx.EPOCH * 1000) + F.col("event_id")).alias("at"), F.lit(1).alias("most"), F.array(F.col("event_id").cast("string"), F.col("event_id").cast("string")).alias("offered"))
    path = store.scratch(spark, "pages")
    pages = indexer.session_stream(asked, ttl_ms=1 << 36)
    pages.writeStream.format("parquet").option("path", path).option("checkpointLocation", store.scratch(spark, "sessions")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return store.table_or_empty(spark, path, indexer.SESSION_OUT).select("user_id", "page", F.array_join("events", "|").alias("events"), "has_more")


@query("SELECT user_id, rank, raw_rank, event_id, title, event_type, round(score, 3) AS score, n_items FROM \"order\"", "order")
def daily_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day's clusters ranked and reranked for the fixture profile."""
    rows = _ranked_once(spark, sf_dir, "title", "n_items")
    order = rank.rerank(rows).select("user_id", "event_id", "rank")
    return rows.join(order, ["user_id", "event_id"]).select("user_id", "rank", "raw_rank", "event_id", "title", "event_type", F.round("score", 3).alias("score"), "n_items")


def personal_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the first pages of the fixture profile's feed, from recall over clusters, ranking and the session."""
    feed, vector, cursor, out = _news(spark, sf_dir), _query_vector(spark, sf_dir), None, []
    for page in range(3):
        answer = feed.personal_feed(fx.profiles(spark), 5, cursor, query_vector=vector)
        out += [(page, i, c["event_id"], c["title"], c["event_type"], float(c["score"]), c["n_items"], answer["has_more"]) for i, c in enumerate(answer["clusters"])]
        cursor = answer["next_cursor"]
        if not cursor:
            break
    return spark.createDataFrame(out, "page int, place int, event_id string, title string, event_type string, score double, n_items long, has_more boolean")


QUERIES["personal_feed"] = personal_feed
