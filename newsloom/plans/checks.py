"""Queries that hold single functions, calls and stores of the engine against SQL."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import hooks, recall, vocab
from ..operators.normalize import normalize
from ..sources import feeds, store
from ..vocabulary import EVENT_TYPES, PRESENCE
from . import fixtures as fx
from . import feed as fd
from .catalogue import _LIFE, _feed, _items, _lifecycle, _news, _recent, query

_SUMMARY = "substr(trim(regexp_replace(content, '\\s+', ' ', 'g')), 1, 120) || CASE WHEN length(trim(regexp_replace(content, '\\s+', ' ', 'g'))) > 120 THEN '...' ELSE '' END"
_TERMS = """coalesce((SELECT string_agg(canonical, ', ' ORDER BY CASE bucket WHEN 'projects' THEN 0 WHEN 'tokens' THEN 1 WHEN 'chains' THEN 2 ELSE 3 END, co)
FROM (SELECT DISTINCT e.id, e.bucket, e.canonical, l.co FROM ent e JOIN lex l ON l.bucket = e.bucket AND l.canonical = e.canonical) t WHERE t.id = i.id), '')"""


@query(f"""SELECT id, md5('Title: ' || title || chr(10) || 'Summary: ' || {_SUMMARY} || chr(10) || 'Content: ' || substr(content, 1, 800) || chr(10) || 'Entities: ' || {_TERMS}
|| chr(10) || 'Event type: ' || event_type || chr(10) || 'Source: ' || source_name) AS item_hash FROM items i""", "items", "ent", "lex")
def item_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of the text that stands for each item."""
    return _items(spark, sf_dir).select("id", tx.content_hash().alias("item_hash"))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as profiles: the segment is the interest, every other one follows a project, every third mutes a topic."""
    key = F.col("c_custkey")
    some = lambda n, name: F.when(key % n == 0, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    return fx.table(spark, sf_dir, "customer").select(
        key.cast("string").alias("user_id"), F.array("c_mktsegment").alias("interests"), some(3, "State").alias("muted_topics"), some(5, "en").alias("preferred_languages"),
        some(2, "Alpha").alias("followed_projects"), some(7, "k").alias("followed_kols"), F.when(key % 4 == 0, "high").otherwise("medium").alias("risk_preference"),
    )


_CUSTOMERS = """(SELECT *, c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'State' END AS muted, CASE WHEN c_custkey % 5 = 0 THEN 'en' END AS lang, CASE WHEN c_custkey % 2 = 0 THEN 'Alpha' END AS follows,
CASE WHEN c_custkey % 7 = 0 THEN 'k' END AS kol, CASE WHEN c_custkey % 4 = 0 THEN 'high' ELSE 'medium' END AS risk FROM customer)"""
_ARRAY = "coalesce('[\"' || {0} || '\"]', '[]')"


@query(f"""SELECT CAST(k AS VARCHAR) AS user_id, md5('User interest profile for crypto content retrieval.' || chr(10) || 'Interests: ' || c_mktsegment || chr(10) || 'Followed projects: ' || coalesce(follows, 'none') || chr(10)
|| 'Muted topics: ' || coalesce(muted, 'none') || chr(10) || 'Risk preference: ' || risk || chr(10) || 'Preferred languages: ' || coalesce(lang, 'zh') || chr(10) || 'Current user request: etf') AS query_md5,
'interests: ' || c_mktsegment || coalesce('; follows: ' || follows, '') || coalesce('; mutes: ' || muted, '') || '; risk: ' || risk || coalesce('; languages: ' || lang, '') AS summary,
sha256('{{"followed_kols":' || {_ARRAY.format("kol")} || ',"followed_projects":' || {_ARRAY.format("follows")} || ',"interests":["' || c_mktsegment || '"],"muted_topics":' || {_ARRAY.format("muted")}
|| ',"preferred_languages":' || {_ARRAY.format("lang")} || ',"risk_preference":"' || risk || '","user_id":"' || k || '"}}') AS signature FROM {_CUSTOMERS}""")
def profile_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands for each profile: the text to embed, the line about it, its signature."""
    return _customers(spark, sf_dir).select("user_id", F.md5(tx.profile_query(F.lit(" etf ")).cast("binary")).alias("query_md5"), tx.profile_summary().alias("summary"), tx.profile_signature().alias("signature"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS user_id FROM customer WHERE c_custkey <> 7")
def preset_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presets other than the user's own."""
    return fd.other_presets(_customers(spark, sf_dir), "7").select("user_id")


_WORDS = "array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w, i: CASE WHEN w IN ('and', 'or', 'of', 'the', 'to') AND i > 1 THEN w ELSE upper(w[1]) || w[2:] END), ' ')"


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'given' WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE {_WORDS} END AS display,
CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE {_WORDS} END AS reviewed, lower(p_type) AS topic_key, CASE WHEN p_partkey % 2 = 0 THEN 'token' ELSE 'topic' END || '::' || p_type AS source_id FROM part""")
def candidate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts as candidates: shown, reviewed, keyed."""
    rows = fx.table(spark, sf_dir, "part").select("p_partkey", "p_type", F.lower("p_type").alias("k"), F.when(F.col("p_partkey") % 2 == 0, "token").otherwise("topic").alias("c"))
    given = F.when(F.col("p_partkey") % 3 == 0, "given")
    padded = F.concat(F.lit(" '"), F.regexp_replace("p_type", " ", "  "), F.lit("' "))
    return rows.select(
        "p_partkey", tx.display_name(F.col("c"), F.col("k"), given).alias("display"), tx.review_name(F.col("c"), F.col("k")).alias("reviewed"),
        tx.category_key(F.lit("topic"), tx.candidate_key(padded)).alias("topic_key"), tx.source_id(F.col("c"), F.col("p_type")).alias("source_id"),
    )


_CONTEXTS = ("the agent left", "an agent with ai tools", "agent of a wallet", "an on-chain agent", "low yield", "bond yield and defi yield", "yield farming", "staking gives yield")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, doc_id % 8 IN (1, 2, 3) AS agent, doc_id % 8 = 6 AS yield FROM documents")
def guarded_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases that count in some contexts only, in one of eight for each document."""
    doc = F.col("doc_id")
    said = F.element_at(F.array(*map(F.lit, _CONTEXTS)), (doc % 8 + 1).cast("int"))
    rows = fx.table(spark, sf_dir, "documents").select(doc.cast("string").alias("id"), F.concat(said, F.lit(". "), doc.cast("string")).alias("t"))
    return rows.select("id", tx.contains_topic(F.col("t"), "agent").alias("agent"), tx.contains_topic(F.col("t"), "yield").alias("yield"))


@query("SELECT category, canonical_name, run_hits + CASE WHEN CAST(substr(canonical_name, 6) AS INTEGER) % 2 = 0 THEN 1 ELSE 0 END AS run_hits FROM promoted", "promoted")
def promoted_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The promoted vocabulary after a second write that replaces every other entry; nothing is there before."""
    root, rows = store.scratch(spark, "promoted"), vocab.promoted(_recent(spark, sf_dir))
    none = store.snapshot(spark, root).select("category", "canonical_name", "run_hits")
    first = feeds.with_defaults(rows, store.PROMOTED)
    store.upsert_promoted(first, root)
    again = F.substring("canonical_name", 6, 4).cast("int") % 2 == 0
    store.upsert_promoted(first.where(again).withColumn("run_hits", F.col("run_hits") + 1), root)
    return store.snapshot(spark, root).select("category", "canonical_name", "run_hits").unionByName(none)


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def pair_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each stored vector and the next."""
    v = fx.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    pairs = v.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")).join(v.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y")), "a")
    return recall.pair_similarity(pairs, "x", "y").select("a", "b", F.round("similarity", 4).alias("similarity"))


@query(f"""SELECT CAST(q AS VARCHAR) AS user_id, CAST(rank AS INTEGER) AS rank, CAST(id AS VARCHAR) AS id, round(s, 6) AS similarity FROM (SELECT q, id, s, row_number() OVER (PARTITION BY q ORDER BY s DESC, id) AS rank FROM (
SELECT a.vec_id AS q, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), {recall.TIE_DIGITS}) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 10 = 0)) WHERE rank <= 12""")
def semantic_recall_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool's twelve nearest vectors for each of many profiles at once."""
    v = fx.table(spark, sf_dir, "embeddings")
    profiles = v.where("vec_id % 10 = 0").select(F.col("vec_id").cast("string").alias("user_id"), F.col("embedding").alias("vector"))
    near = recall.top_similar_batch(profiles, v.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("ord"), "embedding"), 12)
    return near.select("user_id", "rank", "id", F.round("similarity", 6).alias("similarity"))


_FOUND = """SELECT id, at_s, min(r) AS r FROM (SELECT id, at_s, 0 AS r FROM (SELECT * FROM raw ORDER BY at_s DESC LIMIT 30) UNION ALL SELECT id, at_s, 1 FROM (SELECT * FROM raw WHERE feed_type = 'hot_news' ORDER BY at_s DESC LIMIT 30)) GROUP BY id, at_s"""


@query(f"SELECT id, (row_number() OVER (ORDER BY r, at_s DESC) - 1) // 12 AS batch_id FROM ({_FOUND})", "raw")
def discovery_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that discovery reads, cut into batches of twelve."""
    found = feeds.discovery_documents(_feed(spark, sf_dir))
    newest = found.join(_feed(spark, sf_dir).latest(40).select("id", F.lit(0).alias("r")), "id", "left")
    return feeds.chunked(newest, 12, F.coalesce("r", F.lit(1)), F.desc("published_at")).select("id", "batch_id")


@query(f"SELECT id FROM ({_FOUND})", "raw")
def warmup_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that are indexed at the start."""
    return _news(spark, sf_dir).warmup().select("id")


def _shown(items: DataFrame) -> DataFrame:
    return items.select("id", "event_type", "importance_score")


@query("SELECT id, event_type, importance_score FROM items ORDER BY at_s DESC LIMIT 25", "items")
def call_latest_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_news(spark, sf_dir).latest_headlines(25)[0])


@query("SELECT id, event_type, importance_score FROM items ORDER BY at_s DESC LIMIT 25 OFFSET 25", "items")
def call_next_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    news = _news(spark, sf_dir)
    return _shown(news.latest_headlines(25, news.latest_headlines(25)[1]["next_cursor"])[0])


@query("SELECT id, event_type, importance_score FROM items WHERE feed_type = 'pop_info' ORDER BY at_s DESC LIMIT 15", "items")
def call_trending_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_news(spark, sf_dir).trending_feeds("pop_info", 15))


@query("SELECT id, event_type, importance_score FROM items WHERE doc_id % 5 = 0 AND kind = 'key_events' ORDER BY at_s DESC LIMIT 10", "items")
def call_project_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_news(spark, sf_dir).project_feed("tau", "key_events", 10)[0])


@query("SELECT id, event_type, importance_score FROM items WHERE doc_id % 5 = 0 AND kind = 'opinions' ORDER BY at_s DESC LIMIT 20", "items")
def call_project_opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_news(spark, sf_dir).project_opinions("TAU")[0])


@query(f"SELECT category, canonical_name, aliases, status FROM (SELECT CASE bucket WHEN 'projects' THEN 'project' WHEN 'tokens' THEN 'token' ELSE 'topic' END AS category, canonical AS canonical_name, string_agg(alias, '|' ORDER BY ao) AS aliases, 'builtin' AS status FROM lex WHERE bucket <> 'chains' GROUP BY bucket, canonical UNION ALL SELECT category, canonical_name, CASE WHEN EXISTS (SELECT 1 FROM promoted p WHERE p.category = l.category AND p.canonical_name = l.canonical_name) THEN canonical_name ELSE '' END, status FROM ({_LIFE}) l WHERE status <> 'archived')", "promoted", "lex")
def vocabulary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built-in vocabulary and the promoted one that is active or cooling."""
    return store.vocabulary_rows(fx.LEXICON, _lifecycle(spark, sf_dir), spark).select("category", "canonical_name", F.array_join("aliases", "|").alias("aliases"), "status")


@query(f"SELECT id, title, {_SUMMARY} AS summary, event_type, at_s FROM items", "items")
def serialised_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as JSON, read back."""
    read = F.from_json("json", "id string, title string, summary string, event_type string, published_at timestamp").alias("r")
    return fd.serialised(_items(spark, sf_dir)).select(read).select("r.id", "r.title", "r.summary", "r.event_type", F.unix_seconds("r.published_at").alias("at_s"))


@query(f"SELECT id, title, {_SUMMARY} AS summary, event_type, coalesce((SELECT string_agg(DISTINCT canonical, '|' ORDER BY canonical) FROM ent e WHERE e.id = i.id AND e.bucket = 'projects'), '') AS projects FROM items i", "items", "ent")
def compact_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The short form of items that goes into a prompt."""
    return fd.compact(_items(spark, sf_dir)).select("id", "title", "summary", "event_type", F.array_join(F.array_sort("projects"), "|").alias("projects"))


@query("SELECT user_id, array_to_string(list(event_id ORDER BY event_id)[-20:], ',') AS kept, array_to_string(list(event_id ORDER BY event_id)[-10:], ',') AS shown FROM events GROUP BY user_id")
def chat_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept and shown of each user's results, given in two parts."""
    e = fx.table(spark, sf_dir, "events")
    half = lambda rows: rows.groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    middle = e.agg(F.expr("percentile_approx(event_id, 0.5)").alias("m"))
    parted = e.join(F.broadcast(middle), F.lit(True))
    kept = fd.remembered(half(parted.where("event_id <= m")), half(parted.where("event_id > m")), "ids", "shown")
    text = lambda rows, name: rows.select("user_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias(name))
    return text(kept, "kept").join(text(fd.shown_memory(kept, "ids", "shown"), "shown"), "user_id")


@query("SELECT doc_id, source || '|' || coalesce(lang, 'none') || '|é\"' AS read, 3 AS n FROM documents")
def json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays as JSON texts, and back; null and broken texts are empty arrays."""
    rows = fx.table(spark, sf_dir, "documents").select("doc_id", tx.json_text(F.array("source", F.coalesce("lang", F.lit("none")), F.lit('é"'))).alias("t"))
    back = tx.json_list(F.col("t"))
    empty = F.size(tx.json_list(F.lit(None).cast("string"))) + F.size(tx.json_list(F.lit("{"))) + F.size(tx.json_list(F.lit(" ")))
    return rows.select("doc_id", F.array_join(back, "|").alias("read"), (F.size(back) + empty).alias("n"))


def _first_words(prompt: str) -> list[dict]:
    """A rule in place of a model: the first word of each document's title is a topic."""
    found = []
    for title, source in re.findall(r"\[DOC \d+\]\ntitle: ([^\n]*)[\s\S]*?\nsource: ([^\n]*)\n", prompt):
        word = re.search("[a-z0-9]+", title.lower())
        found.append({"category": "topic", "canonical_name": word[0] if word else "", "evidence_title": title, "evidence_source": source})
    return found


@query("""SELECT doc_id // 12 AS batch_id, name AS canonical_name, count(*) AS n, count(DISTINCT title) AS titles FROM (
SELECT doc_id, split_part(title, chr(10), 1) AS title, regexp_extract(lower(split_part(title, chr(10), 1)), '[a-z0-9]+') AS name FROM raw) WHERE name <> '' GROUP BY ALL""", "raw")
def extract_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions that a rule finds in batches of twelve documents."""
    rows = fx.raw_feed(spark, sf_dir).withColumn("batch_id", F.floor(F.col("ord") / 12).cast("long"))
    found = hooks.extracted(tx.batch_prompt(rows), _first_words).where("error is null")
    return found.groupBy("batch_id", "canonical_name").agg(F.count("*").alias("n"), F.countDistinct("evidence_title").alias("titles"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, CAST(length(text) AS DOUBLE) AS size, CAST(length(source) AS DOUBLE) AS other FROM documents")
def embed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that a rule makes of texts: their length, and that of their source."""
    rows = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.concat_ws("\t", "source", "text").alias("text"))
    made = hooks.embedded(rows, lambda texts: [[float(len(t.split("\t", 1)[1])), float(len(t.split("\t", 1)[0]))] for t in texts])
    return made.select("id", F.element_at("embedding", 1).cast("double").alias("size"), F.element_at("embedding", 2).cast("double").alias("other"))


#: Event rules of every kind over the words of the generated texts. Fixed values.
_RULED = replace(
    fx.LEXICON,
    rules={**fx.LEXICON.rules, "token_unlock": ["to"], "partnership": ["at"], "market_structure": ["on"]},
    hints={"listing": ["in"], "funding": ["as"], "market_structure": ["the"]},
    overrides={"Origin": "funding", "Mittel": "product_launch", "State": "partnership"},
    boosts={"listing": (["new"], ["one", "not"], 0.3), "governance": (["more"], [], 0.2), "institutional_adoption": (["you"], ["your"], 0.4)},
)
_RULED_TYPES = [*[e for e in EVENT_TYPES if e in _RULED.rules], "institutional_adoption", "product_launch", "macro"]


def _ruled(event: str) -> tuple[str, str, str]:
    """An event's score in three steps as SQL: topics, words and context; presence of entities, if it scores at all; macro and title."""
    terms = [f"w_{t}" for t, e in _RULED.overrides.items() if e == event] or ["0::DOUBLE"]
    terms += [f"CASE WHEN {fx._any('title', [k])} THEN 0.35::DOUBLE WHEN {fx._any('text', [k])} THEN 0.2::DOUBLE ELSE 0 END" for k in _RULED.rules.get(event, [])]
    if event in _RULED.boosts:
        words, required, boost = _RULED.boosts[event]
        needed = f" AND {fx._any('text', required)}" if required else ""
        terms.append(f"CASE WHEN crypto AND {fx._any('text', words)}{needed} THEN {boost}::DOUBLE ELSE 0 END")
    present = [f"a_{event}"] + [f"CASE WHEN {b} AND a_{event} > 0 THEN {gains[event]}::DOUBLE ELSE 0 END" for b, gains in PRESENCE.items() if event in gains]
    if event == "market_structure":
        present.append(f"CASE WHEN (tokens OR chains) AND a_{event} > 0 THEN 0.08::DOUBLE ELSE 0 END")
    late = [f"b_{event}"] + (["CASE WHEN macro THEN 0.25::DOUBLE ELSE 0 END"] if event == "macro" else [])
    if event in _RULED.hints:
        late.append(f"CASE WHEN {fx._any('title', _RULED.hints[event])} THEN 0.25::DOUBLE ELSE 0 END")
    return tuple(f"{' + '.join(x)} AS {n}_{event}" for n, x in (("a", terms), ("b", present), ("c", late)))


def _step(n: int) -> str:
    return ", ".join(_ruled(e)[n] for e in _RULED_TYPES)


_HAS = ", ".join(f"coalesce(bool_or(bucket = '{b}'), false) AS {b}" for b in ("projects", "tokens", "chains", "topics"))
_WORTH = ", ".join(
    f"coalesce(max(CASE WHEN bucket <> 'topics' OR canonical <> '{t}' THEN 0 WHEN level = 'strong' AND t THEN {0.9 + 0.1} WHEN level = 'strong' THEN 0.9 WHEN level = 'medium' AND t THEN {0.45 + 0.15}"
    f" WHEN level = 'medium' THEN 0.45 WHEN t THEN 0.1 ELSE 0 END), 0)::DOUBLE AS w_{t}"
    for t in _RULED.overrides
)


@query(f"""SELECT id, CASE WHEN macro AND NOT crypto THEN 'macro' WHEN noise AND NOT crypto THEN 'unknown' WHEN top >= 0.35::DOUBLE THEN CASE top {" ".join(f"WHEN c_{e} THEN '{e}'" for e in _RULED_TYPES)} END
WHEN macro THEN 'macro' ELSE 'unknown' END AS event_type FROM (SELECT *, greatest({", ".join(f"c_{e}" for e in _RULED_TYPES)}) AS top FROM (SELECT *, {_step(2)} FROM (SELECT *, {_step(1)} FROM (SELECT *, {_step(0)} FROM (
SELECT *, {fx._any("text", _RULED.macro)} AS macro, contains(lower(text), 'tion') AS noise, projects OR tokens OR chains OR topics AS crypto FROM (
SELECT r.id, any_value(title) AS title, any_value(title || ' ' || content) AS text, {_HAS}, {_WORTH} FROM raw r LEFT JOIN conf c ON c.id = r.id GROUP BY r.id))))))""", "raw", "conf")
def event_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types by rules of every kind: words, titles, topics that stand for an event, words in context, presence of entities."""
    return normalize(fx.raw_feed(spark, sf_dir), _RULED, fx.now_of(spark, sf_dir)).select("id", "event_type")
