"""Raw feed rows to items: coalescing, ids, times, entities with evidence, event type, scores.

One chain of column expressions; nothing is shuffled and no Python runs on rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import clamp
from ..functions.text import Part, contains_column, contains_topic, first_filled, first_run, strip, summary, words_of
from ..vocabulary import EVENT_IMPORTANCE, EVENT_TYPES, PRESENCE, Lexicon
from .aliases import found_aliases, guarded_aliases

_EVIDENCE = "array<struct<name:string,sources:array<string>>>"


def column_or_null(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def parsed_time(c: Column, now: Column) -> Column:
    """Numbers are seconds, or milliseconds above 1e10; text is ISO, UTC unless it says otherwise; anything else is ``now``."""
    text = F.trim(c.cast("string"))
    has_zone = text.rlike(r"[Zz]$|:\d{2}(\.\d+)? ?[+-]\d{2}(:?\d{2})?$")
    zoned = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00Z"))).when(has_zone, text).otherwise(F.concat(text, F.lit("Z")))
    number = text.try_cast("double")
    epoch = F.when(number > 1e10, number / 1000).otherwise(number)
    return F.coalesce(F.timestamp_micros((epoch * 1_000_000).cast("long")), zoned.try_cast("timestamp"), text.try_cast("timestamp"), now)


def base_items(raw: DataFrame, now: Column) -> DataFrame:
    """Identity, text, source and time of each raw row; other columns are dropped but ``ord`` and ``route``."""
    c = lambda n: column_or_null(raw, n)
    title = first_filled(c("translated_title"), c("title"))
    content = first_filled(c("translated_content"), c("content"), c("translated_full_content"), c("full_content"))
    tags = column_or_null(raw, "tags", "array<struct<type:string,name:string,symbol:string>>")
    # A number 0 counts as missing, the text "0" does not.
    missing = [""] if dict(raw.dtypes).get("id", "string") == "string" else ["", "0"]
    identity = F.when(c("id").isNull() | c("id").cast("string").isin(*missing), F.substring(F.md5(F.concat(title, F.coalesce(c("source_url"), F.lit(""))).cast("binary")), 1, 12)).otherwise(c("id").cast("string"))
    return raw.select(
        identity.alias("id"), title.alias("title"), summary(content).alias("summary"), content.alias("content"),
        first_filled(c("source_url"), c("page_url"), c("jump_url")).alias("url"),
        F.coalesce(c("source_name"), F.lit("unknown")).alias("source_type"),
        first_filled(c("source_title"), c("source_name"), default="unknown").alias("source_name"),
        first_filled(c("nickname"), c("username"), default="unknown").alias("author"),
        parsed_time(c("publish_time"), now).alias("published_at"),
        F.coalesce(c("source_lang"), c("language"), F.lit("unknown")).alias("language"),
        F.transform(F.coalesce(tags, F.array().cast("array<struct<type:string,name:string,symbol:string>>")), lambda t: first_filled(t["symbol"], t["name"])).alias("raw_tags"),
        tags.alias("_tags"), *[F.col(x) for x in ("ord", "route", "feed_type", "embedding") if x in raw.columns],
    )


# --- entities ----------------------------------------------------------------


def _found(name: str, hit: Column, sources: list[Column]) -> Column:
    evidence = F.array_distinct(F.filter(F.array(*sources), lambda s: s.isNotNull()))
    return F.when(hit, F.struct(F.lit(name).alias("name"), evidence.alias("sources")))


def _collected(found: list[Column]) -> Column:
    if not found:
        return F.array().cast(_EVIDENCE)
    return F.filter(F.array(*found), lambda s: s.isNotNull()).cast(_EVIDENCE)


def _words(lexicon: Lexicon, aliases: bool) -> list[str]:
    """First runs of the lexicon's event words, and of its aliases."""
    said = [lexicon.macro, *lexicon.rules.values(), *lexicon.hints.values(), *[w for words, required, _ in lexicon.boosts.values() for w in (words, required)]]
    said += [[r[2] for r in lexicon.rows()]] if aliases else []
    return sorted({run for some in said for a in some if (run := first_run(a)) is not None})


def _with_words(items: DataFrame, words: list[str]) -> DataFrame:
    """Adds the words that the lower-case title and body have.

    They pass through a generator of one row, since a filter on what is made of
    them would else be moved below, and there cut a text into words once for each use.
    """
    found = F.struct(*[words_of(F.col(part), words).alias(f"{part}_words") for part in ("_title", "_body")])
    return items.select("*", F.inline(F.array(found)))


def _parts(text: Column) -> tuple[Part, Part, Part]:
    """Title, body, and both joined as ``text``."""
    title, body = F.col("_title_words"), F.col("_body_words")
    return Part(F.col("_title"), title), Part(F.col("_body"), body), Part(text, title, body)


def _by_alias(table: dict[str, list[str]], title: Part, body: Part) -> Column:
    found = []
    for name, aliases in table.items():
        sources = [F.when(part.has(a), F.lit(f"{label}:{a}")) for a in aliases for label, part in (("title", title), ("body", body))]
        found.append(_found(name, title.has_any(aliases) | body.has_any(aliases), sources))
    return _collected(found)


def _topics(table: dict[str, list[str]], title: Part, body: Part, full: Part) -> Column:
    found = []
    for name, aliases in table.items():
        sources, hits = [], []
        for a in aliases:
            hit = full.has_topic(a)
            hits.append(hit)
            sources += [F.when(hit & part.has_topic(a), F.lit(f"{label}:{a}")) for label, part in (("title", title), ("body", body))]
        found.append(_found(name, reduce(Column.__or__, hits), sources))
    return _collected(found)


def guarded_hits(lexicon: Lexicon) -> Column:
    """For each guarded topic alias of the lexicon whether it is in title, body, and both joined; their contexts are expressions."""
    parts = [F.col(c) for c in ("_title", "_body", "_full")]
    hits = [F.array(*[F.coalesce(contains_topic(p, a), F.lit(False)) for p in parts]) for a in guarded_aliases(lexicon)]
    return F.array(*hits) if hits else F.array().cast("array<array<boolean>>")


def _tagged(field: str, source: str, upper: bool) -> Column:
    tokens = F.filter(F.coalesce(F.col("_tags"), F.array().cast("array<struct<type:string,name:string,symbol:string>>")), lambda t: (F.lower(t["type"]) == "token") & (strip(F.coalesce(t[field], F.lit(""))) != ""))
    value = lambda t: F.upper(strip(t[field])) if upper else strip(t[field])
    return F.transform(tokens, lambda t: F.struct(value(t).alias("name"), F.array(F.lit(source)).alias("sources"))).cast(_EVIDENCE)


def _once(evidence: Column) -> Column:
    """Names in first-seen order, each with all its distinct sources."""
    names = F.array_distinct(F.transform(evidence, lambda e: e["name"]))
    own = lambda n: F.array_distinct(F.flatten(F.transform(F.filter(evidence, lambda e: e["name"] == n), lambda e: e["sources"])))
    return F.transform(names, lambda n: F.struct(n.alias("name"), own(n).alias("sources"))).cast(_EVIDENCE)


def _behind_tags(tagged: Column, found: Column) -> Column:
    """Tagged names, each once and with its aliases' sources too, then the other found ones, whose names differ."""
    tags = _once(tagged)
    both = lambda e: F.array_distinct(F.concat(e["sources"], F.flatten(F.transform(F.filter(found, lambda f: f["name"] == e["name"]), lambda f: f["sources"]))))
    named = F.transform(tags, lambda e: e["name"])
    return F.concat(F.transform(tags, lambda e: F.struct(e["name"].alias("name"), both(e).alias("sources"))), F.filter(found, lambda f: ~F.array_contains(named, f["name"]))).cast(_EVIDENCE)


def level_of(bucket: str, sources: Column) -> Column:
    """Confidence in an entity from where it was seen."""
    has = {k: _seen(sources, k) for k in ("tag:", "title:", "body:")}
    out = F.when(has["tag:"] & (has["title:"] | has["body:"]), "strong").when(has["title:"] & has["body:"], "strong").when(has["title:"], "medium")
    if bucket in ("chains", "topics"):
        out = out.when(has["body:"], "strong")
    return out.when(has["tag:"], "medium").otherwise("weak")


def _seen(sources: Column, kind: str) -> Column:
    return F.exists(sources, lambda s: s.startswith(kind))


#: From so many aliases on, texts are read once for all of them instead of once for each.
MANY_ALIASES = 64


def with_entities(items: DataFrame, lexicon: Lexicon, one_pass: bool | None = None) -> DataFrame:
    """Adds ``evidence`` (bucket -> entities with sources), ``entities``, ``entity_sources`` and ``entity_confidence``.

    A small lexicon becomes expressions, one for each alias.  A large one becomes
    an automaton that finds all aliases in one pass over a text; which of the two
    is decided by the number of aliases, unless ``one_pass`` says it.
    """
    items = items.withColumns({"_title": F.lower("title"), "_body": F.lower("content")}).withColumn("_full", strip(F.concat_ws(" ", "_title", "_body")))
    if one_pass is None:
        one_pass = len(lexicon.rows()) >= MANY_ALIASES
    if one_pass:
        items = items.withColumn("_found", found_aliases(items.sparkSession, lexicon)("_title", "_body", guarded_hits(lexicon)))
        seen = {b: F.col("_found")[b] for b in ("projects", "tokens", "chains", "topics")}
    else:
        items = _with_words(items, _words(lexicon, True))
        title, body, full = _parts(F.col("_full"))
        seen = {
            "projects": _by_alias(lexicon.projects, title, body), "tokens": _by_alias(lexicon.tokens, title, body),
            "chains": _by_alias({c.title(): [c] for c in lexicon.chains}, title, body), "topics": _topics(lexicon.topics, title, body, full),
        }
    evidence = {
        "projects": _behind_tags(_tagged("name", "tag:name", False), seen["projects"]),
        "tokens": _behind_tags(_tagged("symbol", "tag:symbol", True), seen["tokens"]),
        "chains": seen["chains"],
        "topics": seen["topics"],
        "people": F.array().cast(_EVIDENCE),
    }
    items = items.withColumns({f"_{b}": e for b, e in evidence.items()})
    names = F.struct(*[F.transform(f"_{b}", lambda e: e["name"]).alias(b) for b in evidence])
    shown = {b: F.filter(f"_{b}", lambda e: F.size(e["sources"]) > 0) for b in evidence}
    entry = lambda e: F.struct(e["name"], e["sources"])
    sources = F.create_map(*[x for b in evidence for x in (F.lit(b), F.map_from_entries(F.transform(shown[b], entry)))])
    levels = F.create_map(*[x for b in evidence for x in (F.lit(b), F.map_from_entries(_levels(b, shown[b])))])
    return items.drop("_found").withColumns({"entities": names, "entity_sources": sources, "entity_confidence": levels})


def _levels(bucket: str, evidence: Column) -> Column:
    return F.transform(evidence, lambda e: F.struct(e["name"], level_of(bucket, e["sources"])))


# --- event type --------------------------------------------------------------


def _topic_event(name: Column, lexicon: Lexicon) -> Column:
    plain = F.lower(F.replace(name, F.lit(" "), F.lit("_")))
    out = F.when(plain.isin(*EVENT_TYPES[:-1]), plain)
    for topic, event in lexicon.overrides.items():
        out = F.when(name == topic, F.lit(event)).otherwise(out)
    return out


def event_scores(lexicon: Lexicon) -> dict[str, Column]:
    """Score of each event type for an item with entities, in declaration order."""
    title, _, text = _parts(F.col("_text"))
    size = lambda b: F.size(F.col("entities")[b])
    crypto = (size("projects") > 0) | (size("tokens") > 0) | (size("chains") > 0) | (size("topics") > 0)
    order = [*[e for e in EVENT_TYPES if e in lexicon.rules], "institutional_adoption", "product_launch", "macro"]

    def from_topics(event: str) -> Column:
        mine = F.filter("_topics", lambda t: _topic_event(t["name"], lexicon) == event)

        def worth(t: Column) -> Column:
            level, titled = level_of("topics", t["sources"]), _seen(t["sources"], "title:")
            return F.when(level == "strong", F.when(titled, 0.9 + 0.1).otherwise(0.9)).when(level == "medium", F.when(titled, 0.45 + 0.15).otherwise(0.45)).otherwise(F.when(titled, 0.1).otherwise(0.0))

        return F.aggregate(mine, F.lit(0.0), lambda a, t: a + worth(t))

    scores = {}
    for event in order:
        s = from_topics(event)
        for k in lexicon.rules.get(event, []):
            s = s + F.when(title.has(k), 0.35).when(text.has(k), 0.20).otherwise(0.0)
        if event in lexicon.boosts:
            keywords, required, boost = lexicon.boosts[event]
            hit = crypto & text.has_any(keywords)
            s = s + F.when(hit & text.has_any(required) if required else hit, boost).otherwise(0.0)
        for bucket, gains in PRESENCE.items():
            if event in gains:
                s = s + F.when((size(bucket) > 0) & (s > 0), gains[event]).otherwise(0.0)
        if event == "market_structure":
            s = s + F.when(((size("tokens") > 0) | (size("chains") > 0)) & (s > 0), 0.08).otherwise(0.0)
        if event == "macro":
            s = s + F.when(F.col("_macro"), 0.25).otherwise(0.0)
        if event in lexicon.hints:
            s = s + F.when(title.has_any(lexicon.hints[event]), 0.25).otherwise(0.0)
        scores[event] = s
    return scores


def with_event_type(items: DataFrame, lexicon: Lexicon, least: float = 0.35) -> DataFrame:
    """Adds ``event_type``; ties go to the type declared first."""
    items, text = items.withColumn("_text", F.lower(F.concat_ws(" ", "title", "content"))), F.col("_text")
    noise = reduce(Column.__or__, [text.contains(k) for k in lexicon.noise], F.lit(False))
    if "_title_words" not in items.columns:
        items = _with_words(items, _words(lexicon, False))
    items = items.withColumn("_macro", _parts(text)[2].has_any(lexicon.macro))
    size = lambda b: F.size(F.col("entities")[b])
    crypto = (size("projects") > 0) | (size("tokens") > 0) | (size("chains") > 0) | (size("topics") > 0)
    scores = event_scores(lexicon)
    best = F.array_max(F.array(*[F.struct(s.alias("score"), F.lit(-i).alias("place"), F.lit(e).alias("event")) for i, (e, s) in enumerate(scores.items())]))
    items = items.withColumn("_best", best)
    chosen = (
        F.when(F.col("_macro") & ~crypto, "macro").when(noise & ~crypto, "unknown").when(F.col("_best")["score"] >= least, F.col("_best")["event"])
        .when(F.col("_macro"), "macro").otherwise("unknown")
    )
    return items.withColumn("event_type", chosen)


# --- scores ------------------------------------------------------------------


def credibility(source_type: Column) -> Column:
    s = F.lower(source_type)
    return F.when(s.isin("twitter", "x"), 0.60).when(s == "media", 0.80).when(s == "official", 0.95).otherwise(0.50)


def importance() -> Column:
    def part(bucket: str, strong: float, some: float) -> Column:
        is_strong = F.exists(f"_{bucket}", lambda e: (F.size(e["sources"]) > 0) & (level_of(bucket, e["sources"]) == "strong"))
        return F.when(is_strong, strong).when(F.size(f"_{bucket}") > 0, some).otherwise(0.0)

    hint = F.lit(0.0)
    for event, x in EVENT_IMPORTANCE.items():
        hint = F.when(F.col("event_type") == event, x).otherwise(hint)
    titled = reduce(Column.__or__, [F.exists(f"_{b}", lambda e: _seen(e["sources"], "title:")) for b in ("projects", "tokens", "chains", "topics")])
    s = F.lit(0.20) + hint + part("projects", 0.18, 0.10) + part("tokens", 0.10, 0.05) + part("topics", 0.08, 0.04) + F.when(titled, 0.08).otherwise(0.0)
    return F.round(clamp(s + (F.col("credibility_score") - 0.5) * 0.24), 2)


ITEM = [
    "id", "title", "summary", "content", "url", "source_type", "source_name", "author", "published_at", "language", "raw_tags", "entities",
    "entity_sources", "entity_confidence", "event_type", "credibility_score", "importance_score",
]


def normalize(raw: DataFrame, lexicon: Lexicon | None = None, now: Column | None = None) -> DataFrame:
    """Items of raw rows, a row each; ``ord``, ``route``, ``feed_type`` and ``embedding`` pass through if present."""
    lexicon = lexicon or Lexicon()
    items = with_event_type(with_entities(base_items(raw, now if now is not None else F.current_timestamp()), lexicon), lexicon)
    items = items.withColumn("credibility_score", credibility(F.col("source_type"))).withColumn("importance_score", importance())
    return items.select(*ITEM, *[x for x in ("ord", "route", "feed_type", "embedding") if x in raw.columns])


#: Characters of a lexicon table that are broadcast at once.
PART_CHARS = 8 << 20


def alias_hits(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(id, bucket, canonical, alias, in_title, in_body): docs against a lexicon table, for vocabularies too large for generated columns.

    An alias with a-z or 0-9 is found by its first run of these, which is a whole
    run of any text that has it: an equi-join on the distinct runs of the texts.
    The others, few, are held against each text.  The lexicon is broadcast, in
    parts if it is large, so that no text is shuffled, let alone once for each run.
    """
    run = "[a-z0-9]+"
    lexicon = lexicon.withColumn("_run", F.regexp_extract(F.lower("alias"), run, 0))
    chars = lexicon.agg(F.sum(F.length("alias") + F.length("canonical"))).first()[0] or 0
    n = max(1, -(-chars // PART_CHARS))
    parts = [lexicon.where(F.pmod(F.xxhash64("alias"), F.lit(n)) == i) if n > 1 else lexicon for i in range(n)]
    return reduce(DataFrame.unionByName, [_hits_of_part(docs, part, run) for part in parts])


def _hits_of_part(docs: DataFrame, lexicon: DataFrame, run: str) -> DataFrame:
    d = docs.select("id", F.lower("title").alias("_t"), F.lower("content").alias("_b"))
    runs = d.withColumn("_run", F.explode(F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", "_t", "_b"), F.lit(f"({run})"), 1))))
    latin = runs.join(F.broadcast(lexicon.where("_run <> ''")), "_run").drop("_run")
    other = d.join(F.broadcast(lexicon.where("_run = ''").drop("_run")), F.contains(F.col("_t"), F.lower("alias")) | F.contains(F.col("_b"), F.lower("alias")))
    pairs = latin.unionByName(other)
    found = pairs.select("id", "bucket", "canonical", "alias", contains_column(F.col("_t"), F.col("alias")).alias("in_title"), contains_column(F.col("_b"), F.col("alias")).alias("in_body"))
    return found.where("in_title or in_body")
