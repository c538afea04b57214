"""The personal feed: recall, clustering, ranking and paging with a session, and the public calls.

A session keeps what was delivered, what is pending, and how far the sources
were read.  :func:`step` is its whole logic on plain values.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash, first_filled, profile_query, profile_signature
from ..operators import cluster, rank, recall
from ..operators.normalize import ITEM, normalize
from ..sources.feeds import MOST_ITEMS, Cursor, Feed, bounded, filled_meta
from ..vocabulary import Lexicon

TTL_SECONDS = 1800
TARGET = 20
REFILL = 8


@dataclass(frozen=True)
class Session:
    """State of a feed session: pending events in order, delivered ids, where the latest route goes on, whether the sources are used up."""

    id: str
    signature: str
    query: str = ""
    pending: tuple[tuple[str, tuple[str, ...]], ...] = ()  # (event_id, item ids)
    events: frozenset[str] = frozenset()
    items: frozenset[str] = frozenset()
    latest_cursor: str = ""
    exhausted: bool = False
    updated: float = 0.0


def expired(session: Session, now: float, ttl: float = TTL_SECONDS) -> bool:
    return ttl > 0 and now - session.updated > ttl


def fill_limits(slots: int) -> dict[str, int]:
    """How much each route is asked for when ``slots`` places are open."""
    few = max(5, min(slots, 10))
    return {"latest": max(10, slots), "trending": max(10, slots), "interest": few, "project": few, "pool": max(24, 2 * slots), "top_k": max(6, min(slots, 12))}


Event = tuple[str, tuple[str, ...]]


def step(session: Session, most: int, fetch: Callable[[Session, int], tuple[list[Event], str]], now: float) -> tuple[Session, list[str], bool]:
    """One page: refill if little is pending, hand out the head. Returns the session, event ids, and whether more may come.

    ``fetch`` gives events for so many open places and the cursor to go on from, empty at the sources' end.
    """
    target, least = max(most, TARGET), max(most, REFILL)
    if len(session.pending) < least:
        while len(session.pending) < target and not session.exhausted:
            found, cursor = fetch(session, target - len(session.pending))
            known = session.events | {e for e, _ in session.pending}
            new: dict[str, tuple[str, ...]] = {}
            for e, i in found:
                if e not in known and not set(i) <= session.items:
                    new.setdefault(e, i)
            session = replace(session, pending=session.pending + tuple(new.items()), latest_cursor=cursor, exhausted=not cursor)
    page, rest = session.pending[:most], session.pending[most:]
    session = replace(
        session, pending=rest, events=session.events | {e for e, _ in page}, items=session.items | {x for _, i in page for x in i}, updated=now,
    )
    return session, [e for e, _ in page], bool(rest) or not session.exhausted


@dataclass
class NewsFeed:
    """The public calls over a feed, a lexicon and stored vectors.

    ``embed`` turns a query text into a vector, once for each text.  ``index`` is
    handed the items that were read and have no stored vector yet, each once, as
    rows with ``item_hash``; without it nothing is enqueued.
    """

    feed: Feed
    lexicon: Lexicon = field(default_factory=Lexicon)
    now: Column | None = None
    embeddings: DataFrame | None = None
    model: str = "default"
    embed: Callable[[str], list[float]] | None = None
    index: Callable[[DataFrame], None] | None = None
    sessions: dict[str, Session] = field(default_factory=dict)
    shown: dict[str, dict] = field(default_factory=dict)
    enqueued: set[tuple[str, str]] = field(default_factory=set)
    queries: dict[str, list[float]] = field(default_factory=dict)
    warming: bool = False

    def _items(self, raw: DataFrame) -> DataFrame:
        return normalize(raw, self.lexicon, self.now)

    def _read(self, raw: DataFrame) -> DataFrame:
        """Items of a page; those without a vector are enqueued."""
        items = self._items(raw)
        self.enqueue(items)
        return items

    def enqueue(self, items: DataFrame) -> int:
        """Hand items that have no stored vector, and were not handed over before, to ``index``; a page is at most 30 rows."""
        if self.index is None:
            return 0
        keyed = hashed(items).dropDuplicates(["id", "item_hash"])
        new = [k for r in keyed.select("id", "item_hash").collect() if (k := (r["id"], r["item_hash"])) not in self.enqueued]
        if not new:
            return 0
        self.enqueued.update(new)
        rows = keyed.where(F.struct("id", "item_hash").isin([F.struct(F.lit(i), F.lit(h)) for i, h in new]))
        if self.embeddings is not None:
            stored = recall.latest_vectors(self.embeddings).where(F.col("model") == self.model).select(F.col("item_id").alias("id"), "item_hash")
            rows = rows.join(stored, ["id", "item_hash"], "left_anti")
        self.index(rows)
        return len(new)

    def latest_headlines(self, limit: int = 20, cursor: Cursor | str | None = None, no_tag: bool = False, only_important: bool = False) -> tuple[DataFrame, dict]:
        return self._paged(self.feed.latest(limit, cursor, no_tag, only_important), limit)

    def trending_feeds(self, feed_type: str = "hot_news", limit: int = 20) -> DataFrame:
        return self._read(self.feed.trending(feed_type, limit))

    def project_feed(self, symbol: str, feed_type: str = "tag_information_feed", limit: int = 20, cursor: Cursor | str | None = None) -> tuple[DataFrame, dict]:
        return self._paged(self.feed.project(symbol, feed_type, limit, cursor), limit)

    def project_opinions(self, symbol: str, limit: int = 20, cursor: Cursor | str | None = None) -> tuple[DataFrame, dict]:
        return self._paged(self.feed.opinions(symbol, limit, cursor), limit)

    def trending_topics(self, limit: int = 10) -> DataFrame:
        return self.feed.topics(limit)

    def search_content(self, query: str, limit: int = 20) -> DataFrame:
        return self._read(self.feed.search(query, limit))

    def _paged(self, raw: DataFrame, limit: int) -> tuple[DataFrame, dict]:
        """The page's items, and the keyset cursor of its last row (a page has at most 30 rows)."""
        cursor = _last_cursor(raw, limit)
        return self._read(raw), filled_meta({"next_cursor": cursor, "last_cursor": cursor, "has_more": bool(cursor), "has_next": bool(cursor)})

    def warmup(self, limit: int = 40, enabled: bool = True) -> DataFrame | None:
        """Items to index at the start: latest and trending, the last of each id, handed to ``index``.

        Nothing is done if it is not enabled or already running; a route that fails is left out.
        """
        if not enabled or self.warming:
            return None
        self.warming = True
        try:
            makers = [("latest", lambda: self.feed.latest(limit)), ("trending", lambda: self.feed.trending("hot_news", limit))]
            found = recall.attempted(makers, required=())
            if not found:
                return None
            items = recall.keep_last(self._items(recall.routes(found)), "id")
            self.enqueue(items)
            return items
        finally:
            self.warming = False

    def vector_of(self, items: DataFrame) -> DataFrame:
        if self.embeddings is None:
            return items.withColumn("embedding", F.lit(None).cast("array<float>"))
        return recall.vectors_of(items, self.embeddings, self.model)

    def query_vector(self, profiles: DataFrame, query: str = "") -> list[float]:
        """The vector of a profile's and a query's text; none without ``embed``. Equal texts are embedded once."""
        if self.embed is None:
            return []
        text = profiles.limit(1).select(profile_query(F.lit(query))).first()[0].strip()
        if text not in self.queries:
            self.queries[text] = list(self.embed(text) or [])
        return self.queries[text]

    def recalled(self, interests: list[str], projects: list[str], query_vector: list[float] | None, limits: dict[str, int], cursor: str = "") -> DataFrame:
        """Candidates of all routes with their semantic score, the best variant of each id, the newest first."""
        makers = [("latest", lambda: self.feed.latest(limits["latest"], cursor)), ("trending", lambda: self.feed.trending("hot_news", limits["trending"]))]
        makers += [(f"project:{p}", lambda p=p: self.feed.project(p, limit=limits["project"])) for p in projects]
        makers += [(f"interest:{i}", lambda i=i: self.feed.search(i, limits["interest"])) for i in interests]
        items = self._read(recall.routes(recall.attempted(makers)))
        if query_vector:
            wider = [("latest", lambda: self.feed.latest(limits["pool"])), ("trending", lambda: self.feed.trending("hot_news", limits["pool"]))]
            found = recall.attempted(wider, required=())
            pool = self.vector_of(self._read(recall.routes(found))) if found else None
            return _chosen(self.vector_of(items), pool, query_vector, limits["top_k"])
        return _chosen(items, None, None, 0)

    def ranked(self, profiles: DataFrame, candidates: DataFrame, delivered: DataFrame | None = None, hold: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        """Clusters of the candidates, scored and reranked for each profile; ``hold`` keeps what is read more than once."""
        if delivered is not None:
            candidates = candidates.join(delivered, "id", "left_anti")
        now = self.now if self.now is not None else F.current_timestamp()
        clusters = cluster.cluster_events(hold(candidates.withColumn("scope", F.lit("all"))), "scope")
        return rank.with_rank(rank.raw_ranked(rank.scored(clusters, profiles, now), F.desc("importance_score"), F.col("bucket_no")))

    def personal_feed(self, profiles: DataFrame, most: int = 5, cursor: str | None = None, query: str = "", now: float = 0.0, query_vector: list[float] | None = None) -> dict:
        """A page of events for one profile; an unknown, expired or foreign cursor begins a new session.

        A session keeps its own query.  ``clusters`` of the answer has the page's events as rows with their place.
        """
        profile = profiles.limit(1).withColumn("_signature", profile_signature()).first()
        self.sessions = {k: s for k, s in self.sessions.items() if not expired(s, now)}
        session = self.sessions.get(cursor or "")
        if session is None or session.signature != profile["_signature"]:
            session = Session(f"{profile['_signature'][:12]}-{uuid.uuid4().hex[:12]}", profile["_signature"], query, updated=now)
        vector = query_vector if query_vector is not None else self.query_vector(profiles, session.query)
        shown: dict[str, dict] = {}
        ahead = ReadAhead(self, list(profile["followed_projects"] or []), list(profile["interests"] or []), session.latest_cursor)

        def fetch(state: Session, slots: int) -> tuple[list[Event], str]:
            limits = fill_limits(slots)
            found, cursor = ahead.recalled(vector, limits, state.latest_cursor)
            if state.items:
                found = found.where(~F.col("id").isin(sorted(state.items)))
            rows = self.ranked(profiles.limit(1), found, hold=_held).orderBy("rank").select("event_id", "title", "event_type", "score", "n_items", F.transform("items", lambda i: i["id"]).alias("ids")).collect()
            shown.update({r["event_id"]: r.asDict() for r in rows})
            return [(r["event_id"], tuple(r["ids"])) for r in rows], cursor

        session, events, more = step(session, most, fetch, now)
        self.sessions[session.id] = session
        self.shown |= shown
        return {"events": events, "clusters": [self.shown[e] for e in events], "has_more": more, "next_cursor": session.id if more else ""}


def _chosen(items: DataFrame, pool: DataFrame | None, vector: list[float] | None, top_k: int) -> DataFrame:
    """Candidates with their semantic score, those of the pool nearest to the vector among them; the best variant of each id."""
    if vector:
        return recall.best_variant(recall.supplemented(items, pool, vector, top_k))
    return recall.best_variant(items.withColumn("semantic_match_score", F.lit(0.0)).drop("embedding"))


class ReadAhead:
    """What one profile's fills read, as items that are normalised once and held.

    Routes without a cursor are read once, at their full length; a fill takes the
    first rows it asks for.  The latest route is read some pages ahead of the
    fills.  All that is held is pages of at most 30 rows.
    """

    PAGES = 4

    def __init__(self, news: NewsFeed, projects: list[str], interests: list[str], cursor: str):
        self.news, self.cursor = news, cursor
        feed = news.feed
        self.makers = [("trending", lambda: feed.trending("hot_news", MOST_ITEMS))]
        self.makers += [(f"project:{p}", lambda p=p: feed.project(p, limit=MOST_ITEMS)) for p in projects]
        self.makers += [(f"interest:{i}", lambda i=i: feed.search(i, MOST_ITEMS)) for i in interests]
        self.fixed: dict[str, pa.Table] | None = None
        self.latest: pa.Table | None = None
        self.place = {cursor: 0}  # of the first row after each cursor
        self.ended = False

    def _normalised(self, parts: list[tuple[str, pa.Table]]) -> dict[str, pa.Table]:
        """Items of raw rows by part, in their order."""
        raw = pa.concat_tables([_routed(name, rows, 0) for name, rows in parts], promote_options="default")
        items = self.news.vector_of(self.news._read(_local(raw))).toArrow().sort_by("ord")
        return {name: items.filter(pc.equal(items["route"], name)) for name, _ in parts}

    def _pages(self) -> list[tuple[str, pa.Table]]:
        """The next pages of the latest route; notes where each of their rows ends."""
        pages = []
        while len(pages) < self.PAGES and not self.ended:
            rows = self.news.feed.latest(MOST_ITEMS, self.cursor).toArrow()
            keys = [str(Cursor(r["published_at"].astimezone().replace(tzinfo=None), r["id"])) for r in rows.select(["published_at", "id"]).to_pylist()]
            self.ended = len(keys) < MOST_ITEMS
            if keys:
                first = len(self.place) - 1
                self.place |= {k: first + i + 1 for i, k in enumerate(keys)}
                self.cursor = keys[-1]
                pages.append((f"latest {len(pages)}", rows))
        return pages

    def _fill(self, least: int) -> None:
        if self.fixed is None:
            parts = recall.attempted([(n, lambda m=m: m().toArrow()) for n, m in self.makers], required=("trending",))
            first = not self.cursor  # a session that begins reads its newest items on the first page
            newest = [] if first else recall.attempted([("newest", lambda: self.news.feed.latest(MOST_ITEMS).toArrow())], required=())
            pages = self._pages()
            found = self._normalised(parts + newest + pages)
            self.latest = pa.concat_tables([found.pop(name) for name, _ in pages]) if pages else found["trending"].slice(0, 0)
            self.fixed = found | ({"newest": self.latest.slice(0, MOST_ITEMS)} if first else {})
        while len(self.latest) < least and not self.ended:
            if pages := self._pages():
                found = self._normalised(pages)
                self.latest = pa.concat_tables([self.latest, *[found[name] for name, _ in pages]])

    def recalled(self, vector: list[float] | None, limits: dict[str, int], cursor: str) -> tuple[DataFrame, str]:
        """The candidates of a fill, as :meth:`NewsFeed.recalled` finds them, and the cursor to go on from."""
        at, most = self.place[cursor], bounded(limits["latest"])
        self._fill(at + most)
        page = self.latest.slice(at, most)
        onward = next(k for k, i in self.place.items() if i == at + most) if len(page) == most and most else ""
        size = lambda name: limits[name.partition(":")[0]]
        parts = [("latest", page)] + [(n, rows.slice(0, size(n))) for n, rows in self.fixed.items() if n != "newest"]
        pool = [(n, self.fixed[k].slice(0, limits["pool"])) for n, k in (("latest", "newest"), ("trending", "trending")) if k in self.fixed]
        joined = lambda of: _local(pa.concat_tables([_routed(n, rows, i) for i, (n, rows) in enumerate(of)]))
        return _chosen(joined(parts), joined(pool) if vector and pool else None, vector, limits["top_k"]), onward


def _routed(name: str, rows: pa.Table, part: int) -> pa.Table:
    """``rows`` with their route and order of arrival."""
    kept = rows.drop_columns([c for c in ("route", "ord") if c in rows.column_names])
    order = pa.array(range(part * 1_000_000 + 1, part * 1_000_000 + len(rows) + 1), pa.int64())
    return kept.append_column("route", pa.array([name] * len(rows), pa.string())).append_column("ord", order)


def _local(table: pa.Table) -> DataFrame:
    """A few rows as a DataFrame of one partition. Chunks are joined first, as an empty one would end the table."""
    return SparkSession.active().createDataFrame(table.combine_chunks()).coalesce(1)


def _held(rows: DataFrame) -> DataFrame:
    """The rows as a local table. A fill's candidates are bounded by its routes' limits, at most 30 each."""
    return _local(rows.toArrow())


def _last_cursor(raw: DataFrame, limit: int) -> str:
    """The keyset cursor of a full page's last row, else empty."""
    last = raw.select("published_at", "id").collect()
    return str(Cursor(last[-1]["published_at"], last[-1]["id"])) if last and len(last) == bounded(limit) else ""


def serialised(items: DataFrame) -> DataFrame:
    """(id, json) of items as the calls return them."""
    time = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ssXXX")
    shown = [F.col(c) if c != "published_at" else time.alias(c) for c in ITEM]
    return items.select("id", F.to_json(F.struct(*shown)).alias("json"))


def serialised_clusters(clusters: DataFrame) -> DataFrame:
    """(event_id, json) of clusters, without their items, key points and risks."""
    names = ["event_id", "title", "event_type", "entities", "first_seen_at", "last_updated_at", "importance_score"]
    return clusters.select("event_id", F.to_json(F.struct(*names)).alias("json"))


def compact(raw: DataFrame) -> DataFrame:
    """A short form of items for a prompt: the first filled of several title and summary names, first projects and topics."""
    pick = lambda *names, default="": first_filled(*[F.col(n).cast("string") for n in names if n in raw.columns], default=default)
    body = ("content", "text", "body")
    few = lambda k: F.slice(F.col("entities")[k], 1, 3) if "entities" in raw.columns else F.array().cast("array<string>")
    return raw.select(
        pick("id").alias("id"), pick("title", "name", "topic_name", "topic", *body).alias("title"), pick("summary", *body).alias("summary"),
        pick("source_name").alias("source_name"), pick("published_at").alias("published_at"), pick("url").alias("url"),
        few("projects").alias("projects"), few("topics").alias("topics"), pick("event_type", default="unknown").alias("event_type"),
    )


def other_presets(presets: DataFrame, user_id: str | None) -> DataFrame:
    """Profile presets without the user's own; all of them if none is left or no user is named."""
    if not user_id:
        return presets
    others = presets.where(~F.col("user_id").eqNullSafe(F.lit(user_id)))
    return presets if others.isEmpty() else others


#: How much of a chat is kept and shown: tool calls, shown results. Fixed values.
KEPT = {"tools": (6, 4), "shown": (20, 10)}


def remembered(memory: DataFrame, new: DataFrame, column: str, kind: str) -> DataFrame:
    """``memory`` (user_id, array) with the arrays of ``new`` behind its own, only the last ones kept."""
    kept, _ = KEPT[kind]
    both = memory.join(new.withColumnRenamed(column, "_new"), "user_id", "full_outer")
    none = F.array().cast(dict(memory.dtypes)[column])
    return both.select("user_id", _last(F.concat(F.coalesce(column, none), F.coalesce("_new", none)), kept).alias(column))


def shown_memory(memory: DataFrame, column: str, kind: str) -> DataFrame:
    """The part of a memory that goes into a prompt."""
    return memory.select("user_id", _last(F.col(column), KEPT[kind][1]).alias(column))


def _last(values: Column, n: int) -> Column:
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), F.lit(n))


def unwrapped_result(payload):
    """The value inside nested objects whose only key is ``result``."""
    while isinstance(payload, dict) and set(payload) == {"result"} and payload["result"] is not None:
        payload = payload["result"]
    return payload


def preview(payload) -> str:
    """A line about a call's answer."""
    if isinstance(payload, dict):
        return f"object keys: {', '.join(sorted(payload)[:6])}" if payload else "object"
    if isinstance(payload, list):
        first = payload[0] if payload else None
        if not isinstance(first, dict):
            return f"{len(payload)} items"
        label = next((first[k] for k in ("title", "name", "topic_name", "topic") if first.get(k)), "item")
        return f"{len(payload)} items, first: {str(label)[:80]}"
    return payload[:120] if isinstance(payload, str) else type(payload).__name__


def hashed(items: DataFrame) -> DataFrame:
    return items.withColumn("item_hash", content_hash())
