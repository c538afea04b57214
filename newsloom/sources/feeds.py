"""Feed sources: pages of headlines, trending and project feeds, topics and search.

A source hands out DataFrames; :class:`TableFeed` serves them from a raw-item
table.  Pages are ordered by time and id, newest first, and continue after a
keyset cursor, which reaches the scan as one pushed ``Or`` filter.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import first_filled

MOST_ITEMS = 30
MOST_TOPICS = 10
TRENDING = ("hot_news", "pop_info")
PROJECT_FEEDS = ("tag_discussion_feed", "tag_information_feed", "news", "key_events")
OPINIONS = "opinions"
PAGE_DEFAULTS = {"cursor": "", "next_cursor": "", "last_cursor": "", "has_more": False, "has_next": False}


class SourceError(RuntimeError):
    """The source answered with another code than success."""


@dataclass(frozen=True)
class Cursor:
    """The last row of a page: its time and id."""

    at: datetime
    id: str

    def __str__(self) -> str:
        return f"{self.at.isoformat()}|{self.id}"

    @classmethod
    def of(cls, value: Cursor | str | None) -> Cursor | None:
        """The cursor that a page's text names; none for none or an empty text."""
        if not value or isinstance(value, Cursor):
            return value or None
        at, bar, key = value.partition("|")
        try:
            return cls(datetime.fromisoformat(at), key) if bar else cls._bad(value)
        except ValueError:
            return cls._bad(value)

    @staticmethod
    def _bad(value: str) -> Cursor:
        raise SourceError(f"not a cursor: {value!r}")


class Feed(Protocol):
    def latest(self, limit: int = 20, cursor: Cursor | str | None = None, no_tag: bool = False, only_important: bool = False) -> DataFrame: ...
    def trending(self, feed_type: str, limit: int = 20) -> DataFrame: ...
    def project(self, symbol: str, feed_type: str, limit: int = 20, cursor: Cursor | str | None = None) -> DataFrame: ...
    def opinions(self, symbol: str, limit: int = 20, cursor: Cursor | str | None = None) -> DataFrame: ...
    def topics(self, limit: int = 10) -> DataFrame: ...
    def search(self, query: str, limit: int = 20) -> DataFrame: ...


def unwrapped(payload: dict) -> dict:
    """The data of a source's answer; an error code raises."""
    if payload.get("code") != 2000:
        raise SourceError(str(payload.get("msg") or payload.get("code")))
    return payload.get("data") or {}


def page_meta(data: dict) -> dict:
    """The page keys of an answer that are not null."""
    return {k: data[k] for k in PAGE_DEFAULTS if data.get(k) is not None}


def filled_meta(meta: dict) -> dict:
    """All page keys: defaults for missing or null ones, flags as booleans."""
    return {k: (bool(meta.get(k)) if isinstance(d, bool) else meta.get(k) if meta.get(k) is not None else d) for k, d in PAGE_DEFAULTS.items()}


def bounded(limit: int, most: int = MOST_ITEMS) -> int:
    return max(0, min(limit, most))


def after(cursor: Cursor | str | None, at: str = "published_at", key: str = "id") -> Column:
    """Rows that come after the cursor in newest-first order."""
    cursor = Cursor.of(cursor)
    if cursor is None:
        return F.lit(True)
    t = F.lit(cursor.at)
    return (F.col(at) < t) | ((F.col(at) == t) & (F.col(key) < cursor.id))


def newest(df: DataFrame, limit: int) -> DataFrame:
    return df.orderBy(F.desc("published_at"), F.desc("id")).limit(limit)


def has_symbol(symbol: str) -> Column:
    return F.exists("tags", lambda t: (F.lower(t["type"]) == "token") & (F.lower(t["symbol"]) == symbol.lower()))


@dataclass
class TableFeed:
    """A feed over raw items with ``published_at``; topic days as nested rows.

    ``feed_type`` names the trending feed of an item and ``kind`` its place in
    project feeds, one of ``PROJECT_FEEDS`` or ``opinions``.  A call that needs a
    column the items lack fails, as it could not be answered.
    """

    items: DataFrame
    topic_days: DataFrame | None = None

    def latest(self, limit: int = 20, cursor: Cursor | str | None = None, no_tag: bool = False, only_important: bool = False) -> DataFrame:
        rows = self.items.where(after(cursor))
        if no_tag:
            rows = rows.where(F.coalesce(F.size("tags"), F.lit(0)) <= 0)
        if only_important:
            rows = self._having(rows, "important").where("important")
        return newest(rows, bounded(limit))

    def trending(self, feed_type: str, limit: int = 20) -> DataFrame:
        if feed_type not in TRENDING:
            raise ValueError(f"feed_type must be one of {TRENDING}")
        return newest(self._having(self.items, "feed_type").where(F.col("feed_type") == feed_type), bounded(limit))

    def project(self, symbol: str, feed_type: str = "tag_information_feed", limit: int = 20, cursor: Cursor | str | None = None) -> DataFrame:
        if feed_type not in PROJECT_FEEDS:
            raise ValueError(f"feed_type must be one of {PROJECT_FEEDS}")
        return self._of_project(symbol, feed_type, limit, cursor)

    def opinions(self, symbol: str, limit: int = 20, cursor: Cursor | str | None = None) -> DataFrame:
        return self._of_project(symbol, OPINIONS, limit, cursor)

    def _of_project(self, symbol: str, kind: str, limit: int, cursor: Cursor | str | None) -> DataFrame:
        rows = self._having(self.items, "kind").where((F.col("kind") == kind) & has_symbol(symbol) & after(cursor))
        return newest(rows, bounded(limit))

    @staticmethod
    def _having(rows: DataFrame, name: str) -> DataFrame:
        if name not in rows.columns:
            raise SourceError(f"the items have no column {name}")
        return rows

    def topics(self, limit: int = MOST_TOPICS) -> DataFrame:
        if self.topic_days is None:
            raise SourceError("no topics")
        return flat_topics(self.topic_days).limit(bounded(limit, MOST_TOPICS))

    def search(self, query: str, limit: int = 20) -> DataFrame:
        return search(newest(self.items, MOST_ITEMS), query, limit)


def flat_topics(days: DataFrame) -> DataFrame:
    """Topics of each day block, newest day first, the day's start copied to each."""
    rows = days.orderBy(F.desc("day_start_ts")).select("day_start_ts", F.posexplode("topics").alias("place", "topic"))
    return rows.orderBy(F.desc("day_start_ts"), "place").select(F.col("topic").withField("_day_start_ts", F.col("day_start_ts")).alias("topic")).select("topic.*")


def search(rows: DataFrame, query: str, limit: int) -> DataFrame:
    """Rows whose title or content has the trimmed query, whatever its case."""
    q = query.strip().lower()
    names = [c for c in ("title", "content", "translated_title", "translated_content") if c in rows.columns]
    hit = F.lit(False)
    for c in names:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(q))
    return newest(rows.where(hit), limit)


def document_key(rows: DataFrame) -> Column:
    """Id or title of a document, whichever of these columns there are and filled."""
    return first_filled(*[F.col(c).cast("string") for c in ("id", "title", "translated_title") if c in rows.columns], default=None)


def first_of_each(rows: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first row of each key; rows without a key are dropped."""
    keyed = rows.withColumn("_key", key).where(F.col("_key").isNotNull())
    first = F.row_number().over(Window.partitionBy("_key").orderBy(*order))
    return keyed.withColumn("_n", first).where("_n = 1").drop("_n", "_key")


def discovery_documents(feed: Feed, latest: int = 40, trending: int = 40) -> DataFrame:
    """Latest then trending documents, first one of each key."""
    a = feed.latest(latest).withColumn("_route", F.lit(0))
    b = feed.trending("hot_news", trending).withColumn("_route", F.lit(1))
    both = a.unionByName(b, allowMissingColumns=True)
    return first_of_each(both, document_key(both), F.col("_route"), F.desc("published_at"), F.desc("id")).drop("_route")


def chunked(rows: DataFrame, size: int, *order: Column) -> DataFrame:
    """Adds ``batch_id``: runs of ``size`` rows in order, of an already bounded set of rows."""
    return rows.withColumn("batch_id", F.floor((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1) / size).cast("long"))


def table_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at ``path``; empty with the schema where there is none. Missing columns have their defaults, else null."""
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return with_defaults(found, schema)


def with_defaults(found: DataFrame, schema: str) -> DataFrame:
    """The columns of ``schema``; missing ones have their defaults, else null."""
    fields = found.sparkSession.createDataFrame([], schema).schema
    return found.select(*[F.col(f.name).cast(f.dataType) if f.name in found.columns else _default(f.name, f.dataType) for f in fields])


#: What columns added later hold in rows written before. Fixed values.
DEFAULTS = {"source_names": F.array, "status": "active", "stale_cycles": 0, "last_evaluated_run_id": 0, "last_qualified_run_id": 0}


def _default(name: str, kind) -> Column:
    value = DEFAULTS.get(name)
    return (value() if callable(value) else F.lit(value)).cast(kind).alias(name)

