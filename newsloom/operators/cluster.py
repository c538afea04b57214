"""Same-event clusters: the greedy assignment and the roll-up of its groups.

Each item, newest first, joins the best cluster whose first item is at most 48
hours newer, or opens one.  :func:`assign` folds one key's items at once and is
for pools, such as a user's candidates.  :func:`assign_timeline` takes a table
of any length: items that could ever meet are connected first, and each
component is folded by itself, which gives what one fold over all would give.
A fold keeps only clusters younger than 48 hours and holds an item only against
those it shares something with, so a component of any length streams through.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict, deque
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import BUCKETS
from ..sources.store import staged
from .similarity import MATCH, MERGE_AT, TITLE_AT, VECTOR_AT, WINDOW_HOURS, with_weights

RISK = "Possible security incident, needs closer tracking."


def _share(a: dict, b: dict) -> float:
    if not a or not b or not (shared := a.keys() & b.keys()):
        return 0.0
    return sum(min(a[k], b[k]) for k in shared) / sum(max(a.get(k, 0.0), b.get(k, 0.0)) for k in a.keys() | b.keys())


def _cos(a, b) -> float:
    if a is None or b is None or len(a) != len(b) or not len(a):
        return 0.0
    dot, n, m = sum(x * y for x, y in zip(a, b, strict=True)), sum(x * x for x in a), sum(y * y for y in b)
    return max(0.0, dot / (n * m) ** 0.5) if n and m else 0.0


class _Group:
    """What a fold keeps of a cluster: its newest item, its types, its largest weights."""

    def __init__(self, item: dict):
        self.head, self.types, self.weights = item, {item["event_type"]}, {k: dict(item[f"w_{k}"]) for k in MATCH}

    def score(self, item: dict) -> float:
        if item["event_type"] in self.types:
            s = 0.35
        elif item["event_type"] == "unknown" or "unknown" in self.types:
            s = 0.12
        else:
            return 0.0
        hours = abs((item["published_at"] - self.head["published_at"]).total_seconds()) / 3600
        near = next((x for limit, x in ((6, 0.20), (24, 0.12), (WINDOW_HOURS, 0.06)) if hours <= limit), 0.0)
        if not near:
            return 0.0
        s += near
        overlaps = [(w, _share(item[f"w_{k}"], self.weights[k])) for k, w in MATCH.items()]
        a, b = item["title_set"], self.head["title_set"]
        title = len(a & b) / len(a | b) if a and b else 0.0
        meaning = _cos(item.get("embedding"), self.head.get("embedding"))
        if not any(v for _, v in overlaps) and title < TITLE_AT and meaning < VECTOR_AT:
            return 0.0
        return s + sum(w * v for w, v in overlaps) + 0.18 * title + 0.15 * meaning

    def add(self, item: dict) -> None:
        self.types.add(item["event_type"])
        for k in MATCH:
            mine = self.weights[k]
            for key, w in item[f"w_{k}"].items():
                mine[key] = max(mine.get(key, 0.0), w)


class Fold:
    """The greedy assignment of items that come newest first."""

    def __init__(self, merge_at: float = MERGE_AT):
        self.merge_at = merge_at
        self.open: deque[int] = deque()  # in the order of opening, so the newest heads go first
        self.groups: dict[int, _Group] = {}
        self.index: dict[tuple, set[int]] = defaultdict(set)
        self.opened = 0

    @staticmethod
    def _features(weights: dict[str, dict]) -> list[tuple]:
        return [(k, key) for k in MATCH for key in weights[k]]

    @staticmethod
    def _of_head(item: dict) -> list[tuple]:
        return [("title", t) for t in item["title_set"]] + ([("vector",)] if item.get("embedding") is not None else [])

    def _open(self, group: _Group) -> None:
        number, self.opened = self.opened, self.opened + 1
        self.groups[number] = group
        self.open.append(number)
        for f in self._features(group.weights) + self._of_head(group.head):
            self.index[f].add(number)

    def _expire(self, now) -> None:
        while self.open and self.groups[self.open[0]].head["published_at"] - now > timedelta(hours=WINDOW_HOURS):
            del self.groups[self.open.popleft()]

    def add(self, item: dict) -> dict:
        """The first item of the cluster that ``item`` joins or opens; of equally good clusters the earliest opened."""
        self._expire(item["published_at"])
        near: set[int] = set()
        own = self._features({k: item[f"w_{k}"] for k in MATCH})
        for f in own + self._of_head(item):
            if found := self.index.get(f):
                found &= self.groups.keys()
                near |= found
        best, at = 0.0, -1
        for number in sorted(near):
            if (s := self.groups[number].score(item)) > best:
                best, at = s, number
        if best < self.merge_at or at < 0:
            self._open(_Group(item))
            return item
        self.groups[at].add(item)
        for f in own:
            self.index[f].add(at)
        return self.groups[at].head


def fold(items: list[dict], merge_at: float = MERGE_AT) -> list[int]:
    """Cluster number of each item; items come newest first, and the earliest best cluster wins."""
    numbers: dict[int, int] = {}
    made = Fold(merge_at)
    return [numbers.setdefault(id(made.add(item)), len(numbers)) for item in items]


def _records(frame: pd.DataFrame) -> list[dict]:
    records = frame.to_dict("records")
    for r in records:
        r["title_set"] = set(r["title_set"])
        for k in MATCH:
            r[f"w_{k}"] = {e["key"]: e["value"] for e in r[f"w_{k}"]}
    return records


def _input(items: DataFrame, order: str, *keys: Column) -> DataFrame:
    extra = ["embedding"] if "embedding" in items.columns else []
    return with_weights(items).select(*keys, "id", F.col(order).cast("long").alias("ord"), "event_type", "published_at", "title_set", *extra, *[F.map_entries(f"w_{k}").alias(f"w_{k}") for k in MATCH])


def assign(items: DataFrame, key: str, order: str = "ord", merge_at: float = MERGE_AT) -> DataFrame:
    """(key, id, cluster_no): greedy clusters within each value of ``key``; bound its items before."""
    kind = dict(items.dtypes)[key]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["published_at", "ord"], ascending=[False, True], kind="stable")
        return pd.DataFrame({key: frame[key], "id": frame["id"], "cluster_no": fold(_records(frame), merge_at)})

    return _input(items, order, F.col(key)).groupBy(key).applyInPandas(run, f"{key} {kind}, id string, cluster_no long")


def _features() -> Column:
    """What an item must share with one of a cluster to join it: an entity, a word among its longest of the title, or that there is a vector.

    Titles with a likeness of 0.4 share a word among all but the last two fifths of their words, in any fixed order of words.
    """
    named = [F.transform(f"w_{k}", lambda e, k=k: F.concat(F.lit(f"{k}:"), e["key"])) for k in MATCH]
    size = F.size("title_set")
    words = F.transform(F.array_sort(F.transform("title_set", lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda x: F.concat(F.lit("title:"), x["t"]))
    return F.concat(*named, F.when(size > 0, F.slice(words, 1, size - F.ceil(size * TITLE_AT).cast("int") + 1)).otherwise(F.array().cast("array<string>")))


def components(rows: DataFrame) -> DataFrame:
    """(id, component) of items (scope, id, published_at, features); items that share nothing are left out.

    Items that share a feature within 48 hours are connected.  A feature's times are cut where it is missing for longer;
    each stretch is a hub, found from the first and last time in each slot of 48 hours.  The hubs of an item are
    connected, and the least hub is carried along these links until nothing changes.
    """
    width = WINDOW_HOURS * 3600
    at = F.unix_micros("published_at")
    seen = rows.select("scope", "id", at.alias("at"), F.floor(at / (width * 1_000_000)).alias("slot"), F.explode("features").alias("feature"))
    slots = seen.groupBy("scope", "feature", "slot").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count("*").alias("n"))
    by_time = Window.partitionBy("scope", "feature").orderBy("slot")
    gap = F.coalesce(F.col("lo") - F.lag("hi").over(by_time) > width * 1_000_000, F.lit(False)).cast("int")
    stretch = slots.withColumn("gap", gap).withColumn("stretch", F.sum("gap").over(by_time))
    many = F.sum("n").over(Window.partitionBy("scope", "feature", "stretch"))
    hubs = stretch.withColumn("many", many).where("many > 1").select("scope", "feature", "slot", F.xxhash64("scope", "feature", "stretch").alias("hub"))
    of_item = staged(seen.join(hubs, ["scope", "feature", "slot"]).groupBy("id").agg(F.array_sort(F.collect_set("hub")).alias("hubs")), "hubs")
    pairs = of_item.select(F.element_at("hubs", 1).alias("a"), F.explode("hubs").alias("b")).distinct()
    links = staged(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = staged(links.groupBy("a").agg(F.min("b").alias("label")), "labels")
    while True:
        least = links.join(label.select(F.col("a").alias("b"), F.col("label").alias("near")), "b").groupBy("a").agg(F.min("near").alias("least"))
        onward = label.select(F.col("a").alias("least"), F.col("label").alias("beyond"))
        label = staged(label.withColumnRenamed("label", "old").join(least, "a").join(onward, "least").select("a", "old", F.least("old", "least", "beyond").alias("label")), "labels")
        if label.where("label <> old").isEmpty():
            break
        label = label.drop("old")
    return of_item.select("id", F.element_at("hubs", 1).alias("a")).join(label, "a").select("id", F.col("label").alias("component"))


def assign_timeline(items: DataFrame, key: str | None = None, order: str = "ord", merge_at: float = MERGE_AT) -> DataFrame:
    """(scope, id, head_id): greedy clusters of each value of ``key`` (or of all items), named by their newest item; ids differ.

    Items of different components cannot meet, so each component is folded by itself, as its rows stream by.
    """
    scope = F.coalesce(F.col(key).cast("string"), F.lit("")) if key else F.lit("")
    rows = _input(items, order, scope.alias("scope"))
    found = _features()
    if "embedding" in rows.columns:
        found = F.concat(found, F.when(F.col("embedding").isNotNull(), F.array(F.lit("vector"))).otherwise(F.array().cast("array<string>")))
    rows = staged(rows.withColumn("features", found), "timeline")
    joined = rows.join(components(rows), "id", "left").withColumn("component", F.coalesce("component", F.xxhash64(F.lit("alone"), "id"))).drop("features")
    by = [F.asc("component"), F.asc("scope"), F.desc("published_at"), F.asc("ord"), F.asc("id")]
    dealt = joined.repartition("component").sortWithinPartitions(*by)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, now = Fold(merge_at), None
        for frame in frames:
            heads = []
            for item in _records(frame):
                if (item["component"], item["scope"]) != now:
                    made, now = Fold(merge_at), (item["component"], item["scope"])
                heads.append(made.add(item)["id"])
            yield pd.DataFrame({"scope": frame["scope"], "id": frame["id"], "head_id": heads})

    return dealt.mapInPandas(run, "scope string, id string, head_id string")


def _in_order(value: Column) -> Column:
    """Values of a group's items, oldest first."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col("published_at").alias("t"), F.col("ord").alias("o"), value.alias("v")))), lambda s: s["v"])


def roll_up(items: DataFrame, *keys: str) -> DataFrame:
    """A cluster for each group: times, title of the strongest item, commonest type, entities, key points, risks, items."""
    ranked = F.struct("importance_score", "published_at", (-F.col("ord")).alias("o"))
    made = items.groupBy(*keys).agg(
        F.substring(F.md5(F.array_join(F.array_sort(F.collect_list("id")), "|").cast("binary")), 1, 10).alias("event_id"),
        F.max_by("title", ranked).alias("title"), _in_order(F.col("event_type")).alias("_types"),
        F.min("published_at").alias("first_seen_at"), F.max("published_at").alias("last_updated_at"),
        F.max("importance_score").alias("importance_score"), F.avg("credibility_score").alias("avg_credibility"),
        F.struct(*[F.array_distinct(F.flatten(_in_order(F.col("entities")[b]))).alias(b) for b in BUCKETS]).alias("entities"),
        F.sort_array(F.collect_list(F.struct("importance_score", "published_at", (-F.col("ord")).alias("o"), "summary")), asc=False).alias("_points"),
        F.when(F.bool_or(F.col("event_type") == "exploit"), F.array(F.lit(RISK))).otherwise(F.array().cast("array<string>")).alias("risks"),
        F.count("*").alias("n_items"), F.array_sort(F.collect_list(F.struct("published_at", "ord", "id", "entities", "entity_confidence_list", "semantic_match_score"))).alias("items"),
    )
    distinct = F.array_distinct("_types")
    counted = F.transform(distinct, lambda t, i: F.struct(F.size(F.filter("_types", lambda x: x == t)).alias("n"), (-i).alias("i"), t.alias("t")))
    points = F.slice(F.array_distinct(F.filter(F.transform("_points", lambda p: p["summary"]), lambda s: F.coalesce(s, F.lit("")) != "")), 1, 3)
    return made.withColumns({"event_type": F.array_max(counted)["t"], "key_points": points}).drop("_types", "_points")


def merged_roll_up(items: DataFrame, *keys: str) -> DataFrame:
    """As :func:`roll_up` without the items themselves, for groups of any size: no row holds what grows with a group.

    Types, names and summaries are merged by value first, of which a group has
    few (names) or keeps three (summaries); ids are hashed as they stream by in
    order.  ``items`` is read several times: stage it.
    """
    ranked = F.struct("importance_score", "published_at", (-F.col("ord")).alias("o"))
    first = F.struct((-F.unix_micros("published_at")).alias("t"), (-F.col("ord")).alias("o"))
    main = items.groupBy(*keys).agg(
        F.max_by("title", ranked).alias("title"), F.min("published_at").alias("first_seen_at"), F.max("published_at").alias("last_updated_at"), F.max("importance_score").alias("importance_score"),
        F.avg("credibility_score").alias("avg_credibility"), F.when(F.bool_or(F.col("event_type") == "exploit"), F.array(F.lit(RISK))).otherwise(F.array().cast("array<string>")).alias("risks"), F.count("*").alias("n_items"),
    )
    types = items.groupBy(*keys, "event_type").agg(F.struct(F.count("*").alias("n"), F.max(first).alias("f")).alias("by")).groupBy(*keys).agg(F.max_by("event_type", "by").alias("event_type"))
    named = items.select(*keys, "published_at", "ord", F.explode(F.array(*[F.struct(F.lit(b).alias("bucket"), F.col("entities")[b].alias("names")) for b in BUCKETS])).alias("e"))
    named = named.select(*keys, "published_at", "ord", "e.bucket", F.posexplode("e.names").alias("at", "name")).groupBy(*keys, "bucket", "name").agg(F.min(F.struct("published_at", "ord", "at")).alias("seen"))
    of_bucket = lambda b: F.transform(F.array_sort(F.collect_list(F.when(F.col("bucket") == b, F.struct("seen", "name")))), lambda x: x["name"]).alias(b)
    entities = named.groupBy(*keys).agg(F.struct(*[of_bucket(b) for b in BUCKETS]).alias("_entities"))
    points = items.where(F.coalesce("summary", F.lit("")) != "").groupBy(*keys, "summary").agg(F.max(ranked).alias("r"))
    points = points.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("r")))).where("_n <= 3")
    points = points.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "summary"))), lambda x: x["summary"]).alias("_points"))
    made = main.join(types, list(keys)).join(_hashed_ids(items, *keys), list(keys)).join(entities, list(keys), "left").join(points, list(keys), "left")
    none = F.struct(*[F.array().cast("array<string>").alias(b) for b in BUCKETS])
    return made.withColumns({"entities": F.coalesce("_entities", none), "key_points": F.coalesce("_points", F.array().cast("array<string>"))}).drop("_entities", "_points")


def _hashed_ids(items: DataFrame, *keys: str) -> DataFrame:
    """(keys, event_id): the hash of a group's ids, sorted and joined, as they stream by."""
    rows = items.select(*keys, "id").repartition(*keys).sortWithinPartitions(*keys, "id")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for batch in batches:
            out, shape = [], [batch.schema.field(k) for k in keys]
            for *now, value in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now != key:
                    if key is not None:
                        out.append((*key, held.hexdigest()[:10]))
                    key, held = now, hashlib.md5(value.encode())
                else:
                    held.update(b"|" + value.encode())
            if out:
                yield _batch_of(out, shape)
        if key is not None:
            yield _batch_of([(*key, held.hexdigest()[:10])], shape)

    return rows.mapInArrow(run, f"{fields}, event_id string")


def _batch_of(rows: list[tuple], keys: list[pa.Field]) -> pa.RecordBatch:
    schema = pa.schema([*keys, pa.field("event_id", pa.string())])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def rollup_input(items: DataFrame) -> DataFrame:
    """Items with what :func:`roll_up` needs: order, semantic score, and confidence as rows that can be sorted."""
    levels = F.flatten(F.array(*[_levels_of(b) for b in BUCKETS]))
    out = items.withColumn("entity_confidence_list", levels)
    return out if "semantic_match_score" in out.columns else out.withColumn("semantic_match_score", F.lit(0.0))


def _levels_of(bucket: str) -> Column:
    """(bucket, entity, level) of all entities of a bucket; without evidence the level is weak."""
    level = lambda n: F.coalesce(F.element_at(F.element_at("entity_confidence", bucket), n), F.lit("weak"))
    return F.transform(F.col("entities")[bucket], lambda n: F.struct(F.lit(bucket).alias("bucket"), n.alias("name"), level(n).alias("level")))


def cluster_timeline(items: DataFrame, key: str | None = None, order: str = "ord") -> DataFrame:
    """Clusters over a table of any length; ``head_id`` is the newest item of each."""
    scope = F.coalesce(F.col(key).cast("string"), F.lit("")) if key else F.lit("")
    used = ["id", "ord", "title", "summary", "event_type", "published_at", "importance_score", "credibility_score", "entities", "entity_confidence"]
    more = [c for c in ("embedding", "semantic_match_score") if c in items.columns]
    rows = staged(items.select(scope.alias("scope"), *used[:1], F.col(order).cast("long").alias("ord"), *used[2:], *more), "items")
    headed = rows.drop("entity_confidence", "embedding").join(assign_timeline(rows, "scope"), ["scope", "id"])
    return merged_roll_up(staged(headed, "headed"), "scope", "head_id")


def cluster_events(items: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """Clusters of each key, with ``bucket_no``, the order in which they were opened."""
    number = assign(items, key, order)
    return roll_up(rollup_input(items).join(number, [key, "id"]), key, "cluster_no").withColumnRenamed("cluster_no", "bucket_no")
