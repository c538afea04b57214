"""Similarity of items and clusters, as column expressions on pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import clamp, hours_between, jaccard, level_weight, lowered, stepped, weighted_jaccard
from ..functions.text import title_tokens

WINDOW_HOURS = 48
MERGE_AT = 0.45
#: Likeness of titles and of vectors that counts where no entity is shared. Fixed values.
TITLE_AT = 0.4
VECTOR_AT = 0.55
#: Share of each overlap in a match score, and in the redundancy of two clusters. Fixed values.
MATCH = {"projects": 0.30, "tokens": 0.18, "chains": 0.12, "topics": 0.10}
REDUNDANCY = {"projects": 0.34, "tokens": 0.20, "topics": 0.20, "chains": 0.10}


def weights(entities: Column, confidence: Column, bucket: str) -> Column:
    """Lower-cased entity -> its largest confidence weight, of one item's bucket."""
    entry = lambda n: F.struct(F.lower(n).alias("key"), level_weight(F.coalesce(F.element_at(F.element_at(confidence, bucket), n), F.lit("weak"))).alias("value"))
    pairs = F.transform(entities[bucket], entry)
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    most = lambda k: F.array_max(F.transform(F.filter(pairs, lambda p: p["key"] == k), lambda p: p["value"]))
    return F.map_from_arrays(keys, F.transform(keys, most))


def with_weights(items: DataFrame) -> DataFrame:
    """Adds ``w_<bucket>`` maps and ``title_set``, what pairs of items are scored by."""
    made = {f"w_{b}": weights(F.col("entities"), F.col("entity_confidence"), b) for b in MATCH}
    return items.withColumns(made | {"title_set": title_tokens(F.col("title"))})


def event_score(a: Column, b: Column) -> Column:
    return F.when(a == b, 0.35).when((a == "unknown") | (b == "unknown"), 0.12).otherwise(0.0)


def time_score(a: Column, b: Column) -> Column:
    return stepped(F.abs(hours_between(a, b)), [(6, 0.20), (24, 0.12), (WINDOW_HOURS, 0.06)], 0.0)


def match_score(a: str, b: str, semantic: Column | None = None) -> Column:
    """Score of two single items, columns under the prefixes ``a`` and ``b`` (structs)."""
    x, y = F.col(a), F.col(b)
    event, time = event_score(x["event_type"], y["event_type"]), time_score(x["published_at"], y["published_at"])
    overlaps = {k: weighted_jaccard(x[f"w_{k}"], y[f"w_{k}"]) for k in MATCH}
    title = jaccard(x["title_set"], y["title_set"])
    meaning = F.greatest(F.coalesce(semantic, F.lit(0.0)), F.lit(0.0)) if semantic is not None else F.lit(0.0)
    score = event + time
    for k, share in MATCH.items():
        score = score + share * overlaps[k]
    score = score + 0.18 * title + 0.15 * meaning
    bare = F.lit(True)
    for v in overlaps.values():
        bare = bare & (v == 0)
    return F.when((event == 0) | (time == 0), 0.0).when(bare & (title < TITLE_AT) & (meaning < VECTOR_AT), 0.0).otherwise(score)


def candidate_pairs(items: DataFrame) -> DataFrame:
    """(a, b) structs of items within the time window that may be of one type, with what they are scored by."""
    return near_pairs(with_weights(items).select("id", "event_type", "published_at", "title_set", *[f"w_{k}" for k in MATCH]))


def near_pairs(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """(a, b) structs of rows (id, event_type, published_at, ...) within the time window that may be of one type, by ascending id.

    An equi-join on window-sized time slots: a row meets those of its own slot and, as the earlier one, those of the next.
    The pairs are many times the rows, so they are made in a fixed number of tasks, which are not merged
    by the few bytes that come in.  ``rows`` is read twice: stage what is dear.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = rows.select(F.struct(*rows.columns).alias("y"), F.floor(F.unix_seconds("published_at") / (WINDOW_HOURS * 3600)).alias("slot"))
    earlier = packed.select(F.col("y").alias("x"), F.posexplode(F.array("slot", F.col("slot") + 1)).alias("ahead", "slot"))
    met = earlier.repartition(parts, "slot").join(packed.repartition(parts, "slot"), "slot")
    x, y = F.col("x"), F.col("y")
    once = (x["id"] < y["id"]) | ((F.col("ahead") == 1) & (x["id"] > y["id"]))
    near = F.abs(hours_between(x["published_at"], y["published_at"])) <= WINDOW_HOURS
    least = lambda p, q: F.when(x["id"] < y["id"], p).otherwise(q)
    return met.where(once & near & (event_score(x["event_type"], y["event_type"]) > 0)).select(least(x, y).alias("a"), least(y, x).alias("b"))


def redundancy(a: Column, b: Column) -> Column:
    """Of two clusters (structs with ``entities`` and ``event_type``)."""
    low = lambda c: F.struct(F.struct(*[lowered(c["entities"][k]).alias(k) for k in REDUNDANCY]).alias("entities"), c["event_type"].alias("event_type"))
    return redundancy_of(low(a), low(b))


def redundancy_of(a: Column, b: Column) -> Column:
    """Of two clusters whose entities are in lower case already."""
    score = F.lit(0.0)
    for k, share in REDUNDANCY.items():
        score = score + share * jaccard(a["entities"][k], b["entities"][k])
    return clamp(score + F.when(a["event_type"] == b["event_type"], 0.16).otherwise(0.0))
