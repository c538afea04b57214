"""Ranking of clusters for a user: signals, linear score, explanation, diversity rerank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import clamp, hours_between, level_weight, lowered, stepped, total
from ..schema import BUCKETS
from .similarity import REDUNDANCY, redundancy_of

#: Share of each signal in the score. Fixed values.
WEIGHTS = {
    "importance_score": 0.25, "freshness_score": 0.20, "follow_affinity_score": 0.18, "interest_match_score": 0.15, "semantic_match_score": 0.12,
    "source_quality_score": 0.10, "risk_boost_score": 0.05, "mute_penalty": -0.20,
}
LAMBDA = 0.78
LOOK_BACK = 5
MOST_PROFILES = 1000


def _levels(weak: float, medium: float) -> Column:
    """(bucket, key, weight) of all entities of all items of a cluster."""
    rows = F.flatten(F.transform("items", lambda i: i["entity_confidence_list"]))
    return F.transform(rows, lambda r: F.struct(r["bucket"].alias("bucket"), F.lower(r["name"]).alias("key"), level_weight(r["level"], 1.0, medium, weak).alias("w")))


def signals(clusters: DataFrame, now: Column) -> dict[str, Column]:
    """The eight signals of clusters joined with a profile (``interests``, ``followed_projects``, ``muted_topics``)."""
    hours = F.greatest(hours_between(now, F.col("last_updated_at")), F.lit(0.0))
    followed, interests, muted = lowered(F.col("followed_projects")), F.transform("interests", F.lower), lowered(F.col("muted_topics"))
    follow = F.array_max(F.transform(F.filter(_levels(0.55, 0.7), lambda r: (r["bucket"] == "projects") & F.array_contains(followed, r["key"])), lambda r: r["w"]))
    best = lambda k: F.coalesce(F.array_max(F.transform(F.filter(_levels(0.55, 0.75), lambda r: (r["key"] == k) & (r["bucket"] != "people")), lambda r: r["w"])), F.lit(0.0))
    interest = F.when(F.size("interests") > 0, clamp(total(F.transform(interests, best)) / F.size("interests"))).otherwise(0.0)
    terms = lowered(F.flatten(F.array(*[F.col("entities")[b] for b in BUCKETS if b != "people"])))
    return {
        "importance_score": clamp(F.col("importance_score")),
        "freshness_score": stepped(hours, [(1, 1.0), (6, 0.85), (24, 0.65), (72, 0.40)], 0.20),
        "follow_affinity_score": F.coalesce(follow, F.lit(0.0)),
        "interest_match_score": interest,
        "semantic_match_score": clamp(F.coalesce(F.array_max(F.transform("items", lambda i: i["semantic_match_score"])), F.lit(0.0))),
        "source_quality_score": clamp(F.coalesce(F.col("avg_credibility"), F.lit(0.0))),
        "risk_boost_score": F.when(F.col("event_type") == "exploit", 1.0).when(F.size("risks") > 0, 0.7).otherwise(0.0),
        "mute_penalty": F.when(F.arrays_overlap(terms, muted), 1.0).otherwise(0.0),
    }


def scored(clusters: DataFrame, profiles: DataFrame, now: Column) -> DataFrame:
    """Clusters with ``signals`` and ``score`` for each profile.

    Clusters with a ``user_id`` meet that user's profile.  Shared ones meet each
    of at most ``MOST_PROFILES`` profiles, whose number is checked.
    """
    if "user_id" in clusters.columns:
        joined = clusters.join(profiles, "user_id")
    else:
        if profiles.limit(MOST_PROFILES + 1).count() > MOST_PROFILES:
            raise ValueError(f"more than {MOST_PROFILES} profiles need clusters with a user_id")
        joined = clusters.crossJoin(F.broadcast(profiles))
    joined = joined.withColumn("signals", F.struct(*[s.alias(n) for n, s in signals(joined, now).items()]))
    score = F.lit(0.0)
    for name, share in WEIGHTS.items():
        score = score + share * F.col("signals")[name]
    return joined.withColumn("score", F.round(score, 4))


def raw_ranked(rows: DataFrame, *order: Column) -> DataFrame:
    by = order or (F.desc("importance_score"), F.col("event_id"))
    return rows.withColumn("raw_rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), *by)).cast("long"))


def _next_pick(state: Column, trade: float, look_back: int) -> Column:
    """Moves the best of what is left to the picks: score against likeness to the last ``look_back`` of them, the first of equals."""
    last = F.slice(state["picked"], F.greatest(F.size(state["picked"]) - look_back + 1, F.lit(1)), F.lit(look_back))
    worst = lambda x: F.array_max(F.transform(last, lambda p: redundancy_of(x, p)))
    value = lambda x, i: F.struct((F.lit(trade) * x["score"] - F.lit(1 - trade) * worst(x)).alias("v"), (-i).alias("i"))
    first = F.size(state["picked"]) == 0  # the picks begin with the best score, which comes first
    at = F.when(first, 0).otherwise(-F.array_max(F.transform(state["left"], value))["i"])
    chosen = F.element_at(state["left"], at + 1)
    return F.struct(F.concat(state["picked"], F.array(chosen)).alias("picked"), F.filter(state["left"], lambda x, i: i != at).alias("left"))


def reranked(rows: Column, kind: str, trade: float = LAMBDA, look_back: int = LOOK_BACK) -> Column:
    """An array of clusters (sorted by raw rank) in the order of the diversity rerank; one or two stay as they are."""
    start = F.struct(F.array().cast(kind).alias("picked"), rows.alias("left"))
    picked = F.aggregate(F.sequence(F.lit(1), F.size(rows)), start, lambda state, _: _next_pick(state, trade, look_back), lambda state: state["picked"])
    return F.when(F.size(rows) <= 2, rows).otherwise(picked)


def rerank(ranked: DataFrame, trade: float = LAMBDA, look_back: int = LOOK_BACK) -> DataFrame:
    """(user_id, event_id, raw_rank, rank) after the diversity rerank of each user's rows; bound them before."""
    return with_rank(ranked.select("user_id", "event_id", "raw_rank", "score", "event_type", "entities"), trade, look_back).select("user_id", "event_id", "raw_rank", "rank")


def with_rank(ranked: DataFrame, trade: float = LAMBDA, look_back: int = LOOK_BACK) -> DataFrame:
    """The rows with ``rank``, all their columns kept; what is sorted by and compared goes first."""
    terms = [lowered(F.col("entities")[k]).alias(k) for k in REDUNDANCY]
    row = F.struct(F.col("raw_rank").cast("long").alias("raw_rank"), F.col("score").cast("double").alias("score"), "event_type", F.struct(*terms).alias("entities"), F.struct(*ranked.columns).alias("row"))
    rows = ranked.groupBy(F.col("user_id").alias("_user")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    kind = rows.schema["rows"].dataType.simpleString()
    placed = rows.select(F.posexplode(reranked(F.col("rows"), kind)).alias("place", "row"))
    return placed.select("row.row.*", (F.col("place") + 1).cast("long").alias("rank"))


def page_of(rows: DataFrame, page: int, size: int) -> DataFrame:
    """One page of each user's ranked rows, with its number, the place in it, and whether more follow; all by rank, nothing is fetched."""
    total = rows.groupBy("user_id").agg(F.max("rank").alias("_last"))
    here = rows.where(F.col("rank").between(page * size + 1, (page + 1) * size)).join(total, "user_id")
    place = (F.col("rank") - page * size - 1).cast("int")
    return here.withColumns({"page": F.lit(page), "place": place, "has_more": F.col("_last") > (page + 1) * size}).drop("_last")


def explained(ranked: DataFrame, order: DataFrame) -> DataFrame:
    """A row for each cluster: ranks, matches, each signal's contribution, evidence of its oldest item."""
    share = F.struct(*[F.round(w * F.col("signals")[n], 4).alias(n) for n, w in WEIGHTS.items()])
    terms = lowered(F.flatten(F.array(*[F.col("entities")[b] for b in BUCKETS])))
    match = lambda c: F.filter(c, lambda x: F.array_contains(terms, F.lower(x)))
    return ranked.join(order.select("user_id", "event_id", "rank"), ["user_id", "event_id"]).select(
        "user_id", "rank", "raw_rank", "event_id", "title", "event_type", "score", share.alias("contributions"),
        match("followed_projects").alias("matched_projects"), match("interests").alias("matched_interests"), match("muted_topics").alias("matched_mutes"),
        F.element_at("items", 1)["entity_confidence_list"].alias("evidence"),
    )
