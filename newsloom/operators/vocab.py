"""Vocabulary discovery and promotion: candidate roll-up, review, decay, lifecycle, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import candidate_key, category_key, cleaned_name, display_name, is_noise, review_name, source_id

STATUS_ORDER = ("active", "cooling", "archived")
_STRINGS = "array<string>"


def _empty() -> Column:
    return F.array().cast(_STRINGS)


def sanitised(mentions: DataFrame) -> DataFrame:
    """Mentions with ``key``, ``name`` and cleaned ``aliases``; noise is dropped.

    Names repeat, so each distinct one is cleaned once and the mentions are joined with the result.
    """
    same = ["category", "canonical_name", "aliases"]
    own = cleaned_name(F.col("canonical_name"))
    key = category_key(F.col("category"), candidate_key(own))
    raw = F.array_distinct(F.concat(F.array(own), F.filter(F.transform(F.coalesce("aliases", _empty()), cleaned_name), lambda a: a != "")))
    names = mentions.groupBy(same).agg(F.count("*").alias("_n")).withColumns({"_own": own, "key": key}).withColumn("_aliases", F.filter(raw, lambda a: category_key(F.col("category"), candidate_key(a)) != F.col("key")))
    combined = F.concat_ws(" ", F.col("key"), F.array_join(F.transform("_aliases", candidate_key), " "))
    # Tied to the count, the filter stays above the grouping and runs once for each name.
    names = names.where(F.when(F.col("_n") > 0, (F.col("key") != "") & ~is_noise(F.col("category"), combined)))
    fallback = F.when(candidate_key(F.col("_own")) == F.col("key"), F.col("_own")).otherwise("")
    clean = names.select(
        *[F.col(c).alias(f"_raw_{c}") for c in same], "key", display_name(F.col("category"), F.col("key"), fallback).alias("name"), F.filter("_aliases", lambda a: a != "").alias("_clean")
    )
    on = [F.col(c).eqNullSafe(F.col(f"_raw_{c}")) for c in same]
    return mentions.join(clean, on).withColumn("aliases", F.col("_clean")).drop("_clean", *[f"_raw_{c}" for c in same])


def new_only(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose (category, key) is not in the vocabulary."""
    return rows.join(known.select("category", "key").distinct(), ["category", "key"], "left_anti")


def most_frequent(rows: DataFrame, keys: list[str], value: str, order: str, most: int, name: str) -> DataFrame:
    """For each group its ``most`` most frequent values, ties to the first seen."""
    counted = rows.where(F.coalesce(F.col(value), F.lit("")) != "").groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("o"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "o", value))
    kept = counted.withColumn("p", place).where(F.col("p") <= most)
    return kept.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", F.col(value).alias("v")))), lambda s: s["v"]).alias(name))


def smallest(rows: DataFrame, keys: list[str], value: str, most: int, name: str) -> DataFrame:
    """For each group its ``most`` smallest values that are not blank; ``rows`` has each value once."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    kept = rows.where(F.coalesce(F.col(value), F.lit("")) != "").select(*keys, value).withColumn("p", place).where(F.col("p") <= most)
    return kept.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias(name))


def aggregated(mentions: DataFrame, known: DataFrame, min_mentions: int = 2, min_docs: int = 2) -> DataFrame:
    """Candidates with counts, names and evidence that reach both thresholds."""
    keys = ["category", "key"]
    rows = new_only(sanitised(mentions), known)
    by_title = rows.groupBy(*keys, F.trim("evidence_title").alias("title")).agg(F.count("*").alias("n"))
    base = by_title.groupBy(*keys).agg(F.sum("n").alias("mention_count"), F.count(F.nullif("title", F.lit(""))).alias("doc_count"))
    base = base.where((F.col("mention_count") >= min_mentions) & (F.col("doc_count") >= min_docs))
    titles = smallest(by_title, keys, "title", 5, "evidence_titles")
    sources = smallest(rows.select(*keys, F.trim("evidence_source").alias("source")).distinct(), keys, "source", 8, "source_names")
    names = most_frequent(rows, keys, "name", "ord", 1, "_names")
    exploded = rows.select(*keys, "ord", F.posexplode("aliases").alias("at", "alias")).withColumn("o", F.struct("ord", "at"))
    aliases = most_frequent(exploded.drop("ord").withColumnRenamed("o", "ord"), keys, "alias", "ord", 8, "aliases")
    return (
        base.join(titles, keys, "left").join(sources, keys, "left").join(names, keys, "left").join(aliases, keys, "left")
        .withColumns({c: F.coalesce(c, _empty()) for c in ("evidence_titles", "source_names", "aliases")})
        .withColumn("canonical_name", F.coalesce(F.element_at("_names", 1), F.col("key"))).drop("_names")
    )


def discovery_counters(mentions: DataFrame, known: DataFrame, min_mentions: int = 2, min_docs: int = 2) -> DataFrame:
    """One row of counters: mentions, kept, filtered, known, below the thresholds."""
    kept = sanitised(mentions)
    new = new_only(kept, known)
    groups = new.groupBy("category", "key").agg(F.count("*").alias("n"), F.countDistinct("evidence_title").alias("d"))
    below = groups.agg(F.count("*").alias("keys"), F.count_if((F.col("n") < min_mentions) | (F.col("d") < min_docs)).alias("below_threshold"))
    counts = mentions.agg(F.count("*").alias("mentions")).join(kept.agg(F.count("*").alias("kept"))).join(new.agg(F.count("*").alias("new")))
    return counts.join(below).select("mentions", (F.col("mentions") - F.col("kept")).alias("filtered"), (F.col("kept") - F.col("new")).alias("known"), "keys", "below_threshold")


def batch_histogram(mentions: DataFrame, examples: int = 8) -> DataFrame:
    """For each batch its mentions, count by category, and first examples."""
    counts = mentions.groupBy("batch_id", "category").agg(F.count("*").alias("n"))
    by = counts.groupBy("batch_id").agg(F.sum("n").alias("mentions"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("categories"))
    place = F.row_number().over(Window.partitionBy("batch_id").orderBy("ord"))
    few = mentions.withColumn("p", place).where(F.col("p") <= examples)
    shown = few.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("p", "category", "canonical_name", F.slice(F.coalesce("aliases", _empty()), 1, 4).alias("aliases")))).alias("examples"))
    return by.join(shown, "batch_id")


def reviewed(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates after review: kept, merged, or gone (dropped or merged into a vocabulary). The last decision counts.

    ``decisions`` has an ``ord`` column that says which came last.
    """
    last = decisions.groupBy("source_id").agg(F.max_by(F.struct("action", "final_category", "final_canonical_name", "final_aliases"), "ord").alias("d"))
    rows = candidates.withColumn("source_id", source_id(F.col("category"), F.col("canonical_name"))).join(last, "source_id", "left")
    action = F.coalesce("d.action", F.lit("keep"))
    rows = rows.where(~action.isin("drop", "merge_into_builtin", "merge_into_dynamic"))
    category = F.coalesce(F.nullif("d.final_category", F.lit("")), F.col("category"))
    rows = rows.withColumn("_c", category).withColumn("_name", review_name(F.col("_c"), F.coalesce(F.nullif("d.final_canonical_name", F.lit("")), F.col("canonical_name"))))
    rows = rows.withColumn("_key", category_key(F.col("_c"), candidate_key(F.col("_name"))))
    rows = rows.withColumn("_aliases", F.concat("aliases", F.coalesce("d.final_aliases", _empty()), F.when(F.col("_name") != F.col("canonical_name"), F.array("canonical_name")).otherwise(_empty())))
    merged = rows.groupBy(F.col("_c").alias("category"), F.col("_key").alias("key")).agg(
        F.min_by("_name", F.struct(-F.col("mention_count"), "source_id")).alias("canonical_name"), F.sum("mention_count").alias("mention_count"),
        F.max("doc_count").alias("_docs"), F.array_distinct(F.flatten(F.collect_list("evidence_titles"))).alias("_titles"),
        F.array_distinct(F.flatten(F.collect_list("source_names"))).alias("_sources"), F.array_distinct(F.flatten(F.collect_list("_aliases"))).alias("_all"),
    )
    return merged.select(
        "category", "key", "canonical_name", "mention_count", F.greatest(F.col("_docs"), F.size("_titles").cast("long")).alias("doc_count"),
        F.slice(F.array_sort(F.filter("_all", lambda a: a != F.col("canonical_name"))), 1, 8).alias("aliases"),
        F.slice(F.array_sort("_titles"), 1, 5).alias("evidence_titles"), F.slice(F.array_sort("_sources"), 1, 8).alias("source_names"),
    )


# --- promotion ---------------------------------------------------------------


def recent(candidates: DataFrame, runs: DataFrame, look_back: int = 6) -> DataFrame:
    """Candidates of the newest runs with the run's time; the number of runs bounds the small side."""
    last = runs.orderBy(F.desc("run_id")).limit(look_back).select("run_id", "created_at")
    return candidates.join(last, "run_id")


def promoted(rows: DataFrame, min_hits: int = 3, min_mentions: int = 6, min_docs: int = 2, min_sources: int = 2) -> DataFrame:
    """Roll-up over runs with time decay; keys that reach all four thresholds."""
    newest = rows.agg(F.max("created_at").alias("_newest"))
    age = (F.unix_micros("_newest") - F.unix_micros("created_at")) / 3.6e9
    weight = F.greatest(F.col("doc_count"), F.lit(1)) / (1 + F.greatest(age, F.lit(0.0)) / 24)
    out = rows.join(newest).withColumn("_w", weight).groupBy("category", "canonical_name").agg(
        F.countDistinct("run_id").alias("run_hits"), F.sum("mention_count").alias("total_mentions"), F.max("doc_count").alias("max_doc_count"),
        F.size(F.array_distinct(F.flatten(F.collect_set("source_names")))).cast("long").alias("source_diversity"), F.round(F.sum("_w"), 4).alias("decayed_run_score"),
        F.max("run_id").alias("last_seen_run_id"), *[F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), 1, 8).alias(c) for c in ("aliases", "evidence_titles", "source_names")],
    )
    return out.where((F.col("run_hits") >= min_hits) & (F.col("total_mentions") >= min_mentions) & (F.col("max_doc_count") >= min_docs) & (F.col("source_diversity") >= min_sources))


def lifecycle(qualified: DataFrame, existing: DataFrame, seen: DataFrame, run_id: int, now: Column, cooling_cycles: int = 2) -> DataFrame:
    """The next snapshot: qualified keys are active; others cool and are then archived.

    ``seen``: (category, canonical_name, last_seen_run_id) of all recent candidates.
    """
    keys = ["category", "canonical_name"]
    details = ["run_hits", "total_mentions", "max_doc_count", "source_diversity", "decayed_run_score", "aliases", "evidence_titles", "source_names"]
    q, e = qualified.withColumn("_q", F.lit(True)).alias("q"), existing.withColumn("_e", F.lit(True)).alias("e")
    rows = q.join(e, keys, "full_outer").join(seen.select(*keys, F.col("last_seen_run_id").alias("_seen")), keys, "left")
    is_new, run = F.coalesce("q._q", F.lit(False)), F.lit(run_id).cast("long")
    advanced = F.coalesce(F.col("e.last_evaluated_run_id"), F.lit(-1)) < run
    stale = F.coalesce("e.stale_cycles", F.lit(0)) + F.when(advanced, 1).otherwise(0)
    cooled = F.col("e.status") == "cooling"
    status = F.when(is_new, "active").when(F.col("e.status") == "archived", "archived").when(cooled & (stale >= cooling_cycles), "archived").otherwise("cooling")
    rows = rows.withColumns({"_status": status, "_stale": F.when(is_new, F.lit(0)).otherwise(stale).cast("long")})
    return rows.select(
        *keys, F.col("_status").alias("status"), *[F.when(is_new, F.col(f"q.{c}")).otherwise(F.col(f"e.{c}")).alias(c) for c in details],
        F.coalesce("_seen", "q.last_seen_run_id", "e.last_seen_run_id").alias("last_seen_run_id"),
        F.when(is_new, run).otherwise(F.col("e.last_qualified_run_id")).alias("last_qualified_run_id"), run.alias("last_evaluated_run_id"),
        F.col("_stale").alias("stale_cycles"),
        F.when(F.col("_status") == "active", None).otherwise(F.coalesce("e.cooling_started_at", now)).alias("cooling_started_at"),
        F.when(F.col("_status") == "archived", F.coalesce("e.archived_at", now)).alias("archived_at"),
        F.when(is_new, now).otherwise(F.col("e.promoted_at")).alias("promoted_at"),
    )


def in_status_order(rows: DataFrame) -> DataFrame:
    """A snapshot by status, then score, hits, sources and mentions, the highest first."""
    return rows.orderBy(*status_order())


def status_order() -> list[Column]:
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, STATUS_ORDER)), F.col("status")), F.lit(0)), F.lit(9))
    return [place, *map(F.desc, ("decayed_run_score", "run_hits", "source_diversity", "total_mentions")), F.col("category"), F.col("canonical_name")]


def in_score_order(rows: DataFrame) -> DataFrame:
    """Promoted candidates by score, hits, sources, mentions and documents, the highest first."""
    return rows.orderBy(*score_order())


def score_order() -> list[Column]:
    return [*map(F.desc, ("decayed_run_score", "run_hits", "source_diversity", "total_mentions", "max_doc_count")), F.col("category"), F.col("canonical_name")]


def in_count_order(rows: DataFrame) -> DataFrame:
    """Candidates by documents, then mentions, the highest first."""
    return rows.orderBy(*count_order())


def count_order() -> list[Column]:
    return [F.desc("doc_count"), F.desc("mention_count"), F.col("category"), F.col("canonical_name")]


def discovery_examples(mentions: DataFrame, known: DataFrame, min_mentions: int = 2, min_docs: int = 2, most: int = 10) -> DataFrame:
    """(reason, category, canonical_name, count, doc_count, place): the commonest candidates that cleaning, the vocabulary or the thresholds filter."""
    kept = sanitised(mentions)
    new = new_only(kept, known)
    keys = ["category", "canonical_name"]
    left = kept.groupBy(*keys).agg(F.count("*").alias("_kept"))
    every = mentions.groupBy(*keys).agg(F.count("*").alias("_all")).join(left, keys, "left")
    cleaned = every.withColumn("count", F.col("_all") - F.coalesce("_kept", F.lit(0))).where(F.col("count") > 0)
    existing = kept.join(known.select("category", "key").distinct(), ["category", "key"], "left_semi").groupBy("category", F.col("name").alias("canonical_name")).agg(F.count("*").alias("count"))
    groups = new.groupBy("category", "key").agg(F.count("*").alias("count"), F.countDistinct(F.nullif(F.trim("evidence_title"), F.lit(""))).alias("doc_count"))
    few = groups.where((F.col("count") < min_mentions) | (F.col("doc_count") < min_docs)).withColumnRenamed("key", "canonical_name")
    none = F.lit(None).cast("long").alias("doc_count")
    parts = [("cleaning", cleaned.select(*keys, "count", none), []), ("existing", existing.select(*keys, "count", none), []), ("threshold", few.select(*keys, "count", "doc_count"), ["doc_count"])]
    out = []
    for reason, rows, first in parts:
        top = rows.orderBy(*[F.desc(c) for c in first], F.desc("count"), *keys).limit(most)
        place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*[F.desc(c) for c in first], F.desc("count"), *keys))
        out.append(top.select(F.lit(reason).alias("reason"), *keys, "count", "doc_count", place.alias("place")))
    return out[0].unionByName(out[1]).unionByName(out[2])


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def newest_run(rows: DataFrame, column: str = "run_id") -> DataFrame:
    return rows.agg(F.coalesce(F.max(column), F.lit(0)).cast("long").alias("latest_run_id"))


def exported(rows: DataFrame) -> DataFrame:
    """(category, key, aliases) of active entries: the name first, then trimmed distinct aliases; token keys upper."""
    active = rows.where("status = 'active'")
    names = F.filter(F.transform(F.concat(F.array("canonical_name"), F.coalesce("aliases", _empty())), lambda a: F.trim(a)), lambda a: a != "")
    key = F.when(F.col("category") == "token", F.upper("canonical_name")).otherwise(F.col("canonical_name"))
    return active.select("category", key.alias("key"), F.array_distinct(names).alias("aliases"))


EXPORT_NAMES = {"project": "entity_aliases", "token": "token_aliases", "topic": "topic_aliases", "event_keyword": "event_keywords"}


def export_document(rows: DataFrame) -> DataFrame:
    """One row ``value``: the active vocabulary as a JSON object."""
    entries = exported(rows).groupBy("category").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "aliases")))).alias("m"))
    none = F.map_from_arrays(_empty(), F.array().cast("array<array<string>>"))
    of = lambda c: F.coalesce(F.max(F.when(F.col("category") == c, F.to_json("m"))), F.to_json(none))
    parts = entries.agg(*[of(c).alias(n) for c, n in EXPORT_NAMES.items()])
    return parts.select(F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{n}":'), F.col(n)) for n in EXPORT_NAMES.values()]), F.lit("}")).alias("value"))
