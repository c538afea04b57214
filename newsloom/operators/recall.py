"""Recall of candidate items: routes, deduplication, vectors."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import cosine
from ..functions.text import content_hash


def one_of_each(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def keep_first(rows: DataFrame, key: str, order: str = "ord") -> DataFrame:
    return one_of_each(rows, key, F.col(order))


def keep_last(rows: DataFrame, key: str, order: str = "ord") -> DataFrame:
    return one_of_each(rows, key, F.desc(order))


def best_variant(rows: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """Of each id the row with most semantic match, importance and newness; ties to the first that came."""
    return one_of_each(rows, key, F.desc("semantic_match_score"), F.desc("importance_score"), F.desc("published_at"), F.col(order))


def routes(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """All routes' rows with ``route`` and ``ord``, the order of arrival: by route, then by place in it."""
    numbered = [
        rows.withColumn("route", F.lit(name)).withColumn("ord", F.lit(i * 1_000_000).cast("long") + F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("published_at"), F.desc("id"))))
        for i, (name, rows) in enumerate(parts)
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def attempted(makers: list[tuple[str, Callable[[], DataFrame]]], required: tuple[str, ...] = ("latest", "trending")) -> list[tuple[str, DataFrame]]:
    """Rows of each route; a failing call of a route that isn't required is left out."""
    out = []
    for name, make in makers:
        try:
            out.append((name, make()))
        except Exception:
            if name in required:
                raise
    return out


# --- vectors -----------------------------------------------------------------


def vectors_of(items: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Items with ``embedding`` where one is stored for their content under the model."""
    mine = latest_vectors(embeddings).where(F.col("model") == model).select(F.col("item_id").alias("id"), F.col("item_hash").alias("_hash"), "embedding")
    return items.withColumn("_hash", content_hash()).join(mine, ["id", "_hash"], "left").drop("_hash")


def latest_vectors(embeddings: DataFrame, keep_seq: bool = False) -> DataFrame:
    """The last written row of each (item, hash, model), by ``seq`` where there is one; rows written at once go by time and vector."""
    order = [*(["seq"] if "seq" in embeddings.columns else []), "published_at", "embedding"]
    kept = ["published_at", "title", "source_name", "embedding", *(["seq"] if keep_seq else [])]
    return embeddings.groupBy("item_id", "item_hash", "model").agg(F.max_by(F.struct(*kept), F.struct(*order)).alias("v")).select("item_id", "item_hash", "model", "v.*")


def pending(items: DataFrame, embeddings: DataFrame, key: str = "item_id") -> DataFrame:
    """Items that have no stored vector yet."""
    return items.join(embeddings.select(key).distinct(), key, "left_anti")


def similar(pool: DataFrame, query: list[float] | Column, vector: str = "embedding") -> DataFrame:
    """The pool with ``semantic_match_score``, rounded to four places; 0 without a vector. ``similarity`` keeps the unrounded one."""
    q = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])
    return pool.withColumn("similarity", cosine(F.col(vector), q)).withColumn("semantic_match_score", F.round("similarity", 4))


def top_similar(pool: DataFrame, k: int, order: str = "ord", by: str = "similarity") -> DataFrame:
    """The ``k`` nearest rows, ties to the earlier ``order``; ``by`` the rounded score, what it shows as equal is a tie."""
    return pool.orderBy(F.desc(by), F.col(order)).limit(k)


#: Digits to which similarities are told apart when many profiles are answered at once.
TIE_DIGITS = 9


def top_similar_batch(profiles: DataFrame, pool: DataFrame, k: int, pool_rows: int = 4096, profile_rows: int = 1024) -> DataFrame:
    """(user_id, rank, id, similarity): the ``k`` vectors of the pool (id, ord, embedding) nearest to each profile's ``vector``.

    Both sides are cut into blocks by hash, and each pair of blocks is one matrix
    product, of which ``k`` rows a profile go on; so memory is bounded by two
    blocks, and the merge by ``k`` rows for each profile and block of the pool.
    Similarities that agree to nine digits are equal, and the earlier ``ord``
    wins.  Null, empty, zero or differently long vectors are like nothing: 0.
    """
    n_pool = max(1, -(-pool.count() // pool_rows))
    n_profiles = max(1, -(-profiles.count() // profile_rows))
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = pool.select(F.col("id").cast("string").alias("id"), F.col("ord").cast("long").alias("ord"), "embedding", F.pmod(F.xxhash64("id"), F.lit(n_pool)).cast("int").alias("b"), blocks(n_profiles).alias("p"))
    right = profiles.select("user_id", "vector", F.pmod(F.xxhash64("user_id"), F.lit(n_profiles)).cast("int").alias("p"), blocks(n_pool).alias("b"))

    def unit(vectors: pd.Series, size: int) -> np.ndarray:
        out = np.zeros((len(vectors), size))
        for i, v in enumerate(vectors):
            if v is not None and len(v) == size:
                length = np.sqrt(np.dot(a := np.asarray(v, float), a))
                if length > 0:
                    out[i] = a / length
        return out

    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        rows = rows.sort_values("ord", kind="stable").reset_index(drop=True)
        sizes = asked["vector"].map(lambda v: 0 if v is None else len(v))
        for size, part in asked.groupby(sizes):
            likeness = np.round(unit(part["vector"], size) @ unit(rows["embedding"], size).T, TIE_DIGITS) + 0.0
            best = np.argsort(-likeness, axis=1, kind="stable")[:, :k]
            for user, at, line in zip(part["user_id"], best, likeness, strict=True):
                found.append(pd.DataFrame({"user_id": user, "id": rows["id"].to_numpy()[at], "ord": rows["ord"].to_numpy()[at], "similarity": line[at]}))
        return pd.concat(found) if found else pd.DataFrame({"user_id": [], "id": [], "ord": [], "similarity": []})

    near = left.groupBy("b", "p").cogroup(right.groupBy("b", "p")).applyInPandas(run, "user_id string, id string, ord long, similarity double")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("similarity"), "ord", "id"))
    return near.withColumn("rank", place).where(F.col("rank") <= k).select("user_id", "rank", "id", "similarity")


def supplemented(base: DataFrame, wider: DataFrame | None, query: list[float], k: int, vector: str = "embedding") -> DataFrame:
    """``base`` with semantic scores, and the ``k`` items of the pool nearest to the query as one more route.

    The pool is ``base`` and, behind it, ``wider``; both have ``ord`` and ``embedding``, and the first row of an id counts.
    """
    shift = 1_000_000_000
    behind = [] if wider is None else [wider.withColumn("ord", F.col("ord") + shift)]
    pool = similar(keep_first(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [base, *behind]), "id"), query, vector)
    hits = top_similar(pool.where(F.col(vector).isNotNull()), k).withColumn("route", F.lit("semantic")).withColumn("ord", F.col("ord") + 2 * shift)
    out = similar(base, query, vector).unionByName(hits, allowMissingColumns=True)
    return out.drop(vector, "similarity")


def pair_similarity(pairs: DataFrame, left: str, right: str) -> DataFrame:
    return pairs.withColumn("similarity", cosine(F.col(left), F.col(right)))
