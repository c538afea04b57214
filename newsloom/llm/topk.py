"""Exact top-k search by inner product with a pivot-distance index.

Vectors are turned into integers and, for the bounds, moved to a sphere: with
one more component ``sqrt(M^2 - |x|^2)`` (M: the largest norm) every vector has
norm M, and the largest inner product is the smallest distance.  Each data
partition is indexed where it lies, in segments: every vector is keyed by its
nearest pivot and its distance to it, and each pivot's vectors are sorted by
that distance.  Pivots come from a bounded sample (``pivots`` of ``sample_rows``
vectors); every row is indexed.  The segments are written once and read by every
block of queries.

Queries come in blocks of at most about ``block_rows``, one at a time, each
broadcast and held against all segments.  For a query at distance d from a
pivot, only the annulus [d - r, d + r] can hold a vector within distance r
(triangle inequality); each query goes outwards from its own d, chunk by chunk,
while r shrinks with the k-th best score, and stops on either side once that
lies beyond the bound.  r starts from the k-th best score against the sample, a
valid lower bound as the sample consists of candidates.  Rounding is covered by
a margin on the radius; scores are sums of integers, exact while the largest
squared norm is below 2^53, and rounded to a double beyond.

Defined results: vectors that are null, hold null or non-finite components, or
have another length than most of those without (the shorter, on a tie) take no
part; ties go to the smaller id; rows with a null id take no part; repeated ids
count as they come, and a query leaves out all rows of its id; other columns
play no part.  No valid vector: no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, staged

CHUNK = 512
SEGMENT = 65536
MARGIN = 1e-6


def quantised(ids: pa.Array, vectors: pa.Array, scale: float, dims: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and integer vectors (as float64) of the rows that take part."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    ok = np.asarray(vectors.is_valid()) & np.asarray(ids.is_valid())
    lengths = np.asarray(vectors.value_lengths().fill_null(0))
    if dims is None:
        dims = int(lengths[ok][0]) if ok.any() and lengths[ok][0] else 0
    ok &= (lengths == dims) & (dims > 0)
    if not ok.any():
        return np.zeros(0, np.int64), np.zeros((0, dims or 0))
    picked = vectors.filter(pa.array(ok))
    flat = picked.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    finite = np.isfinite(flat).all(1)
    keys = np.asarray(ids.filter(pa.array(ok)).cast(pa.int64()))[finite]
    return keys, np.floor(scale * flat[finite])


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest, ties to the smaller id."""
    if len(scores) > 4 * k:
        cut = -np.partition(-scores, k - 1)[k - 1]
        keep = scores >= cut
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


class Segment:
    """Index over one block of vectors: pivots, sorted distances, vectors in that order."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, m2: float):
        norm2 = (x * x).sum(1)
        self.extra = np.sqrt(np.maximum(m2 - norm2, 0))
        lifted = np.column_stack([x, self.extra])
        d2 = (lifted * lifted).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * lifted @ pivots.T
        near = d2.argmin(1)
        dist = np.sqrt(np.maximum(d2[np.arange(len(x)), near], 0))
        order = np.lexsort((ids, dist, near))
        self.ids, self.x, self.dist, near = ids[order], x[order], dist[order], near[order]
        bounds = np.searchsorted(near, np.arange(len(pivots) + 1))
        self.cells = [(p, int(bounds[p]), int(bounds[p + 1])) for p in range(len(pivots)) if bounds[p] < bounds[p + 1]]

    @classmethod
    def of(cls, held: tuple) -> Segment:
        out = cls.__new__(cls)
        out.ids, x, out.dist, out.cells = held
        out.x = x.astype(np.float64)
        return out


def search(segment: Segment, q: np.ndarray, q_ids: np.ndarray, q_pivot: np.ndarray, floor: np.ndarray, m2: float, k: int, own: dict):
    """Bring ``own`` (query -> (scores, ids)) up to date with the segment's vectors; ``floor`` rises with it."""
    q2 = (q * q).sum(1)
    # Query norm differs from M: |q~ - x~|^2 = |q|^2 + M^2 - 2 q.x with the query's extra component 0.
    def reach(who: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(q2[who] + m2 - 2 * floor[who], 0)) * (1 + MARGIN) + MARGIN

    def hold(who: np.ndarray, a: int, b: int) -> None:
        scores = q[who] @ segment.x[a:b].T
        hit = scores >= floor[who][:, None]
        for row in np.flatnonzero(hit.any(1)):
            j = who[row]
            cols = np.flatnonzero(hit[row])
            s, i = scores[row, cols], segment.ids[a:b][cols]
            other = i != q_ids[j]
            s, i = s[other], i[other]
            if len(s):
                old = own.get(j)
                if old is not None:
                    s, i = np.concatenate([old[0], s]), np.concatenate([old[1], i])
                own[j] = best = _best(s, i, k)
                if len(best[0]) == k:
                    floor[j] = max(floor[j], best[0][-1])

    for p, start, stop in sorted(segment.cells, key=lambda c: float(q_pivot[:, c[0]].mean())):
        edges = np.append(np.arange(start, stop, CHUNK), stop)
        inner, outer = segment.dist[edges[:-1]], segment.dist[edges[1:] - 1]  # of each chunk
        home = np.clip(np.searchsorted(inner, q_pivot[:, p], side="right") - 1, 0, len(inner) - 1)
        # Step by step outwards; a query stays on a side while the next chunk there meets its annulus.
        sides = [(np.arange(len(q)), 0, 1), (np.arange(len(q)), -1, -1)]
        while sides:
            following = []
            for who, step, way in sides:
                at = home[who] + step
                who, at = who[(at >= 0) & (at < len(inner))], at[(at >= 0) & (at < len(inner))]
                d, r = q_pivot[who, p], reach(who)
                more = inner[at] <= d + r if way > 0 else outer[at] >= d - r
                near = more & (inner[at] <= d + r) & (outer[at] >= d - r)
                for c in np.unique(at[near]):
                    hold(who[near & (at == c)], int(edges[c]), int(edges[c + 1]))
                if more.any():
                    following.append((who[more], step + way, way))
            sides = following


def top_k(
    df: DataFrame, queries: DataFrame, id_column: str = "vec_id", vector: str = "embedding", k: int = 20, scale: float = 64.0,
    pivots: int = 32, sample_rows: int = 4096, block_rows: int = 8192,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for each row of ``queries`` against all rows of ``df`` but its own."""
    spark = df.sparkSession
    schema = "query_id long, vec_id long, score long"
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("v"))
    asked = queries.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
    usable = rows.where("id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('inf'))")
    common = usable.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims = int(common["n"])
    usable = usable.where(F.size("v") == dims)
    first = bounded_sample(usable, ["id"], sample_rows).toArrow()
    s_ids, s_x = quantised(first.column("id").combine_chunks(), first.column("v"), scale, dims)
    whole = F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    m2 = float(usable.select(F.max(F.aggregate(whole, F.lit(0.0), lambda a, x: a + x * x))).first()[0])
    lifted = np.column_stack([s_x, np.sqrt(np.maximum(m2 - (s_x * s_x).sum(1), 0))])
    # Pivots far from each other: each next one is the sampled vector farthest from those taken.
    chosen, away = [0], np.full(len(lifted), np.inf)
    while len(chosen) < min(pivots, len(lifted)):
        away = np.minimum(away, ((lifted - lifted[chosen[-1]]) ** 2).sum(1))
        if away.max() <= 0:
            break
        chosen.append(int(away.argmax()))
    centres = lifted[chosen]

    asked = asked.where(F.size("v") == dims)
    blocks = max(1, -(-asked.count() * 5 // (block_rows * 4)))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def segment() -> pa.RecordBatch:
            made = Segment(np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held]), centres, m2)
            row = [pickle.dumps((made.ids, made.x if m2 >= 1 << 48 else made.x.astype(np.float32), made.dist, made.cells), 5)]
            return pa.RecordBatch.from_arrays([pa.array(row, pa.binary())], names=["segment"])

        for batch in batches:
            ids, x = quantised(batch.column(0), batch.column(1), scale, dims)
            if len(ids):
                held.append((ids, x))
                size += len(ids)
            if size >= SEGMENT:
                yield segment()
                held, size = [], 0
        if held:
            yield segment()

    index = staged(rows.mapInArrow(build, "segment binary"), "segments")
    parts: list[DataFrame] = []
    for block in range(blocks):
        table = (asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block) if blocks > 1 else asked).toArrow()
        q_ids, q = quantised(table.column("id").combine_chunks(), table.column("v"), scale, dims)
        if not len(q_ids):
            continue
        floor = np.full(len(q), -np.inf)
        for i in range(0, len(q), 1024):
            scores = q[i : i + 1024] @ s_x.T
            scores[q_ids[i : i + 1024, None] == s_ids[None]] = -np.inf
            if scores.shape[1] >= k:
                floor[i : i + 1024] = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        shared = spark.sparkContext.broadcast((q_ids, q, floor, centres, m2))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q_ids, q, floor, centres, m2 = shared.value
            floor, own = floor.copy(), {}
            d2 = (q * q).sum(1)[:, None] + (centres * centres).sum(1)[None] - 2 * q @ centres[:, :-1].T
            q_pivot = np.sqrt(np.maximum(d2, 0))
            for batch in batches:
                for packed in batch.column(0):
                    search(Segment.of(pickle.loads(packed.as_py())), q, q_ids, q_pivot, floor, m2, k, own)
            found = sorted(own)
            for i in range(0, len(found), 2000):
                part = found[i : i + 2000]
                n = [len(own[j][0]) for j in part]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(q_ids[part], n)),
                        pa.array(np.concatenate([own[j][1] for j in part]).astype(np.int64)),
                        pa.array(np.concatenate([own[j][0] for j in part]).astype(np.int64)),
                    ],
                    names=["query_id", "vec_id", "score"],
                )

        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        best = index.mapInArrow(run, schema).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if blocks > 1:  # one block's queries at a time
            best = staged(best, "best")
            shared.destroy()
        parts.append(best)
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
