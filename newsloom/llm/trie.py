"""The tree of common beginnings of conversations.

A node is a distinct sequence of first turns.  Its members are the conversations
that begin with it, its owner is the smallest of them.  Who owns a beginning owns
all longer ones of its own, so each conversation has a first depth that it owns,
which a binary search finds: in each round all conversations look up, by join,
the owner of their beginning of the middle length.  From there to its end a
conversation owns a chain of nodes; the chain hangs on the node above, which
another conversation owns.  Sums go up the tree of chains, over 1, 2, 4, ...
chains at a time, and are then spread within each chain.

A beginning's key is, for its length, the sum of a hash of each turn with its
place, in four lanes of 32 bits.  So a conversation of any length is summed in
runs by many tasks, and no row holds a conversation.

Defined results: turns go by turn (null first), then by the hash of role and text; a null role
or text is empty; a null conv_id is no conversation; equal rows are turns each;
an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .merkle import crc_sql
from .order import decimal_crc, placed, running_sums, sorted_rows

KEY = ["depth", "k0", "k1", "k2", "k3"]
LANES = KEY[1:]
FAMILY, FEW = 100, 6
ENDS = 4096


def ordered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, n, digest, chars) of each turn, ``pos`` from 0; texts stay behind."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    hashed = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", hashed.alias("digest"), F.length(text).cast("long").alias("chars"))
    return placed(sorted_rows(rows, "conv_id", "turn", "digest", name="turns"), "conv_id")


def _rooted(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """``rows`` (conv_id, depth, digest, chars, total), and the root for each conversation."""
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("digest"), F.lit(0).cast("long").alias("chars"), "total")
    return rows.select(*root.columns).unionByName(root)


def plain(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, chars, total): conversations as they are."""
    rows = staged(ordered(turns), "ordered")
    of = rows.withColumns({"depth": F.col("pos") + 1, "total": F.col("n")})
    return _rooted(of, of.where("pos = 0"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, chars, total) of conversations that share beginnings.

    Conversation c begins with the first h turns of conversation c - c % 100 (all
    if fewer, none if absent), h being the crc32 of its decimal id modulo 6; its
    own turns behind its first h follow.
    """
    rows = staged(ordered(turns), "ordered")
    c = F.col("conv_id")
    first = rows.where("pos = 0").select("conv_id", "n", (c - c % FAMILY).alias("base"), (decimal_crc(c) % FEW).alias("h"))
    size = first.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = first.join(size, "base", "left").withColumn("got", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = staged(convs.withColumn("total", F.col("got") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversations")
    # A long conversation's rows are joined run by run.
    run = convs.select("conv_id", "h", "got", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / ENDS))).alias("run"))
    own = rows.withColumn("run", F.floor(F.col("pos") / ENDS)).join(run, ["conv_id", "run"]).where("pos >= h").withColumn("depth", F.col("pos") - F.col("h") + F.col("got") + 1)
    shared = rows.where((F.col("pos") < FEW - 1) & (c % FAMILY == 0)).select(c.alias("base"), "pos", "digest", "chars")
    begin = convs.select("conv_id", "base", "h", "total").join(shared, "base").where("pos < h").withColumn("depth", F.col("pos") + 1)
    names = ["conv_id", "depth", "digest", "chars", "total"]
    return _rooted(own.select(names).unionByName(begin.select(names)), convs)


def _lane(k: int) -> Column:
    """32 bits of the hash of a turn and its place, 0 for the root."""
    at = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("digest")).cast("binary"), 256)
    return F.coalesce(F.conv(F.substring(at, 8 * k + 1, 8), 16, 10).cast("long"), F.lit(0))


def _first_owned(keyed: DataFrame, nodes: DataFrame, root: int | None) -> DataFrame:
    """(conv_id, first, below, total): the first depth from 1 whose node is owned (total + 1 if none), and the owner of the node above it."""
    search = staged(keyed.where("depth = 0").select("conv_id", F.lit(1).cast("long").alias("first"), (F.col("total") + 1).alias("last"), F.lit(root).cast("long").alias("below"), "total"), "search")
    longest = search.agg(F.max("total")).first()[0] or 0
    probe = keyed.select(F.col("conv_id").alias("_c"), *KEY)
    owners = nodes.select(*KEY, F.col("conv_id").alias("owner"))
    for _ in range(longest.bit_length()):
        open_ = search.where("first < last").withColumn("mid", F.floor((F.col("first") + F.col("last")) / 2))
        found = open_.join(probe, (F.col("conv_id") == F.col("_c")) & (F.col("mid") == F.col("depth"))).join(owners, KEY)
        mine = F.col("owner") == F.col("conv_id")
        step = found.select(
            "conv_id", F.when(mine, F.col("first")).otherwise(F.col("mid") + 1).alias("first"), F.when(mine, F.col("mid")).otherwise(F.col("last")).alias("last"),
            F.when(mine, F.col("below")).otherwise(F.col("owner")).alias("below"), "total",
        )
        search = staged(search.where("first >= last").unionByName(step), "search")
    return search.drop("last")


def _summed_up(chains: DataFrame) -> DataFrame:
    """(conv_id, leaves, saved) of each chain and all that hang on it; ``chains`` also has ``above``, the chain it hangs on.

    Round k adds the sums of the chains 2^k below, and looks 2^(k+1) above next.
    """
    held = staged(chains, "chains")
    while not held.where("above is not null").isEmpty():
        from_below = held.where("above is not null").groupBy(F.col("above").alias("_to")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        onward = held.where("above is not null").select(F.col("conv_id").alias("_via"), F.col("above").alias("_above"))
        held = staged(
            held.join(from_below, F.col("conv_id") == F.col("_to"), "left").join(onward, F.col("above") == F.col("_via"), "left").select(
                "conv_id", F.col("_above").alias("above"), (F.col("leaves") + F.coalesce("_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("_saved", F.lit(0))).alias("saved"),
            ), "chains",
        )
    return held.drop("above")


def _end_digests(keyed: DataFrame) -> DataFrame:
    """The digest of the ids of the conversations that end at each node, in order; ids are joined to texts by ``ENDS``, a node's texts are streamed."""
    at = sorted_rows(keyed.where("depth = total").select(*KEY, "conv_id"), *KEY, "conv_id", name="ends")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = at.groupBy(*KEY, F.floor(F.col("_at") / ENDS).alias("piece")).agg(ids.alias("ids"))
    shape = pa.schema([(k, pa.int64()) for k in KEY] + [("ends_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for batch in batches:
            rows = []
            for *now, _, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now != key:
                    if key is not None:
                        rows.append((*key, held.hexdigest()))
                    key, held = now, hashlib.sha256(text.encode())
                else:
                    held.update(b"," + text.encode())
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(shape.names, r, strict=True)) for r in rows], schema=shape)
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(shape.names, (*key, held.hexdigest()), strict=True))], schema=shape)

    order = [*KEY, "piece"]
    return pieces.repartition(*KEY).sortWithinPartitions(*order).select(*order, "ids").mapInArrow(run, ", ".join(f"{k} long" for k in KEY) + ", ends_sha256 string")


def prefix_trie(rows: DataFrame) -> DataFrame:
    """A row for each node of conversations' rows (conv_id, depth, digest, chars, total), which have their root at depth 0."""
    lanes = staged(rows.select("conv_id", "depth", "chars", "total", *[_lane(k).alias(f"k{k}") for k in range(4)]), "lanes")
    keyed = staged(running_sums(lanes, "conv_id", "depth", LANES), "keyed")
    nodes = staged(keyed.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("chars").alias("chars")), "nodes")
    root = keyed.agg(F.min("conv_id")).first()[0]
    first = staged(_first_owned(keyed, nodes, root), "first")
    is_root = F.col("conv_id") == F.lit(root).cast("long")
    chains = staged(
        first.where(is_root | (F.col("first") <= F.col("total"))).select(
            "conv_id", "total", F.when(is_root, 0).otherwise(F.col("first")).cast("long").alias("first"), F.when(~is_root, F.col("below")).alias("above"),
        ), "chains",
    )
    hung = chains.where("above is not null").groupBy(F.col("above").alias("conv_id"), (F.col("first") - 1).alias("depth")).agg(F.count("*").alias("n"))
    leafy = chains.join(hung.select("conv_id", F.col("depth").alias("total"), "n"), ["conv_id", "total"], "left")
    saved = nodes.groupBy("conv_id").agg(F.sum((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    own = leafy.join(saved, "conv_id").select("conv_id", "above", F.when(F.col("n").isNull(), 1).otherwise(0).cast("long").alias("leaves"), "saved")
    sums = _summed_up(own)

    # What is known about single nodes: where chains begin and end, and what hangs there.
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    begins = chains.select("conv_id", F.col("first").alias("depth"), F.col("above").alias("parent"), zero.alias("end"), zero.alias("hung"), zero.alias("leaves"), zero.alias("saved"))
    ends = chains.select("conv_id", F.col("total").alias("depth"), none, zero + 1, zero, zero, zero)
    hangs = chains.where("above is not null").join(sums, "conv_id").select(F.col("above"), F.col("first") - 1, none, zero, zero + 1, "leaves", "saved")
    marks = begins.union(ends).union(hangs).groupBy("conv_id", "depth").agg(F.max("parent").alias("parent"), F.max("end").alias("end"), *[F.sum(c).alias(c) for c in ("hung", "leaves", "saved")])
    of = nodes.join(marks, ["conv_id", "depth"], "left").join(_end_digests(keyed), KEY, "left")
    children = F.coalesce("hung", F.lit(0)) + 1 - F.coalesce("end", F.lit(0))
    made = of.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"), "n_convs", children.alias("n_children"),
        (F.coalesce("leaves", F.lit(0)) + F.when(children == 0, 1).otherwise(0)).alias("n_leaves"), (F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"), (-F.col("depth")).alias("_up"),
    )
    return running_sums(staged(made, "values"), "conv_id", "_up", ["n_leaves", "saved_tokens"]).drop("_up")


TRIE_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS item, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, {crc_sql("conv_id")} % {FEW} AS h, list(item ORDER BY turn NULLS FIRST, item) AS items, list(chars ORDER BY turn NULLS FIRST, item) AS chars FROM t GROUP BY conv_id
), r AS (
  SELECT o.conv_id, list_concat(coalesce(b.items, [])[1:o.h], o.items[o.h + 1:]) AS items, list_concat(coalesce(b.chars, [])[1:o.h], o.chars[o.h + 1:]) AS chars FROM o LEFT JOIN o b ON b.conv_id = o.base
), p AS (
  SELECT conv_id, d, sha256(array_to_string(items[1:d], ',')) AS key, CASE WHEN d > 0 THEN sha256(array_to_string(items[1:d - 1], ',')) END AS up,
    CASE WHEN d > 0 THEN chars[d] ELSE 0 END AS chars, d = len(items) AS ends FROM (SELECT *, unnest(range(0, len(items) + 1)) AS d FROM r)
), n AS (
  SELECT key, up, d, min(conv_id) AS owner, count(*) AS n, (count(*) - 1) * min(chars) AS saved, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends FROM p GROUP BY key, up, d
), k AS (SELECT up, count(*) AS kids FROM n WHERE up IS NOT NULL GROUP BY up),
below AS (
  SELECT a.key, count(*) FILTER (k.kids IS NULL) AS leaves, sum(n.saved) AS saved
  FROM (SELECT DISTINCT x.key, y.key AS low FROM p x JOIN p y ON x.conv_id = y.conv_id AND y.d >= x.d) a JOIN n ON n.key = a.low LEFT JOIN k ON k.up = n.key GROUP BY a.key
)
SELECT n.owner AS conv_id, n.d AS depth, u.owner AS parent_conv_id, n.n AS n_convs, coalesce(k.kids, 0) AS n_children, b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN below b ON b.key = n.key LEFT JOIN k ON k.up = n.key LEFT JOIN n u ON u.key = n.up
"""
