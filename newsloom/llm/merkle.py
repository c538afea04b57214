"""A Merkle manifest of a dataset: a tree for each source, and one over the sources.

Leaves are ordered and cut into blocks of ``FAN ** LEVELS``.  A block is one row
with its leaves as an array, and collapses by array functions alone: ``slice``
cuts a level into runs of ``FAN``, ``transform`` over a ``sequence`` of runs
hashes them, ``aggregate`` repeats that level by level.  Roots of blocks are the
leaves of the next round, until a tree is one block; then proofs come down the
same way.  No row holds more than a block, so a source of any size spreads.

A digest is lowercase hex sha256 of its inputs, concatenated, digests as text.

Defined results: a null field counts as ``-``; a null doc_id comes first and is
never tampered with; equal rows are leaves of their own; a lone leaf is its
source's root, and a lone source's root the root; an empty table gives no rows;
columns beyond the five are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .order import decimal_crc, placed, sorted_rows

FAN = 16
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_of(fields: tuple[str, ...] = FIELDS, **instead: Column) -> Column:
    """The leaf of a row: for each field its UTF-8 length, a colon and its value, or a dash."""
    values = [instead.get(f, F.col(f)).cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values])


def lowered_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def height(n: Column) -> Column:
    """Levels above ``n`` nodes, until one is left."""
    return sum((F.when(n > FAN**k, 1).otherwise(0) for k in range(15)), F.lit(0))


def _levels_of(nodes: Column, n: Column) -> Column:
    """All levels of a block: its nodes, then the runs of each level below."""
    many = F.least(height(n), F.lit(LEVELS))
    run = lambda level, i: F.sha2(F.array_join(F.slice(level, i * FAN + 1, FAN), "").cast("binary"), 256)
    up = lambda level: F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FAN).cast("int")), lambda i: run(level, i))
    return F.aggregate(F.slice(F.sequence(F.lit(1), F.lit(LEVELS)), 1, many), F.array(nodes), lambda acc, _: F.concat(acc, F.array(up(F.element_at(acc, -1)))))


def _steps(levels: Column, i: Column) -> Column:
    """What stands left and right of the node of place ``i``, level by level within its block."""

    def step(level: Column, k: Column) -> Column:
        at = F.floor(i / F.pow(F.lit(float(FAN)), k)).cast("int")
        first = at - at % FAN
        text = lambda a, m: F.array_join(F.slice(level, a + 1, m), "")
        return F.struct(text(first, at - first).alias("left"), text(at + 1, first + FAN - 1 - at).alias("right"))

    return F.transform(F.slice(levels, 1, F.size(levels) - 1), step)


def _blocks(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """(tree, block, n, rows, levels) of nodes (tree, pos, n, node, *carried)."""
    size = FAN**LEVELS
    rows = nodes.groupBy("tree", F.floor(F.col("pos") / size).alias("block"), "n").agg(F.array_sort(F.collect_list(F.struct("pos", "node", *carried))).alias("rows"))
    return rows.withColumn("levels", _levels_of(F.transform("rows", lambda r: r["node"]), F.col("n")))


def _roots(blocks: DataFrame) -> DataFrame:
    """Roots of blocks as nodes of the next round."""
    n = F.ceil(F.col("n") / FAN**LEVELS).cast("long")
    return blocks.select("tree", F.col("block").alias("pos"), n.alias("n"), F.element_at(F.element_at("levels", -1), 1).alias("node"))


def proofs(nodes: DataFrame) -> DataFrame:
    """(tree, pos, steps, root) of nodes (tree, pos, n, node); trees of one node have no steps. Rounds: 12 bits of the largest tree each."""
    if not (nodes.agg(F.max("n")).first()[0] or 0) > 1:
        return nodes.select("tree", "pos", F.array().cast(STEPS).alias("steps"), F.col("node").alias("root"))
    return _down(staged(_blocks(nodes, []), "blocks"), lambda r, steps, root: F.struct(F.col("tree"), r["pos"].alias("pos"), steps.alias("steps"), root.alias("root")))


def _down(blocks: DataFrame, emit: Callable[[Column, Column, Column], Column], above: DataFrame | None = None) -> DataFrame:
    """Rows that ``emit`` makes of each row of the blocks, its steps to the top and the root."""
    above = _above(blocks) if above is None else above
    near = above.select(F.col("tree").alias("_tree"), F.col("pos").alias("_block"), F.col("steps").alias("_steps"), *[c for c in above.columns if c not in ("tree", "pos", "steps")])
    joined = blocks.join(near, (F.col("tree") == F.col("_tree")) & (F.col("block") == F.col("_block")))
    made = F.transform("rows", lambda r, i: emit(r, F.concat(_steps(F.col("levels"), i), F.col("_steps")), F.col("root")))
    return joined.select(F.inline(made))


def _above(blocks: DataFrame) -> DataFrame:
    return staged(proofs(staged(_roots(blocks), "roots")), "above")


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row.

    ``tampered`` says for which rows the fold begins with the leaf of the row
    with lower-cased text; without it every fold begins with the row's own leaf.
    """
    changed = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    # A tree's name: empty for null, else a blank and the source; it has the sources' order.
    tree = F.coalesce(F.concat(F.lit(" "), F.col("source").cast("string")), F.lit(""))
    claimed = F.when(changed, leaf_of(text=lowered_ascii(F.col("text"))))
    leaves = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of().alias("node"), claimed.alias("claimed"))
    # Sorting reads its rows twice, texts only once.
    in_order = sorted_rows(staged(leaves, "leaves"), "tree", "doc_id", "node")
    blocks = staged(_blocks(placed(in_order, "tree"), ["doc_id", "claimed"]), "blocks")
    above = _above(blocks)
    subroots = above.where("pos = 0").select(F.lit("").alias("all"), "tree", F.col("root").alias("node"))
    top = staged(placed(sorted_rows(subroots, "all", "tree", name="subroots"), "all"), "subroots")
    of_top = proofs(top.select(F.col("all").alias("tree"), "pos", "n", "node")).select(F.col("pos").alias("_pos"), F.col("steps").alias("_more"), F.col("root").alias("_top"))
    names = staged(top.select(F.col("tree").alias("_name"), "pos").join(of_top, F.col("pos") == F.col("_pos")).drop("pos", "_pos"), "tops")
    whole = above.join(names, F.col("tree") == F.col("_name")).select("tree", "pos", F.concat("steps", "_more").alias("steps"), F.col("_top").alias("root"), F.col("root").alias("subroot"))

    def emit(r: Column, steps: Column, root: Column) -> Column:
        proof = F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)
        fold = F.aggregate(steps, F.coalesce(r["claimed"], r["node"]), lambda acc, s: digest(s["left"], acc, s["right"]))
        return F.struct(r["doc_id"].alias("doc_id"), r["node"].alias("leaf"), F.col("subroot"), root.alias("root"), proof.alias("proof_sha256"), fold.alias("folded_root"))

    return _down(blocks, emit, staged(whole, "above")).withColumn("verified", F.col("folded_root") == F.col("root"))


def every_fifth(doc_id: Column) -> Column:
    """Rows whose id's crc32 is divisible by 5."""
    return decimal_crc(doc_id) % 5 == 0


_BYTES = "list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda x: ord(x)::BIGINT)"
_BITS = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda p, q: xor(p >> 1, CASE WHEN p & 1 = 1 THEN 3988292384 ELSE 0 END))"


def crc_sql(column: str) -> str:
    """crc32 of an integer's decimal text, which DuckDB lacks, bit by bit."""
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {_BYTES.format(column)}), lambda a, b: {_BITS}), 4294967295)"


def _leaf_sql(text: str) -> str:
    shown = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(shown)})"


#: Levels are built by recursion; a tree's nodes rise together until one is left. ``s`` has each node's siblings.
_LEVELS_SQL = f"""{{0}} AS (
  SELECT tree, 0 AS lv, pos, node, n FROM {{1}} UNION ALL
  SELECT tree, lv + 1, pos // {FAN}, sha256(string_agg(node, '' ORDER BY pos)), (n + {FAN - 1}) // {FAN} FROM {{0}} WHERE n > 1 GROUP BY tree, lv, pos // {FAN}, n
), {{0}}_run AS (SELECT tree, lv, pos // {FAN} AS run, list(node ORDER BY pos) AS nodes FROM {{0}} WHERE n > 1 GROUP BY ALL)"""
_CLIMB_SQL = """SELECT w.key, w.tree, w.lv + 1, w.pos // 16, w.proof || array_to_string(r.nodes[1:w.pos % 16], '') || array_to_string(r.nodes[w.pos % 16 + 2:], ''),
    sha256(array_to_string(r.nodes[1:w.pos % 16], '') || w.fold || array_to_string(r.nodes[w.pos % 16 + 2:], '')) FROM {0} w JOIN {1}_run r ON r.tree = w.tree AND r.lv = w.lv AND r.run = w.pos // 16"""

MANIFEST_SQL = f"""
WITH RECURSIVE leaf AS (
  SELECT row_number() OVER () AS key, doc_id, coalesce(' ' || source, '') AS tree, {_leaf_sql("text")} AS node,
    CASE WHEN doc_id IS NOT NULL AND {crc_sql("doc_id")} % 5 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS claimed FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaf
), {_LEVELS_SQL.format("low", "placed")},
subroots AS (SELECT tree AS name, node AS subroot, '' AS tree, node, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
{_LEVELS_SQL.format("high", "subroots")},
rise(key, tree, lv, pos, proof, fold) AS (
  SELECT key, tree, 0, pos, '', coalesce(claimed, node) FROM placed UNION ALL
  {_CLIMB_SQL.format("rise", "low")}
), risen AS (SELECT key, tree, proof, fold FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY lv DESC) AS last FROM rise) WHERE last = 1),
rest(key, tree, lv, pos, proof, fold) AS (
  SELECT r.key, '', 0, s.pos, r.proof, r.fold FROM risen r JOIN subroots s ON s.name = r.tree UNION ALL
  {_CLIMB_SQL.format("rest", "high")}
), done AS (SELECT key, proof, fold FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY lv DESC) AS last FROM rest) WHERE last = 1),
top AS (SELECT node AS root FROM high WHERE n = 1)
SELECT p.doc_id, p.node AS leaf, s.subroot, top.root, sha256(d.proof) AS proof_sha256, d.fold AS folded_root, d.fold = top.root AS verified
FROM placed p JOIN done d ON d.key = p.key JOIN subroots s ON s.name = p.tree, top
"""
