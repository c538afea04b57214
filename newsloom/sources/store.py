"""Tables of the engine on Parquet: appends and versioned snapshots instead of row updates.

A snapshot is written beside the old one and named by a growing version, so a
reader sees a whole version and a lost executor leaves the old one intact.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.recall import latest_vectors
from ..operators.vocab import STATUS_ORDER, export_document, in_count_order, in_status_order, status_counts
from ..schema import DISCOVERY_CANDIDATE, DISCOVERY_RUN, EMBEDDING, PROMOTED
from ..vocabulary import Lexicon
from .commits import CommitLog
from .feeds import table_or_empty, with_defaults


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; only a local master may do without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="newsloom-")
    return f"{root.rstrip('/')}/newsloom/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so that what is lost is made anew from there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Folders by key that a commit of vectors is cut into. Fixed for a store's life.
BUCKETS = 64
VECTOR_KEY = ["item_id", "item_hash", "model"]
STORED = f"{EMBEDDING}, bucket int"


def bucket_of(buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*VECTOR_KEY), F.lit(buckets)).cast("int")


def upsert_vectors(new: DataFrame, path: str) -> int:
    """A commit of vectors by (item, hash, model); readers see them instead of older ones. Of rows with one key, one is stored.

    Nothing that is stored is read or moved.
    """
    log = CommitLog(new.sparkSession, path)
    number = log.claim()
    rows = latest_vectors(new.withColumn("seq", F.lit(number).cast("long"))).withColumn("seq", F.lit(number).cast("long"))
    _write_bucketed(rows, log.folder(number))
    log.publish(number)
    return number


def _write_bucketed(rows: DataFrame, folder: str) -> None:
    names = [c.split()[0] for c in EMBEDDING.split(", ")]
    rows.select(*names, bucket_of().alias("bucket")).repartition("bucket").write.partitionBy("bucket").parquet(folder)


def _stored(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame:
    """Rows of all commits that count; of ``buckets`` alone, the folders of others are not opened."""
    log = CommitLog(spark, path)
    folders = log.folders()
    if not folders:
        return spark.createDataFrame([], STORED)
    rows = spark.read.schema(STORED).option("basePath", path).parquet(*folders)
    return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))


def vectors(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame:
    """The newest vector of each key."""
    return latest_vectors(_stored(spark, path, buckets))


def pending_vectors(items: DataFrame, path: str) -> DataFrame:
    """Items (item_id, item_hash, model, ...) without a stored vector; only buckets that their keys fall into are read."""
    keyed = items.withColumn("_bucket", bucket_of())
    touched = [r["_bucket"] for r in keyed.select("_bucket").distinct().collect()]  # at most BUCKETS
    known = _stored(items.sparkSession, path, touched).select(*VECTOR_KEY).distinct()
    return keyed.drop("_bucket").join(known, VECTOR_KEY, "left_anti")


def compact_vectors(spark: SparkSession, path: str) -> int | None:
    """One commit in place of all there are, with the newest vector of each key; commits that come meanwhile stay."""
    log = CommitLog(spark, path)
    old = log.committed()
    if len(old) < 2:
        return None
    rows = spark.read.schema(STORED).option("basePath", path).parquet(*[log.folder(n) for n in old])
    number = log.claim()
    _write_bucketed(latest_vectors(rows, keep_seq=True), log.folder(number))
    log.publish(number, old)
    return number


RUN_SETTINGS = ("latest_limit", "trending_limit", "batch_size", "min_mentions", "min_docs", "doc_count")


def append_run(candidates: DataFrame, root: str, model: str, doc_count: int, **settings: int) -> int:
    """A discovery run with its settings and candidates; returns its id.

    The id is a claimed commit, so two writers never have the same; the run and
    its candidates are seen together, once both are written.
    """
    spark, log = candidates.sparkSession, CommitLog(candidates.sparkSession, root)
    run_id = log.claim()
    number = F.lit(run_id).cast("long").alias("run_id")
    rows = candidates.select(number, "category", "canonical_name", "mention_count", "doc_count", "aliases", "evidence_titles", "source_names")
    rows.write.parquet(f"{log.folder(run_id)}/candidates")
    counted = spark.read.parquet(f"{log.folder(run_id)}/candidates").count()
    values = {**{k: settings.get(k) for k in RUN_SETTINGS}, "doc_count": doc_count, "candidate_count": counted}
    row = [number, F.current_timestamp().alias("created_at"), F.lit(model).alias("model"), *[F.lit(v).cast("long").alias(k) for k, v in values.items()]]
    spark.range(1).select(*row).coalesce(1).write.parquet(f"{log.folder(run_id)}/run")
    log.publish(run_id)
    return run_id


def run_candidates(spark: SparkSession, root: str) -> DataFrame:
    return _of_runs(spark, root, "candidates", DISCOVERY_CANDIDATE)


def runs(spark: SparkSession, root: str) -> DataFrame:
    return _of_runs(spark, root, "run", DISCOVERY_RUN)


def _of_runs(spark: SparkSession, root: str, part: str, schema: str) -> DataFrame:
    folders = [f"{f}/{part}" for f in CommitLog(spark, root).folders()]
    return with_defaults(spark.read.option("mergeSchema", "true").parquet(*folders), schema) if folders else spark.createDataFrame([], schema)


def _versions(spark: SparkSession, root: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath() for s in fs.listStatus(path)]
    done = [p.getName() for p in names if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n[2:]) for n in done if n.startswith("v=") and n[2:].isdigit())


def write_snapshot(rows: DataFrame, root: str) -> int:
    version = (_versions(rows.sparkSession, root) or [0])[-1] + 1
    rows.write.parquet(f"{root}/v={version}")
    return version


def snapshot(spark: SparkSession, root: str, schema: str = PROMOTED) -> DataFrame:
    found = _versions(spark, root)
    return table_or_empty(spark, f"{root}/v={found[-1]}" if found else f"{root}/v=0", schema)


def upsert_promoted(new: DataFrame, root: str) -> int:
    """New rows replace those with the same (category, name); the others stay."""
    old = snapshot(new.sparkSession, root)
    return write_snapshot(new.unionByName(old.join(new.select("category", "canonical_name"), ["category", "canonical_name"], "left_anti")), root)


def export_vocabulary(promoted: DataFrame, path: str) -> None:
    export_document(promoted).coalesce(1).write.mode("overwrite").text(path)


def report(df: DataFrame) -> str:
    """A one-row summary as JSON text."""
    return df.limit(1).toJSON().first() or "{}"


def discovery_report(meta: dict, candidates: DataFrame, debug: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row ``value``: the run's settings and candidates as a JSON object, with debug tables if given."""
    parts = {"meta": _object(candidates.sparkSession, meta), "candidates": _listed(in_count_order(candidates))}
    if debug:
        parts["debug"] = _nested({k: _listed(v) for k, v in debug.items()})
    return _nested(parts)


def promotion_report(meta: dict, promoted: DataFrame) -> DataFrame:
    """One row ``value``: settings, counts by status, and the snapshot in its order as a JSON object."""
    counts = {r["status"]: r["n"] for r in status_counts(promoted).collect()}
    meta = {**meta, **{f"{s}_count": counts.get(s, 0) for s in STATUS_ORDER}}
    return _nested({"meta": _object(promoted.sparkSession, meta), "promoted_candidates": _listed(in_status_order(promoted))})


def _object(spark: SparkSession, values: dict) -> DataFrame:
    return spark.range(1).select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in values.items()])).alias("value"))


def _listed(ordered: DataFrame) -> DataFrame:
    """One row ``value``: the rows, in their order, as a JSON array. Reports are of vocabularies, which fit a row."""
    rows = ordered.select(F.monotonically_increasing_id().alias("o"), F.struct(*ordered.columns).alias("r"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("o", F.to_json("r").alias("j")))), lambda x: x["j"])
    return rows.agg(F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")).alias("value"))


def _nested(parts: dict[str, DataFrame]) -> DataFrame:
    """One row ``value``: a JSON object of one-row JSON values."""
    out = None
    for name, df in parts.items():
        one = df.select(F.concat(F.lit(f'"{name}":'), "value").alias(f"v_{name}"))
        out = one if out is None else out.crossJoin(one)
    return out.select(F.concat(F.lit("{"), F.concat_ws(",", *out.columns), F.lit("}")).alias("value"))


def vocabulary_rows(lexicon: Lexicon, promoted: DataFrame | None, spark: SparkSession) -> DataFrame:
    """(category, canonical_name, aliases, status): the built-in vocabulary, and the promoted entries that are active or cooling."""
    kinds = {"project": lexicon.projects, "token": lexicon.tokens, "topic": lexicon.topics}
    built_in = [(c, name, list(aliases), "builtin") for c, names in kinds.items() for name, aliases in names.items()]
    rows = spark.createDataFrame(built_in, "category string, canonical_name string, aliases array<string>, status string")
    if promoted is None:
        return rows
    return rows.unionByName(promoted.where(F.col("status").isin("active", "cooling")).select(*rows.columns))
