"""The corpus pipeline: toxicity, near duplicates, benchmark leaks, personal data, packing.

Each stage works on all rows its predecessor kept and returns the columns of
``documents``; the last one returns the packed pieces.  Stages are written as
Parquet to the shared folder and read again, so a lost executor costs one stage.

Decisions are made on rows, by id and text: rows that share a doc_id, or have
none, are judged each by its own text.  Defined results: rows without text or
words are kept until they are packed as an end id alone; of a group of near
duplicates the row with the smallest doc_id stays (of several with that id, or
where all ids are null, the one with the smallest key of its text), and of equal
rows one; columns beyond those of ``documents`` are left out; empty tables give
empty stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import decontaminate, jaccard, packing, pii, toxicity
from newsloom.llm.common import fold_of, read, row_key_of, staged, staged_path, swept, unstage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model does not reject."""
    docs = docs.select(COLUMNS)
    labels = read(spark, sf_dir, "labels").where(fold_of(F.col("doc_id"), 5) != 0)
    model = toxicity.fit(toxicity.labelled_sample(docs, labels))
    return toxicity.rate(docs, model).where("predicted = 0").select(COLUMNS)


#: Bits of a sketch for each key in it, so that about one row in as many passes it for no reason.
SKETCH_BITS = 32


def _marked(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` with ``row_key`` and ``_maybe``: false where a row is surely not among ``rows`` (doc_id, row_key).

    A bitmap of the keys is held against each row where it lies.  What it lets through
    is hardly more than those rows, so only their texts need be shuffled to be compared.
    """
    bits = F.lit(SKETCH_BITS * max(1, rows.count()))
    place = F.pmod("row_key", bits)
    bucket, bit = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    sketch = rows.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(bit).alias("_bitmap"))
    byte = F.conv(F.hex(F.substring("_bitmap", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    keyed = docs.withColumn("row_key", row_key_of(F.col("doc_id"), F.col("text"))).withColumn("_bucket", bucket).join(F.broadcast(sketch), "_bucket", "left")
    return keyed.select(*COLUMNS, "row_key", F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False)).alias("_maybe"))


def _meeting(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """The rows of ``docs`` whose id and text are among ``rows`` (doc_id, row_key), or with ``left_anti`` those which aren't."""
    other = rows.select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"))
    return docs.join(other, (F.col("row_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), how)


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` without those whose id and text are among ``rows`` (doc_id, row_key)."""
    marked = _marked(docs, rows)
    return marked.where("not _maybe").select(COLUMNS).unionByName(_meeting(marked.where("_maybe"), rows, "left_anti").select(COLUMNS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates."""
    docs = docs.select(COLUMNS)
    member = staged(jaccard.cluster(docs, rows=True).where("group_key is not null"), "members")
    first = member.groupBy("group_key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select("group_key", F.col("first.doc_id").alias("first_id"), F.col("first.row_key").alias("first_key"))
    of_group = member.join(first, "group_key")
    stays = (F.col("row_key") == F.col("first_key")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    gone = staged(of_group.where(~stays).select("doc_id", "row_key").distinct(), "duplicates")
    again = staged(of_group.where(stays).groupBy("doc_id", "row_key").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "row_key"), "repeated")
    kept = _without(docs, gone)
    if again.isEmpty():
        return kept
    once = _meeting(_marked(kept, again).where("_maybe"), again, "left_semi").groupBy("doc_id", "row_key").agg(F.min(F.struct(*[c for c in COLUMNS if c != "doc_id"])).alias("row"))
    once = once.select("doc_id", "row.*").select(COLUMNS)
    return _without(kept, again).unionByName(once)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage that repeats a benchmark item."""
    docs = docs.select(COLUMNS)
    found = decontaminate.contaminated(docs, read(spark, sf_dir, "benchmark"), rows=True)
    return _without(docs, staged(found.select("doc_id", "row_key").distinct(), "leaks"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced by its kind."""
    clean = pii.redact(docs.select(COLUMNS)).withColumn("text", F.col("redacted"))
    return clean.withColumn("n_chars", F.when(F.col("n_redacted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: The fitted, iterative and packing stages have no SQL; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents").select(COLUMNS)
    for name, stage in STAGES[:-1]:
        path = staged_path(spark, name)
        with swept(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        docs._newsloom_path = path
        unstage(before)
    out = STAGES[-1][1](spark, docs, sf_dir)
    unstage(docs)  # the packing has read it
    return out
