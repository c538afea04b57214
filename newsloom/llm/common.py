"""What the operators share: staged tables, Arrow pass-through and folds by hash.

Staged tables are Parquet under the folder the cluster names in
``spark.checkpoint.dir``, which driver and executors share; they cut lineage,
so a lost executor costs one stage and not the whole plan.  Only a local master
may do without that setting (tests): it gets a temporary folder.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOCAL_ROOT: list[str] = []
_STAGED: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append(tempfile.mkdtemp(prefix="newsloom-"))
    return "file://" + _LOCAL_ROOT[0]


def staged_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/newsloom/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    spark = df.sparkSession
    path = staged_path(spark, name)
    _STAGED.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._newsloom_path = path  # type: ignore[attr-defined]
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table once everything made from it is written."""
    path = getattr(df, "_newsloom_path", None)
    if path:
        remove(df.sparkSession, path)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Delete the staged tables made inside, once what needs them is written."""
    first = len(_STAGED)
    yield
    for path in _STAGED[first:]:
        remove(spark, path)


def row_key_of(doc_id: Column, text: Column) -> Column:
    """A key of a row's id and text; equal rows, equal keys."""
    return F.xxhash64(doc_id.cast("long"), text.cast("string"))


def remove(spark: SparkSession, path: str) -> None:
    if path in _STAGED:
        _STAGED.remove(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound Arrow batches by rows, as one text may be long; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def with_columns(
    df: DataFrame,
    make: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, dict[str, pa.Array]]]],
    fields: T.StructType,
    keep: list[str],
) -> DataFrame:
    """``keep`` columns of ``df`` and new ones that ``make`` computes per Arrow batch.

    An input column whose name equals a new one gives way to it.
    """
    small_batches(df.sparkSession)
    kept = [c for c in keep if c not in fields.names]
    schema = T.StructType([df.schema[c] for c in kept] + list(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, new in make(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in kept] + [new[f.name] for f in fields],
                names=[*kept, *fields.names],
            )

    return df.mapInArrow(run, schema)


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores behind it as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def fold_of(column: Column, folds: int) -> Column:
    """crc32 of the value as text, modulo ``folds``; null counts as fold 0."""
    return F.coalesce(F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(folds)), F.lit(0))


def bounded_sample(df: DataFrame, key: list[str], most: int) -> DataFrame:
    """At most ``most`` rows of ``df``, one for each value of ``key``, by its hash.

    The number of rows sets a threshold on the hash, so that tasks pass on about four
    times as many rows as are wanted, together and not each.
    """
    total = df.count()
    rows = df.withColumn("_h", F.xxhash64(*key))
    if total > 4 * most:
        rows = rows.where(F.pmod("_h", F.lit(1 << 31)) < (1 << 31) * 4 * most // total)
    rest = [c for c in df.columns]
    once = rows.groupBy("_h").agg(F.min(F.struct(*rest)).alias("row")).orderBy(F.pmod("_h", F.lit(1 << 31)), "_h").limit(most)
    return once.select("row.*")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
