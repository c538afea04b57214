"""Places and running sums in groups of any size, without one task for a group.

Rows are sorted by ranges, so that a group with most of the rows lies in many
partitions.  What a partition adds to a group is one row of a side table, from
which the places of its rows follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Rows of a run that one task sums up by itself.
RUN = 4096


def sorted_rows(df: DataFrame, *order: str, name: str = "sorted") -> DataFrame:
    """``df`` sorted by ranges of ``order`` and written, with ``_at``, which grows in that order, by one within a partition.

    Rows that are equal in ``order`` are told apart by where they were read, so that they spread too.
    """
    keys = [*order, "_tie"]
    rows = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return staged(rows.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), name)


def placed(rows: DataFrame, group: str) -> DataFrame:
    """Adds ``pos``, the place from 0 of each of :func:`sorted_rows` in its group, and ``n``, the group's rows; ``group`` has no nulls."""
    part = F.shiftright("_at", 33)
    parts = rows.groupBy(F.col(group).alias("_g"), part.alias("_p")).agg(F.min("_at").alias("_first"), F.count("*").alias("_c"))
    earlier = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"_before": F.coalesce(F.sum("_c").over(earlier), F.lit(0)), "n": F.sum("_c").over(Window.partitionBy("_g"))})
    near = rows.withColumn("_q", part).join(parts, (F.col(group) == F.col("_g")) & (F.col("_q") == F.col("_p")))
    return near.withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first")).drop("_g", "_p", "_q", "_c", "_first", "_before", "_at")


def running_sums(rows: DataFrame, group: str, pos: str, values: list[str], run: int = RUN) -> DataFrame:
    """Each of ``values`` becomes its sum over the group's rows up to this one, by ``pos`` (whole numbers, each once).

    A group is summed in runs of ``run`` places; sums of earlier runs are added. ``rows`` is read twice: stage it.
    """
    block = F.floor(F.col(pos) / run)
    totals = rows.groupBy(F.col(group).alias("_g"), block.alias("_b")).agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    earlier = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_g", "_b", *[F.sum(f"_t_{v}").over(earlier).alias(f"_t_{v}") for v in values]).where(F.col(f"_t_{values[0]}").isNotNull())
    so_far = Window.partitionBy(group, "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumn("_block", block).withColumns({v: F.sum(v).over(so_far) for v in values})
    out = inside.join(before, (F.col(group) == F.col("_g")) & (F.col("_block") == F.col("_b")), "left")
    return out.withColumns({v: F.col(v) + F.coalesce(F.col(f"_t_{v}"), F.lit(0)) for v in values}).select(*rows.columns)


def decimal_crc(value: Column) -> Column:
    """Unsigned crc32 of a whole number's decimal text."""
    return F.crc32(value.cast("string").cast("binary"))
