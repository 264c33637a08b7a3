"""Positions within groups without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task orders, on average.
PART_ROWS = 50_000


def rank_within(df: DataFrame, group: str, order: str, total: int, out: str = "rank", part_rows: int = PART_ROWS) -> DataFrame:
    """``df`` with a 0-based position ``out`` in each ``group``, without gaps; ``order`` must be unique and not NULL.

    Each group is cut into parts by a hash of ``order``. Only the parts are ordered, by window; their sizes, one row for
    each group and part, are summed up to offsets. With ``total`` rows no task has more than about ``part_rows``, even if
    all rows are in one group. The sequence runs through the parts, not along ``order``; it is the same in every run. The
    number of groups must be small: the offsets of a group are worked out in one task.
    """
    parts = max(1, -(-total // part_rows))
    split = df.withColumn("_part", F.pmod(F.xxhash64(F.col(order)), F.lit(parts)).cast("int"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = split.groupBy(group, "_part").agg(F.count("*").alias("_n")).withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(group, "_part").orderBy(order)) - 1
    return split.withColumn("_in", inside).join(offsets, [group, "_part"]).withColumn(out, (F.col("_in") + F.col("_offset")).cast("bigint")).drop("_part", "_in", "_offset")
