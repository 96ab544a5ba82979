"""Places in an order, without a window over a whole group or table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """Adds the place (from 1) of each row among those of the same ``by`` (null is a value).

    A range shuffle deals rows to tasks in order, so that a group of any size is spread over
    many. A row's number within its task less that of its group's first row there, plus the
    group's rows in earlier tasks, is its place: only counts a group and task are added up. The
    sorted rows are written first, since ranges are drawn from a sample."""
    kept = [c for c in df.columns if c != name]
    first = [F.col(c) for c in by]
    dealt = df.repartitionByRange(*first, *order).sortWithinPartitions(*first, *order) if by or order else df
    rows = stored(dealt.select(F.struct(*kept).alias("row"), F.struct(F.lit(0), *first).alias("grp"), F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("seq")), "ranked")
    counts = rows.groupBy("grp", "task").agg(F.count("*").alias("n"), F.min("seq").alias("head"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("grp").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = counts.select(F.col("grp").alias("_grp"), F.col("task").alias("_task"), (before - F.col("head") + 1).alias("_shift"))
    on = F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("task") == F.col("_task"))
    return rows.join(heads, on).select("row.*", (F.col("seq") + F.col("_shift")).alias(name))
