"""Running sums over a total order, without one task that sees it all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Adds ``before``, the sum of ``value`` over earlier rows of the same ``by``, and ``place`` (from 1).

    Rows are range-sorted by (``by``, ``order``) and written; sums of each part are added up
    over the parts of a group, and each part then counts on from there. A group of any size is
    so dealt out over all tasks. ``order`` must tell rows apart, but for those whose sums do not
    matter. Null values count as 0.
    """
    dealt = checkpoint(df.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()))
    amount = F.coalesce(F.col(value), F.lit(0)).cast("long")
    ahead = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    # One row for each part and group in it: parts and groups, not parts times groups.
    parts = dealt.groupBy(*by, "__part").agg(F.sum(amount).alias("__sum"), F.count(F.lit(1)).alias("__n"))
    parts = parts.select(
        *[F.col(c).alias(f"__{i}") for i, c in enumerate(by)],
        F.col("__part").alias("__p"),
        F.coalesce(F.sum("__sum").over(ahead), none).alias("__from"),
        F.coalesce(F.sum("__n").over(ahead), none).alias("__rows"),
    )
    same = F.col("__part") == F.col("__p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__{i}"))
    within = Window.partitionBy(*by, "__part").orderBy(*order)
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    found = dealt.withColumn("__sum", F.coalesce(F.sum(amount).over(earlier), none)).withColumn("__n", F.row_number().over(within))
    out = found.join(parts, same).select(
        *df.columns, (F.col("__from") + F.col("__sum")).alias("before"), (F.col("__rows") + F.col("__n")).alias("place")
    )
    return out
