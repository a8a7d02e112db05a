"""Windows over groups of any size: rows lie in ranges of (group, order), and ranges meet only in their last rows and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanmill.plans.scratch import save


def in_ranges(df: DataFrame, by: str, order: list[str], ranges: int | None = None) -> DataFrame:
    """The rows, written in ranges of (by, order), with the number of each one's range as ``range_``; the order should have no ties."""
    keys = [F.col(c) for c in (by, *order)]
    dealt = df.repartitionByRange(ranges, *keys) if ranges else df.repartitionByRange(*keys)
    return save(dealt.withColumn("range_", F.spark_partition_id()), "ranges")


def with_before(rows: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """Rows of ``in_ranges`` and, with ``carried_`` true, the n rows before each range of a group (all, if fewer).

    Those are among the last n rows of the group's earlier ranges, so a group's window sees n rows a range at most.
    """
    asc, desc = [F.col(c).asc_nulls_first() for c in order], [F.col(c).desc_nulls_last() for c in order]
    lasts = rows.withColumn("nth_", F.row_number().over(Window.partitionBy(by, "range_").orderBy(*desc))).where(F.col("nth_") <= n)
    lasts = lasts.withColumn("nth_", F.row_number().over(Window.partitionBy(by).orderBy("range_", *asc)))
    firsts = lasts.groupBy(F.col(by).alias("of_"), F.col("range_").alias("to_")).agg(F.min("nth_").alias("first_"))
    wanted = firsts.where("first_ > 1").select("of_", "to_", F.explode(F.sequence(F.greatest(F.col("first_") - n, F.lit(1)), F.col("first_") - 1)).alias("want_"))
    carried = lasts.join(wanted, F.col(by).eqNullSafe(F.col("of_")) & (F.col("nth_") == F.col("want_"))).withColumn("range_", F.col("to_"))
    return rows.withColumn("carried_", F.lit(False)).unionByName(carried.select(*rows.columns, F.lit(True).alias("carried_")))


def tiles(rows: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """Rows of ``in_ranges`` with ``tile``: which of n parts of their group, as equal as can be, the larger ones first."""
    sizes = rows.groupBy(F.col(by).alias("of_"), F.col("range_").alias("to_")).agg(F.count(F.lit(1)).alias("size_"))
    group = Window.partitionBy("of_")
    sizes = sizes.withColumns({"before_": F.sum("size_").over(group.orderBy("to_")) - F.col("size_"), "all_": F.sum("size_").over(group)})
    nth = F.row_number().over(Window.partitionBy(by, "range_").orderBy(*(F.col(c).asc_nulls_first() for c in order)))
    both = rows.withColumn("nth_", nth).join(sizes, F.col(by).eqNullSafe(F.col("of_")) & (F.col("range_") == F.col("to_")))
    tile = F.expr(f"""CASE WHEN before_ + nth_ <= (all_ % {n}) * (all_ div {n} + 1) THEN (before_ + nth_ - 1) div (all_ div {n} + 1) + 1
                      ELSE (before_ + nth_ - 1 - (all_ % {n}) * (all_ div {n} + 1)) div (all_ div {n}) + all_ % {n} + 1 END""")
    return both.select(*rows.columns, tile.cast("int").alias("tile"))
