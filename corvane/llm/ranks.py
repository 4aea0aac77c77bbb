"""Row numbers within groups of any size, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import materialize


def ranked(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """`df` with `rank_`, from 0, in the order of `order` within each group.

    The rows are sorted by range, which splits a large group over tasks, and written
    once; a row's number is its place in its part plus what earlier parts hold of its
    group, of which there is one count for each part and group.
    """
    parts = df.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order)
    placed = materialize(parts.withColumn("part_", F.spark_partition_id()).withColumn("at_", F.monotonically_increasing_id()), name)
    counts = placed.groupBy(*groups, "part_").agg(F.count("*").alias("n_"), F.min("at_").alias("first_"))
    before = Window.partitionBy(*groups).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(g).alias(f"g{i}_") for i, g in enumerate(groups)], F.col("part_").alias("p_"), "first_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"))
    on = F.col("part_") == F.col("p_")
    for i, g in enumerate(groups):
        on &= F.col(g).eqNullSafe(F.col(f"g{i}_"))
    return placed.join(counts, on).select(*df.columns, (F.col("at_") - F.col("first_") + F.col("before_")).alias("rank_"))
