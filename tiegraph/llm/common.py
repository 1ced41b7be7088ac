"""Plumbing shared by the text operators: shared folders, batch sizes, distributed running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tiegraph.plans.lineage import drop_folder, fresh_path, materialize, shared_dir, stash

__all__ = ["drop_folder", "fresh_path", "materialize", "running_start", "shared_dir", "small_batches", "stash", "text_of"]


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Arrow batches small enough for very long texts; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def text_of(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column], F.lit(""))


def running_start(df: DataFrame, order: list[str], value: str, start: str = "start", group: list[str] | None = None) -> DataFrame:
    """Add ``start``: the sum of ``value`` over all rows before, by ``order`` (which must be a total order), per ``group``.

    The rows are range-partitioned once and written, so that the number of a part is fixed; sums of parts give
    offsets (one row per part and group), a window inside each part gives the rest. No task sees more than a part.
    """
    group = group or []
    parts = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    sums = parts.groupBy(*group, "_part").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*group, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = parts.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    right = offsets.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_part").alias("_part2"), "_offset")
    on = F.col("_part") == F.col("_part2")
    for i, c in enumerate(group):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    out = local.join(right, on, "left").withColumn(start, (F.col("_local") + F.col("_offset")).cast("long"))
    return out.drop("_part", "_part2", "_local", "_offset", *[f"_g{i}" for i in range(len(group))])
