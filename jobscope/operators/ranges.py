"""Running sums over a whole table, without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobscope.sources.scratch import scratch_path


def prefix_sums(df: DataFrame, by: str, value: str, ranges: int | None = None) -> DataFrame:
    """by, total: for each distinct by, null left out, the sum of value over all rows with a by up to it.

    Rows are summed by by first and dealt into ranges of it (as many as shuffle partitions), which are written, so that they
    stay what they are. Each range is summed up in order on its own, and what the ranges before it hold is added: a table with one row a range.
    """
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sums = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.sum(value).alias("_sum"))
    path = scratch_path(spark, "ranges")
    sums.repartitionByRange(ranges, by).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_range").agg(F.sum("_sum").alias("_own")).select("_range", F.coalesce(F.sum("_own").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_range").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.withColumn("_upto", F.sum("_sum").over(within)).join(F.broadcast(offsets), "_range").select(by, (F.col("_upto") + F.col("_before")).alias("total"))
