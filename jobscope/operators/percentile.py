"""Lower-rank percentiles: the sorted value at index floor((n - 1) p), without interpolation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from jobscope.sources.scratch import scratch_path


#: Bits that each level of the search leaves below its buckets: 65,536 buckets a level for values up to 2**48.
LEVELS = (32, 16, 0)
#: Distinct values of all groups that are few enough to be ranked by one window each.
WINDOW_ROWS = 1_000_000


def lower_rank(df: DataFrame, keys: list[str], value: str, shares: list[float], window_rows: int = WINDOW_ROWS, weight: str | None = None) -> DataFrame:
    """keys, n, total and p<share> of the non-null whole values of each group; groups without values give no row. With weight a row stands for that many.

    Values are collapsed to counts first, which are written and counted. Up to window_rows of them are ranked by a window
    over each group. Beyond that, level by level, the bucket of high bits is found in which a rank lies, and only that one
    is looked into further, so no task ever sorts all values of a group, even if there is only one group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_x")).agg((F.sum(weight) if weight else F.count("*")).alias("_c"))
    path = scratch_path(df.sparkSession, "counts")
    counts.write.parquet(path)
    counts = df.sparkSession.read.schema(counts.schema).parquet(path)
    few = counts.count() <= window_rows
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("n"), F.sum(F.col("_x") * F.col("_c")).alias("total"))
    ranks = F.array(*[F.struct(F.lit(k).alias("_p"), F.floor((F.col("n") - 1) * F.lit(float(p))).alias("_at")) for k, p in enumerate(shares)])
    found = _by_window(counts, totals, keys, ranks) if few else _by_levels(counts, totals, keys, ranks)
    picks = [F.max(F.when(F.col("_p") == k, F.col("_x"))).alias(f"p{round(p * 100)}") for k, p in enumerate(shares)]
    return found.groupBy(*keys).agg(F.max("n").alias("n"), F.max("total").alias("total"), *picks)


def _over(keys: list[str]):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))


def _by_window(counts: DataFrame, totals: DataFrame, keys: list[str], ranks) -> DataFrame:
    by = _over(keys)
    upto = by.orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("_end", F.sum("_c").over(upto)).withColumn("n", F.sum("_c").over(by)).withColumn("total", F.sum(F.col("_x") * F.col("_c")).over(by))
    out = ranked.withColumn("_r", F.explode(ranks)).select(*keys, "n", "total", "_x", "_c", "_end", "_r._p", "_r._at")
    return out.where((F.col("_end") > F.col("_at")) & (F.col("_end") - F.col("_c") <= F.col("_at")))


def _by_levels(counts: DataFrame, totals: DataFrame, keys: list[str], ranks) -> DataFrame:
    open_ = totals.withColumn("_r", F.explode(ranks)).select(*keys, "n", "total", "_r._p", "_r._at", F.lit(0).cast("long").alias("_high"))
    same, before = [F.col(f"c.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys], None
    for shift in LEVELS:
        part = F.shiftright("c._x", before) if before is not None else F.lit(0).cast("long")
        inside = counts.alias("c").join(open_.alias("o"), [*same, part == F.col("o._high")])
        sums = inside.groupBy(*[F.col(f"o.{k}").alias(k) for k in keys], "n", "total", "_p", "_at", F.shiftright("c._x", shift).alias("_high")).agg(F.sum("_c").alias("_n"))
        end = F.sum("_n").over(_over([*keys, "_p"]).orderBy("_high").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        at = sums.withColumn("_end", end).where((F.col("_end") > F.col("_at")) & (F.col("_end") - F.col("_n") <= F.col("_at")))
        open_ = at.select(*keys, "n", "total", "_p", (F.col("_at") - (F.col("_end") - F.col("_n"))).alias("_at"), "_high")
        before = shift
    return open_.withColumnRenamed("_high", "_x")


@F.pandas_udf(DoubleType())
def lower_rank_95(values: pd.Series) -> float:
    """The same for p = 0.95 as an aggregate over small groups."""
    x = values.dropna().sort_values()
    return float(x.iloc[int((len(x) - 1) * 0.95)]) if len(x) else float("nan")
