"""Job histories folded to facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobscope.schema import IMAGE_EXTENSIONS, TERMINAL
from jobscope.sources.scratch import scratch_path


def fold(events: DataFrame) -> DataFrame:
    """One fact row for each accepted job, from its events in the order of seq.

    The first accepted event creates the row; the first terminal one after it ends it; the first start between the two is
    the start. Everything else, and jobs never accepted, are ignored.
    """
    job = Window.partitionBy("job_id")
    accepted = F.col("kind") == "accepted"
    terminal = (F.col("kind") == "terminal") & F.col("status").isin(*TERMINAL)
    e = events.withColumn("_a", F.min(F.when(accepted, F.col("seq"))).over(job)).where("seq >= _a")
    e = e.withColumn("_t", F.min(F.when(terminal, F.col("seq"))).over(job))
    first = F.min_by(F.struct("operation", "ts", "file_count", "input_bytes"), F.when(F.col("seq") == F.col("_a"), F.col("seq")))
    start = F.min_by("ts", F.when((F.col("kind") == "started") & ((F.col("seq") < F.col("_t")) | F.col("_t").isNull()), F.col("seq")))
    end = F.min_by(F.struct("ts", "status", "result_bytes", "error_code"), F.when(F.col("seq") == F.col("_t"), F.col("seq")))
    out = e.groupBy("job_id").agg(first.alias("a"), start.alias("started_at"), end.alias("t"))
    status = F.coalesce("t.status", F.when(F.col("started_at").isNotNull(), "running").otherwise("queued"))
    return out.select(
        "job_id", "a.operation", F.col("a.ts").alias("accepted_at"), "started_at", F.col("t.ts").alias("finished_at"), status.alias("status"),
        F.col("a.file_count").alias("file_count"), F.col("a.input_bytes").alias("input_bytes"), F.coalesce("t.result_bytes", F.lit(0)).cast("long").alias("result_bytes"), F.col("t.error_code").alias("error_code"),
    )


def status_fold(events: DataFrame) -> DataFrame:
    """job_id, status: the last word on a job's record. A cancellation stays whatever is written after it; cancelling a job that has ended removes its record."""
    job = Window.partitionBy("job_id")
    terminal = F.col("kind") == "terminal"
    e = events.where(terminal & F.col("status").isin(*TERMINAL))
    e = e.withColumn("_c", F.min(F.when(F.col("status") == "cancelled", F.col("seq"))).over(job)).withColumn("_first", F.min("seq").over(job))
    removed = F.max((F.col("_c") > F.col("_first")) & F.col("_c").isNotNull())
    last = F.max_by("status", F.when(F.col("_c").isNull() | (F.col("seq") <= F.col("_c")), F.col("seq")))
    return e.groupBy("job_id").agg(F.when(removed, "removed").otherwise(last).alias("status"))


def accept_new(facts: DataFrame, incoming: DataFrame) -> DataFrame:
    """Accepted rows to append: the first of each job that isn't in facts yet, as queued."""
    row = F.struct("operation", "ts", "file_count", "input_bytes")
    new = incoming.where("kind = 'accepted'").groupBy("job_id").agg(F.min_by(row, "seq").alias("row")).select("job_id", "row.*")
    new = new.join(facts.select("job_id"), "job_id", "left_anti")
    return new.select("job_id", "operation", F.col("ts").alias("accepted_at"), F.lit("queued").alias("status"), "file_count", "input_bytes", F.to_date("ts").alias("accepted_date"))


def append_rejections(rejections: DataFrame, path: str) -> None:
    """Appends all rejections, repeats included, to a table by date."""
    rejections.withColumn("occurred_date", F.to_date("occurred_at")).write.mode("append").partitionBy("occurred_date").parquet(path)


def job_rollup(files: DataFrame) -> DataFrame:
    """job_id, file_count, input_bytes; with columns ext, width and height also input_pixels, of the images whose size is known."""
    sums = [F.count("*").alias("file_count"), F.sum("size").cast("long").alias("input_bytes")]
    if {"ext", "width", "height"} <= set(files.columns):
        pixels = F.when(F.col("ext").isin(*IMAGE_EXTENSIONS), F.col("width").cast("long") * F.col("height"))
        sums.append(F.coalesce(F.sum(pixels), F.lit(0)).cast("long").alias("input_pixels"))
    return files.groupBy("job_id").agg(*sums)


def split_failures(attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Failed attempts as (terminal events of accepted jobs, rejections of the others)."""
    failed = attempts.where("error_code is not null")
    return (
        failed.where("accepted").select("job_id", F.lit("terminal").alias("kind"), F.lit("failed").alias("status"), "error_code"),
        failed.where("not accepted").select("operation", "file_count", "input_bytes", "error_code"),
    )


def prune(facts: DataFrame, column: str, cutoff: str) -> DataFrame:
    """Rows to keep: those at or after the cutoff."""
    return facts.where(F.col(column) >= F.lit(cutoff).cast("timestamp"))


def prune_table(spark: SparkSession, path: str, column: str, date: str, cutoff: str) -> None:
    """Prunes a table partitioned by date, the date of column: older partitions go whole, only the one with the cutoff is rewritten, later ones aren't read.

    What stays of that partition is written elsewhere first. Running it again changes nothing. Rows without a time stay.
    """
    at = F.lit(cutoff).cast("timestamp")
    table = spark.read.parquet(path)
    day = spark.range(1).select(F.to_date(at).cast("string")).first()[0]
    staged = scratch_path(spark, "pruned")
    prune(table.where(F.col(date) == F.lit(day).cast("date")), column, cutoff).write.parquet(staged)
    kept = spark.read.schema(table.schema).parquet(staged)
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    emptied = kept.isEmpty()
    for entry in fs.listStatus(root):
        name, _, value = entry.getPath().getName().partition("=")
        if name == date and value != "__HIVE_DEFAULT_PARTITION__" and (value < day or (value == day and emptied)):
            fs.delete(entry.getPath(), True)
