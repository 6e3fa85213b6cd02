"""Lifetimes: what is due for removal, who is alive, what is latest. Plans only; nothing is deleted here."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobscope.operators.ranges import prefix_sums
from jobscope.schema import BEAT_TTL, FREE_BYTES, RECORD_TTL, RESULT_TTL, TERMINAL, WORKERS


def expired(jobs: DataFrame, now: str, n: int = 100) -> DataFrame:
    """The n jobs longest past their expiry (job_id, expires_at), oldest first."""
    return jobs.where(F.col("expires_at").between(F.lit("1970-01-01").cast("timestamp"), F.lit(now).cast("timestamp"))).orderBy("expires_at", "job_id").limit(n)


def expired_records(jobs: DataFrame, records: DataFrame, now: str, n: int = 100) -> DataFrame:
    """expired() with the status of the record; a job without one is removed as well."""
    return expired(jobs, now, n).join(records, "job_id", "left")


def orphans(directories: DataFrame, records: DataFrame, now: str, ttl_s: int = RECORD_TTL) -> DataFrame:
    """Directories older than the limit whose record is missing or ended."""
    cutoff = F.lit(now).cast("timestamp") - F.expr(f"interval {ttl_s} seconds")
    old = directories.where(F.col("mtime") < cutoff).join(records, "job_id", "left")
    return old.where(F.col("status").isNull() | F.col("status").isin(*TERMINAL))


def removal_plan(facts: DataFrame, now: str) -> DataFrame:
    """job_id, kind: inputs of ended jobs at once, results and records when their time is over."""
    ended, at = F.col("status").isin(*TERMINAL), F.lit(now).cast("timestamp")
    due = F.array(
        F.when(ended, F.lit("inputs")),
        F.when(F.col("accepted_at") + F.expr(f"interval {RESULT_TTL} seconds") <= at, F.lit("result")),
        F.when(F.col("accepted_at") + F.expr(f"interval {RECORD_TTL} seconds") <= at, F.lit("record")),
    )
    return facts.select("job_id", F.explode(F.array_compact(due)).alias("kind"))


def prune_plan(facts: DataFrame, column: str, cutoff: str) -> DataFrame:
    """For each date whether its partition is dropped, rewritten (the cutoff lies in it) or kept, and how many rows go."""
    at = F.lit(cutoff).cast("timestamp")
    by = facts.groupBy(F.to_date(column).alias("date")).agg(F.count("*").alias("n_rows"), F.count_if(F.col(column) < at).alias("n_pruned"))
    return by.withColumn("action", F.when(F.col("n_pruned") == 0, "keep").when(F.col("n_pruned") == F.col("n_rows"), "drop").otherwise("rewrite"))


def workers(beats: DataFrame, now: str, ttl_s: int = BEAT_TTL) -> DataFrame:
    """worker_id, last_beat, alive: the last beat is less than ttl_s ago."""
    at = F.lit(now).cast("timestamp")
    last = beats.where(F.col("ts") <= at).groupBy("worker_id").agg(F.max("ts").alias("last_beat"))
    return last.withColumn("alive", F.unix_micros(at) - F.unix_micros("last_beat") < ttl_s * 1_000_000)


def status(alive: DataFrame, expected: int = WORKERS, store_ok: bool = True, scanner_ok: bool = True, free_bytes: int = FREE_BYTES + 1) -> DataFrame:
    n = alive.agg(F.count_if("alive").alias("workers"))
    ok = F.lit(store_ok) & F.lit(scanner_ok) & (F.col("workers") >= expected) & F.lit(free_bytes > FREE_BYTES)
    return n.select("workers", F.lit(expected).alias("expected"), F.lit(free_bytes).cast("long").alias("free_bytes"), F.when(ok, "ok").otherwise("degraded").alias("status"))


def snapshots(beats: DataFrame, probes: DataFrame, ttl_s: int = BEAT_TTL, expected: int = WORKERS) -> DataFrame:
    """probes (probe_id, ts, store_ok, scanner_ok, free_bytes) with workers, the number alive at that time, expected and status.

    Each stretch in which a worker is alive counts one up at its start and one down at its end. How many are alive at a time is
    the running sum of these up to it, over ranges of time (prefix_sums), so that no task gets all of them even if all fall
    on one day. A probe without a time, or with a null in what it saw, is degraded.
    """
    worker = Window.partitionBy("worker_id").orderBy("us")
    b = beats.select("worker_id", F.unix_micros("ts").alias("us")).where("worker_id is not null and us is not null")
    ttl = ttl_s * 1_000_000
    b = b.withColumn("_before", F.lag("us").over(worker)).withColumn("_after", F.lead("us").over(worker))
    up = F.when(F.col("_before").isNull() | (F.col("_before") + ttl <= F.col("us")), F.struct("us", F.lit(1).alias("delta")))
    down = F.when(F.col("_after").isNull() | (F.col("_after") >= F.col("us") + ttl), F.struct((F.col("us") + ttl).alias("us"), F.lit(-1).alias("delta")))
    steps = b.select(F.explode(F.array_compact(F.array(up, down))).alias("s")).select("s.us", "s.delta")
    seen = probes.select("probe_id", F.unix_micros("ts").alias("us"), "store_ok", "scanner_ok", "free_bytes")
    alive = prefix_sums(steps.union(seen.select("us", F.lit(0))), "us", "delta")
    workers = F.col("total")
    ok = F.col("store_ok") & F.col("scanner_ok") & (workers >= expected) & (F.col("free_bytes") > FREE_BYTES)
    return seen.join(alive, "us", "left").select("probe_id", workers.alias("workers"), F.lit(expected).alias("expected"), "free_bytes", F.when(ok, "ok").otherwise("degraded").alias("status"))


def latest(jobs: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by order; each task hands on one row a key."""
    rest = F.struct(*[c for c in jobs.columns if c not in keys])
    return jobs.groupBy(*keys).agg(F.max_by(rest, F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def first_files(files: DataFrame, n: int = 20) -> DataFrame:
    by = Window.partitionBy("job_id").orderBy("idx")
    return files.withColumn("ordinal", F.row_number().over(by)).where(F.col("ordinal") <= n)
