"""Report and lifecycle queries over the supplied tables, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.functions.scalars import expires, floor_bucket, hmac_sha256, iso
from jobscope.operators import lifecycle, percentile, report, retention
from jobscope.sources import adapters as a
from jobscope.sources.scratch import scratch_path

FROM, TO, TO_HOURLY = "1995-01-01", "1995-12-31", "1995-01-31"
DAY = (FROM, TO, "day")
M = report.MEASURES


def _c(spark: SparkSession, d: str, to: str = TO, bucket: str = "day") -> DataFrame:
    return report.contributions(a.jobs(spark, d), a.rejections(spark, d), FROM, to, bucket)


def _sql(body: str, to: str = TO, bucket: str = "day") -> str:
    """body over c: the contributions."""
    def within(x: str) -> str:
        return f"{x} >= timestamp '{FROM}' and {x} < timestamp '{to}' + interval 1 day"

    return f"""with {a.JOBS_SQL}, {a.REJECTIONS_SQL},
c as (
  select operation, date_trunc('{bucket}', accepted_at) bucket, 1 accepted, 0 succeeded, 0 failed, 0 cancelled, 0 rejected, file_count files_accepted, input_bytes, 0 result_bytes, null::bigint queue_us, null::bigint processing_us, null error_code
  from jobs where {within('accepted_at')}
  union all
  select operation, date_trunc('{bucket}', finished_at), 0, (status = 'succeeded')::int, (status = 'failed')::int, (status = 'cancelled')::int, 0, 0, 0, result_bytes,
    case when started_at is not null then greatest(0, epoch_us(started_at) - epoch_us(accepted_at)) end, case when started_at is not null then greatest(0, epoch_us(finished_at) - epoch_us(started_at)) end, error_code
  from jobs where finished_at is not null and {within('finished_at')}
  union all
  select operation, date_trunc('{bucket}', occurred_at), 0, 0, 0, 0, 1, 0, 0, 0, null, null, error_code from rejections where {within('occurred_at')}),
b as (select unnest(generate_series(timestamp '{FROM}', timestamp '{to}' + interval 1 day - interval 1 {bucket}, interval 1 {bucket})) bucket)
{body}"""


_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%SZ')"
_SUMS = ", ".join(f"coalesce(sum({m}), 0)::bigint {m}" for m in M)
_START = f"{_ISO.format('bucket')} start"
_PERCENTILE = """v as (select operation, 'queue' measure, queue_us x from c where queue_us is not null union all select operation, 'processing', processing_us from c where processing_us is not null),
r as (select {keys} measure, x, row_number() over (partition by {keys} measure order by x) - 1 i, count(*) over (partition by {keys} measure) n, sum(x) over (partition by {keys} measure) t from v)
select {keys} measure, max(n)::bigint count, max(t)::double / max(n)::double / 1e6 average, max(case when i = floor((n - 1) * 0.5::double) then x end) / 1e6 p50, max(case when i = floor((n - 1) * 0.95::double) then x end) / 1e6 p95
from r group by {keys} measure"""


def report_timing(spark: SparkSession, d: str) -> DataFrame:
    return report.timing(_c(spark, d), ["operation"])


def report_timing_total(spark: SparkSession, d: str) -> DataFrame:
    return report.timing(_c(spark, d), [])


def report_timing_pandas(spark: SparkSession, d: str) -> DataFrame:
    c = _c(spark, d).where("queue_us is not null")
    return c.groupBy("operation").agg((percentile.lower_rank_95(F.col("queue_us").cast("double")) / 1e6).alias("p95"))


def report_contributions(spark: SparkSession, d: str) -> DataFrame:
    return _c(spark, d).select(iso(F.col("bucket")).alias("start"), "operation", *M, "queue_us", "processing_us", "error_code")


def report_operation_maps(spark: SparkSession, d: str) -> DataFrame:
    out = report.operation_maps(_c(spark, d), *DAY)
    flat = F.transform(F.map_entries("operations"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["accepted"].cast("string"), F.lit("/"), e["value"]["rejected"].cast("string")))
    return out.select("start", F.array_join(flat, ";").alias("operations"))


def report_period_facts(spark: SparkSession, d: str) -> DataFrame:
    j = report.period_facts(a.jobs(spark, d), FROM, "1995-03-31")
    return j.select("job_id", "operation", iso(F.col("accepted_at")).alias("accepted_at"), iso(F.col("finished_at")).alias("finished_at"), "status", "result_bytes")


def report_period_rejections(spark: SparkSession, d: str) -> DataFrame:
    r = report.period_rejections(a.rejections(spark, d), FROM, "1995-01-10")
    return r.select(F.unix_micros("occurred_at").alias("occurred_us"), "operation", "input_bytes", "error_code")


def report_documents(spark: SparkSession, d: str) -> DataFrame:
    return report.document(a.jobs(spark, d), a.rejections(spark, d), *DAY)


def report_requests(spark: SparkSession, d: str) -> DataFrame:
    e = a.table(spark, d, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    asked = e.select(
        "event_id", F.when(F.col("event_id") % 7 == 0, "not a date").when(F.col("event_id") % 5 != 0, F.date_format(F.date_sub("ts", (F.col("event_id") % 400).cast("int")), "yyyy-MM-dd")).alias("from_text"),
        F.when(F.col("event_id") % 3 != 0, day).alias("to_text"), F.element_at(F.array(F.lit("hour"), F.lit("day"), F.lit("week")), (F.col("event_id") % 3 + 1).cast("int")).alias("bucket"),
    )
    return report.period_columns(asked, "2024-02-01").select("event_id", F.col("from_date").cast("string").alias("from_date"), F.col("to_date").cast("string").alias("to_date"), "valid")


def bucket_floor(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return a.table(spark, d, "events").select("event_id", iso(floor_bucket(ts, "hour")).alias("hour"), iso(floor_bucket(ts, "day")).alias("day"), iso(ts).alias("at"), iso(expires(ts)).alias("expires_at"))


def job_durations(spark: SparkSession, d: str) -> DataFrame:
    return report.durations(a.jobs(spark, d)).select("job_id", "queue_us", "processing_us")


def lifecycle_fold(spark: SparkSession, d: str) -> DataFrame:
    f = lifecycle.fold(a.lifecycle_events(spark, d))
    return f.select("job_id", "operation", iso(F.col("accepted_at")).alias("accepted_at"), iso(F.col("started_at")).alias("started_at"), iso(F.col("finished_at")).alias("finished_at"), "status", "file_count", "result_bytes", "error_code")


FOLD_SQL = f"""with {a.EVENTS_SQL},
s as (select *, min(case when kind = 'accepted' then seq end) over (partition by job_id) sa from lifecycle_events),
e as (select *, min(case when kind = 'terminal' then seq end) over (partition by job_id) st from s where seq >= sa),
g as (
  select job_id, max(case when seq = sa then operation end) operation, max(case when seq = sa then ts end) accepted_at, max(case when seq = sa then file_count end) file_count,
    arg_min(ts, seq) filter (where kind = 'started' and (st is null or seq < st)) started_at, max(case when seq = st then ts end) finished_at, max(case when seq = st then status end) status,
    max(case when seq = st then result_bytes end) result_bytes, max(case when seq = st then error_code end) error_code
  from e group by job_id)
select job_id, operation, {_ISO.format('accepted_at')} accepted_at, {_ISO.format('started_at')} started_at, {_ISO.format('finished_at')} finished_at,
  coalesce(status, case when started_at is not null then 'running' else 'queued' end) status, file_count, coalesce(result_bytes, 0)::bigint result_bytes, error_code
from g"""


def record_status_fold(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.status_fold(a.lifecycle_events(spark, d))


STATUS_SQL = f"""with {a.EVENTS_SQL},
e as (
  select *, min(case when status = 'cancelled' then seq end) over (partition by job_id) c, min(seq) over (partition by job_id) f
  from lifecycle_events where kind = 'terminal' and status in ('succeeded', 'failed', 'cancelled'))
select job_id, case when max(c) > max(f) then 'removed' else arg_max(status, seq) filter (where c is null or seq <= c) end status from e group by job_id"""


def accept_new(spark: SparkSession, d: str) -> DataFrame:
    known = a.jobs(spark, d).where(F.col("job_id").cast("long") % 3 == 0)
    out = lifecycle.accept_new(known, a.lifecycle_events(spark, d))
    return out.select("job_id", "operation", iso(F.col("accepted_at")).alias("accepted_at"), "status", "file_count", F.col("accepted_date").cast("string").alias("accepted_date"))


ACCEPT_SQL = f"""with {a.EVENTS_SQL}
select job_id, operation, {_ISO.format('ts')} accepted_at, 'queued' status, file_count, strftime(ts, '%Y-%m-%d') accepted_date
from (select *, row_number() over (partition by job_id order by seq) n from lifecycle_events where kind = 'accepted') where n = 1 and job_id::bigint % 3 <> 0"""


def append_rejections(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "rejections")
    r = a.rejections(spark, d)
    lifecycle.append_rejections(r, path)
    lifecycle.append_rejections(r, path)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("occurred_date").cast("string").alias("occurred_date")).agg(F.count("*").alias("n"), F.sum("input_bytes").alias("input_bytes"))


def terminal_events(spark: SparkSession, d: str) -> DataFrame:
    e = a.lifecycle_events(spark, d).where(F.col("kind") == "terminal")
    return e.where(F.col("status").isin(*report.TERMINAL)).groupBy("status").agg(F.count("*").alias("n"))


def job_rollup(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.job_rollup(a.files(spark, d))


def job_pixels(spark: SparkSession, d: str) -> DataFrame:
    """The files with sizes of images from their bytes, some of them not readable."""
    width = F.when(F.col("size") % 7 != 0, F.col("size") + 1)
    return lifecycle.job_rollup(a.files(spark, d).withColumn("width", width).withColumn("height", F.col("idx") + 2))


def split_failures(spark: SparkSession, d: str) -> DataFrame:
    j = a.jobs(spark, d).withColumn("accepted", F.col("job_id").cast("long") % 4 != 0)
    terminal, rejected = lifecycle.split_failures(j)
    both = terminal.select(F.lit("terminal").alias("kind"), "error_code").unionByName(rejected.select(F.lit("rejection").alias("kind"), "error_code"))
    return both.groupBy("kind", "error_code").agg(F.count("*").alias("n"))


def pseudonyms(spark: SparkSession, d: str) -> DataFrame:
    digest = hmac_sha256(b"key", F.col("o_orderkey").cast("string"))
    return a.table(spark, d, "orders").select("o_orderkey", digest.alias("digest"), F.substring(F.sha2(F.col("o_custkey").cast("string").cast("binary"), 256), 1, 24).alias("client_digest"))


_IPAD, _OPAD = ("".join(f"{b ^ p:02x}" for b in b"key".ljust(64, b"\0")) for p in (0x36, 0x5C))
PSEUDONYM_SQL = f"""select o_orderkey, sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || o_orderkey::varchar::blob))) digest, substr(sha256(o_custkey::varchar), 1, 24) client_digest from orders"""


def prune_facts(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.prune(a.jobs(spark, d), "accepted_at", "1996-06-01").select("job_id", iso(F.col("accepted_at")).alias("accepted_at"))


def prune_plan(spark: SparkSession, d: str) -> DataFrame:
    return retention.prune_plan(a.rejections(spark, d), "occurred_at", "1995-01-10 12:00:00").withColumn("date", F.col("date").cast("string"))


def prune_table(spark: SparkSession, d: str) -> DataFrame:
    """The rejections as a table by date, pruned: rows of each date that is left."""
    path = scratch_path(spark, "prunable")
    lifecycle.append_rejections(a.rejections(spark, d), path)
    lifecycle.prune_table(spark, path, "occurred_at", "occurred_date", "1995-01-10 12:00:00")
    back = spark.read.parquet(path)
    return back.groupBy(F.col("occurred_date").cast("string").alias("occurred_date")).agg(F.count("*").alias("n"), F.sum("input_bytes").alias("input_bytes"))


_JOBS = "jobs: struct<" + ", ".join(f"{m}: bigint" for m in M[:5]) + ">, filesAccepted: bigint, inputBytes: bigint, resultBytes: bigint"
_TIMES = "struct<count: bigint, average: double, p50: double, p95: double>"
_TIMED = f"{_JOBS}, timing: struct<queueSeconds: {_TIMES}, processingSeconds: {_TIMES}>"
DOCUMENT = (
    f"period struct<from: string, to: string, bucket: string, timezone: string>, summary struct<{_TIMED}>, operations array<struct<operation: string, {_TIMED}>>, "
    f"errors array<struct<code: string, count: bigint>>, series array<struct<start: string, {_JOBS}, operations: map<string, struct<{_JOBS}>>>>"
)


def _measures(x: str) -> list:
    return [F.col(f"{x}.jobs.{m}").alias(m) if m in M[:5] else F.col(f"{x}.{k}").alias(m) for m, k in zip(M, [*M[:5], "filesAccepted", "inputBytes", "resultBytes"], strict=True)]


def _document(spark: SparkSession, d: str) -> DataFrame:
    return report_documents(spark, d).select(F.from_json("document", DOCUMENT).alias("d")).select("d.*")


def report_document_series(spark: SparkSession, d: str) -> DataFrame:
    """The series read back from the JSON document."""
    return _document(spark, d).select(F.explode("series").alias("r")).select("r.start", *_measures("r"))


def report_document_parts(spark: SparkSession, d: str) -> DataFrame:
    """Every part of the JSON document read back: part, start, operation (or error code), field, value."""
    doc = _document(spark, d)

    def long(df: DataFrame, part: str, start, name, x: str, timed: bool):
        values = [F.struct(F.lit(c).alias("field"), v.cast("double").alias("value")) for c, v in zip(M, _measures(x), strict=True)]
        if timed:
            values += [F.struct(F.lit(f"{k}_{c}").alias("field"), F.col(f"{x}.timing.{k}Seconds.{c}").cast("double").alias("value")) for k in ("queue", "processing") for c in ("count", "average", "p50", "p95")]
        return df.select(F.lit(part).alias("part"), start.alias("start"), name.alias("operation"), F.explode(F.array(*values)).alias("v")).select("part", "start", "operation", "v.field", "v.value")

    none = F.lit(None).cast("string")
    series = doc.select(F.explode("series").alias("s"))
    inner = series.select("s.start", F.explode("s.operations").alias("operation", "o"))
    errors = doc.select(F.posexplode("errors").alias("place", "e")).select(F.lit("errors").alias("part"), none.alias("start"), F.col("e.code").alias("operation"), F.explode(F.array(F.struct(F.lit("count").alias("field"), F.col("e.count").cast("double").alias("value")), F.struct(F.lit("place").alias("field"), F.col("place").cast("double").alias("value")))).alias("v"))
    period = doc.select(F.lit("period").alias("part"), F.col("period.from").alias("start"), F.col("period.to").alias("operation"), F.concat_ws(" ", "period.bucket", "period.timezone").alias("field"), F.lit(None).cast("double").alias("value"))
    parts = [
        long(doc, "summary", none, none, "summary", True), long(doc.select(F.explode("operations").alias("o")), "operations", none, F.col("o.operation"), "o", True),
        long(series, "series", F.col("s.start"), none, "s", False), long(inner, "series operations", F.col("start"), F.col("operation"), "o", False),
        errors.select("part", "start", "operation", "v.field", "v.value"), period,
    ]
    return reduce(DataFrame.union, parts)


_LONG = "(select {keys}, unnest([{names}]) field, unnest([{values}]) as value from {table})"


def _unpivot(keys: str, table: str, timed: bool) -> str:
    times = [f"{k}_{c}" for k in ("queue", "processing") for c in ("count", "average", "p50", "p95")] if timed else []
    return _LONG.format(keys=keys, table=table, names=", ".join(f"'{x}'" for x in [*M, *times]), values=", ".join([*[f"coalesce({m}, 0)::double" for m in M], *[f"coalesce({x}, 0)::double" if x.endswith("count") else f"{x}::double" for x in times]]))


def _timed(keys: str) -> str:
    """Timing by keys, a column for each measure and figure."""
    pick = ", ".join(f"max(case when measure = '{k}' then {c} end) {k}_{c}" for k in ("queue", "processing") for c in ("count", "average", "p50", "p95"))
    return f"select {keys} {pick} from (with " + _PERCENTILE.format(keys=keys) + f") group by all"


DOCUMENT_SQL = f"""select part, start, operation, field, value from (
  select 'summary' part, null start, null operation, * from {_unpivot("1 k", f"((select {_SUMS} from c) cross join ({_timed('')}))", True)}
  union all by name select 'operations' part, * from {_unpivot("operation", f"((select operation, {_SUMS} from c group by operation) left join ({_timed('operation,')}) using (operation))", True)}
  union all by name select 'series' part, * from {_unpivot(_START, f"(b left join (select bucket, {_SUMS} from c group by bucket) using (bucket))", False)}
  union all by name select 'series operations' part, * from {_unpivot(f"{_START}, operation", f"(select bucket, operation, {_SUMS} from c group by bucket, operation)", False)}
  union all by name select 'errors' part, operation, unnest(['count', 'place']) field, unnest([n, place])::double as value from (select error_code operation, count(*) n, row_number() over (order by count(*) desc, error_code) - 1 place from c where error_code <> '' group by 1)
  union all by name select 'period' part, '{FROM}' start, '{TO}' operation, 'day UTC' field, null::double as value)"""


def latest_jobs(spark: SparkSession, d: str) -> DataFrame:
    o = a.table(spark, d, "orders").select(F.col("o_custkey").alias("client"), (F.col("o_orderkey") % 3).alias("tool"), "o_orderdate", "o_orderkey")
    return retention.latest(o, ["client", "tool"], ["o_orderdate", "o_orderkey"]).select("client", "tool", "o_orderkey")


QUERIES = {
    "report_series": lambda s, d: report.series(_c(s, d), *DAY),
    "report_series_hour": lambda s, d: report.series(_c(s, d, TO_HOURLY, "hour"), FROM, TO_HOURLY, "hour"),
    "report_summary": lambda s, d: report.summary(_c(s, d)),
    "report_by_operation": lambda s, d: report.by_operation(_c(s, d)),
    "report_series_by_operation": lambda s, d: report.series_by_operation(_c(s, d)),
    "report_grains": lambda s, d: report.grains(_c(s, d)),
    "report_errors": lambda s, d: report.errors(_c(s, d)),
    "report_timing": report_timing,
    "report_timing_total": report_timing_total,
    "report_timing_pandas": report_timing_pandas,
    "report_contributions": report_contributions,
    "report_operation_maps": report_operation_maps,
    "report_period_facts": report_period_facts,
    "report_period_rejections": report_period_rejections,
    "report_document": report_documents,
    "report_document_series": report_document_series,
    "report_document_parts": report_document_parts,
    "report_requests": report_requests,
    "bucket_floor": bucket_floor,
    "job_durations": job_durations,
    "lifecycle_fold": lifecycle_fold,
    "record_status_fold": record_status_fold,
    "accept_new": accept_new,
    "append_rejections": append_rejections,
    "terminal_events": terminal_events,
    "job_rollup": job_rollup,
    "job_pixels": job_pixels,
    "split_failures": split_failures,
    "pseudonyms": pseudonyms,
    "prune_facts": prune_facts,
    "prune_plan": prune_plan,
    "prune_table": prune_table,
    "latest_jobs": latest_jobs,
}

_SERIES = f"select {_START}, {', '.join(f'coalesce(s.{m}, 0)::bigint {m}' for m in M)} from b left join (select bucket, {_SUMS} from c group by bucket) s using (bucket) order by 1"
SQL = {
    "report_series": _sql(_SERIES),
    "report_series_hour": _sql(_SERIES, TO_HOURLY, "hour"),
    "report_document_series": _sql(_SERIES),
    "report_document_parts": _sql(DOCUMENT_SQL),
    "report_summary": _sql(f"select {_SUMS} from c"),
    "report_by_operation": _sql(f"select operation, {_SUMS} from c group by operation order by 1"),
    "report_series_by_operation": _sql(f"select {_START}, operation, {_SUMS} from c group by bucket, operation order by 1, 2"),
    "report_grains": _sql(f"select grouping(bucket, operation)::bigint grain, operation, {_START}, {_SUMS} from c group by grouping sets ((), (operation), (bucket), (bucket, operation))"),
    "report_errors": _sql("select error_code code, count(*) count from c where error_code <> '' group by 1 order by 2 desc, 1"),
    "report_timing": _sql("select * from (with " + _PERCENTILE.format(keys="operation,") + ")"),
    "report_timing_total": _sql("select * from (with " + _PERCENTILE.format(keys="") + ")"),
    "report_timing_pandas": _sql("select operation, p95 from (with " + _PERCENTILE.format(keys="operation,") + ") where measure = 'queue'"),
    "report_contributions": _sql(f"select {_START}, operation, {', '.join(f'{m}::bigint {m}' for m in M)}, queue_us, processing_us, error_code from c"),
    "report_operation_maps": _sql(f"select {_START}, coalesce(operations, '') operations from b left join (select bucket, string_agg(operation || '=' || a || '/' || r, ';' order by operation) operations from (select bucket, operation, sum(accepted)::varchar a, sum(rejected)::varchar r from c group by all) group by bucket) using (bucket)"),
    "report_period_facts": f"with {a.JOBS_SQL} select job_id, operation, {_ISO.format('accepted_at')} accepted_at, {_ISO.format('finished_at')} finished_at, status, result_bytes from jobs where accepted_at >= '{FROM}' and accepted_at < timestamp '1995-04-01' or finished_at >= '{FROM}' and finished_at < timestamp '1995-04-01'",
    "report_period_rejections": f"with {a.REJECTIONS_SQL} select epoch_us(occurred_at) occurred_us, operation, input_bytes, error_code from rejections where occurred_at >= '{FROM}' and occurred_at < timestamp '1995-01-11'",
    "report_requests": """with r as (
  select event_id, event_id % 7 = 0 bad, case when event_id % 3 <> 0 then ts::date else date '2024-02-01' end to_date, case when event_id % 5 <> 0 then ts::date - (event_id % 400)::int end f, ['hour', 'day', 'week'][event_id % 3 + 1] bucket from events),
p as (select event_id, bucket, to_date, case when bad then null else coalesce(f, to_date - 6) end from_date from r)
select event_id, from_date::varchar from_date, to_date::varchar to_date, coalesce(bucket in ('hour', 'day') and to_date - from_date + 1 between 1 and 365 and (bucket = 'day' or to_date - from_date + 1 <= 31), false) valid from p""",
    "bucket_floor": "select event_id, strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%SZ') as hour, strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%SZ') as day, replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ'), '.000000Z', 'Z') as at, replace(strftime(ts + interval 1 hour, '%Y-%m-%dT%H:%M:%S.%fZ'), '.000000Z', 'Z') expires_at from events",
    "job_durations": f"with {a.JOBS_SQL} select job_id, case when started_at is not null then greatest(0, epoch_us(started_at) - epoch_us(accepted_at)) end queue_us, case when started_at is not null then greatest(0, epoch_us(finished_at) - epoch_us(started_at)) end processing_us from jobs",
    "lifecycle_fold": FOLD_SQL,
    "record_status_fold": STATUS_SQL,
    "accept_new": ACCEPT_SQL,
    "append_rejections": f"with {a.REJECTIONS_SQL} select strftime(occurred_at, '%Y-%m-%d') occurred_date, 2 * count(*) n, (2 * sum(input_bytes))::bigint input_bytes from rejections group by 1",
    "terminal_events": f"with {a.EVENTS_SQL} select status, count(*) n from lifecycle_events where kind = 'terminal' and status in ('succeeded', 'failed', 'cancelled') group by 1",
    "job_rollup": f"with {a.FILES_SQL} select job_id, count(*) file_count, sum(size)::bigint input_bytes from files group by 1",
    "job_pixels": f"with {a.FILES_SQL} select job_id, count(*) file_count, sum(size)::bigint input_bytes, coalesce(sum(case when ext in ('.png', '.jpg', '.webp') and size % 7 <> 0 then (size + 1) * (idx + 2) end), 0)::bigint input_pixels from files group by 1",
    "split_failures": f"with {a.JOBS_SQL} select case when job_id::bigint % 4 <> 0 then 'terminal' else 'rejection' end kind, error_code, count(*) n from jobs where error_code is not null group by 1, 2",
    "pseudonyms": PSEUDONYM_SQL,
    "prune_facts": f"with {a.JOBS_SQL} select job_id, {_ISO.format('accepted_at')} accepted_at from jobs where accepted_at >= timestamp '1996-06-01'",
    "prune_plan": f"with {a.REJECTIONS_SQL} select strftime(occurred_at, '%Y-%m-%d') date, count(*) n_rows, count(*) filter (where occurred_at < timestamp '1995-01-10 12:00:00') n_pruned, case when count(*) filter (where occurred_at < timestamp '1995-01-10 12:00:00') = 0 then 'keep' when count(*) filter (where occurred_at < timestamp '1995-01-10 12:00:00') = count(*) then 'drop' else 'rewrite' end as action from rejections group by 1",
    "prune_table": f"with {a.REJECTIONS_SQL} select strftime(occurred_at, '%Y-%m-%d') occurred_date, count(*) n, sum(input_bytes)::bigint input_bytes from rejections where occurred_at >= timestamp '1995-01-10 12:00:00' group by 1",
    "latest_jobs": "select o_custkey client, o_orderkey % 3 tool, arg_max(o_orderkey, (o_orderdate, o_orderkey)) o_orderkey from orders group by 1, 2",
}
