"""The library's tables from the supplied ones, each with the same mapping as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.schema import utc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs: the first shipment starts a job, the last ends it."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    lines = lines.agg(F.min("l_shipdate").alias("s"), F.max("l_shipdate").alias("f"), F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("b"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus").join(lines, "o_orderkey", "left")
    started = F.col("s").isNotNull()
    status = F.when(~started, "queued").when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "failed").otherwise("cancelled")
    code = F.element_at(F.array(F.lit("INVALID_FILE"), F.lit("TIMEOUT"), F.lit("UPSTREAM_ERROR")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return o.select(
        F.col("o_orderkey").cast("string").alias("job_id"), F.col("o_orderpriority").alias("operation"),
        F.col("o_orderdate").cast("timestamp").alias("accepted_at"), F.col("s").cast("timestamp").alias("started_at"), F.col("f").cast("timestamp").alias("finished_at"),
        status.alias("status"), F.coalesce("n", F.lit(0)).cast("long").alias("file_count"), F.coalesce("b", F.lit(0)).cast("long").alias("input_bytes"),
        F.when(F.col("o_orderstatus") == "F", F.coalesce("b", F.lit(0)) * 2).otherwise(0).cast("long").alias("result_bytes"),
        F.when((F.col("o_orderstatus") == "O") & started, code).alias("error_code"),
    )


JOBS_SQL = """jobs as (
  select o_orderkey::varchar job_id, o_orderpriority operation, o_orderdate::timestamp accepted_at, s::timestamp started_at, f::timestamp finished_at,
    case when s is null then 'queued' when o_orderstatus = 'F' then 'succeeded' when o_orderstatus = 'O' then 'failed' else 'cancelled' end status,
    coalesce(n, 0)::bigint file_count, coalesce(b, 0)::bigint input_bytes, (case when o_orderstatus = 'F' then coalesce(b, 0) * 2 else 0 end)::bigint result_bytes,
    case when o_orderstatus = 'O' and s is not null then case o_orderkey % 3 when 0 then 'INVALID_FILE' when 1 then 'TIMEOUT' else 'UPSTREAM_ERROR' end end error_code
  from orders left join (select l_orderkey, min(l_shipdate) s, max(l_shipdate) f, count(*) n, sum(l_quantity)::bigint b from lineitem group by 1) on l_orderkey = o_orderkey)"""


def rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events as rejections, moved by 10592 days into the years of the orders."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    operation = F.when(F.col("user_id") % 3 == 0, "1-URGENT").when(F.col("user_id") % 3 == 1, "3-MEDIUM").otherwise("5-LOW")
    code = F.when(F.col("event_id") % 4 == 0, "INVALID_FILE").when(F.col("event_id") % 4 == 1, "FILE_TOO_LARGE").when(F.col("event_id") % 4 == 2, "RATE_LIMITED").otherwise("UNSUPPORTED_FORMAT")
    ts = F.col("ts").cast("timestamp") - F.expr("interval 10592 days")
    return e.select(ts.alias("occurred_at"), operation.alias("operation"), F.lit(1).cast("long").alias("file_count"), F.floor("value").cast("long").alias("input_bytes"), code.alias("error_code"))


REJECTIONS_SQL = """rejections as (
  select ts - interval 10592 days occurred_at, case user_id % 3 when 0 then '1-URGENT' when 1 then '3-MEDIUM' else '5-LOW' end operation,
    1::bigint file_count, floor(value)::bigint input_bytes, case event_id % 4 when 0 then 'INVALID_FILE' when 1 then 'FILE_TOO_LARGE' when 2 then 'RATE_LIMITED' else 'UNSUPPORTED_FORMAT' end error_code
  from events where event_type = 'error')"""


def lifecycle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted, started and terminal rows of the jobs in order, and for each fifth order late and repeated copies. Each job is read once and gives all its rows."""
    number = F.col("job_id").cast("long")
    odd, begun, done = number % 5 == 0, F.col("started_at").isNotNull(), F.col("finished_at").isNotNull()

    def row(kind: str, place: int, ts: str, when, status=None):
        entry = F.struct(F.lit(kind).alias("kind"), F.col(ts).alias("ts"), (number * 10 + place).alias("seq"), (F.lit(None).cast("string") if status is None else status).alias("status"))
        return entry if when is None else F.when(when, entry)

    rows = F.array_compact(F.array(
        row("accepted", 1, "accepted_at", None), row("started", 2, "started_at", begun), row("terminal", 4, "finished_at", done, F.col("status")),
        row("started", 0, "started_at", begun & odd), row("terminal", 5, "accepted_at", odd, F.lit("cancelled")), row("accepted", 6, "started_at", begun & odd), row("started", 3, "finished_at", done & odd),
    ))
    e = jobs(spark, sf_dir).select("job_id", "operation", "file_count", "input_bytes", "result_bytes", "error_code", F.explode(rows).alias("e"))
    return e.select("job_id", "e.kind", "operation", "e.ts", "e.seq", "file_count", "input_bytes", "result_bytes", "e.status", "error_code")


EVENTS_SQL = f"""{JOBS_SQL},
lifecycle as (
  select *, job_id::bigint * 10 k, job_id::bigint % 5 = 0 odd from jobs),
lifecycle_events as (
  select job_id, 'accepted' kind, operation, accepted_at ts, k + 1 seq, file_count, input_bytes, result_bytes, null status, error_code from lifecycle
  union all select job_id, 'started', operation, started_at, k + 2, file_count, input_bytes, result_bytes, null, error_code from lifecycle where started_at is not null
  union all select job_id, 'terminal', operation, finished_at, k + 4, file_count, input_bytes, result_bytes, status, error_code from lifecycle where finished_at is not null
  union all select job_id, 'started', operation, started_at, k, file_count, input_bytes, result_bytes, null, error_code from lifecycle where started_at is not null and odd
  union all select job_id, 'terminal', operation, accepted_at, k + 5, file_count, input_bytes, result_bytes, 'cancelled', error_code from lifecycle where odd
  union all select job_id, 'accepted', operation, started_at, k + 6, file_count, input_bytes, result_bytes, null, error_code from lifecycle where started_at is not null and odd
  union all select job_id, 'started', operation, finished_at, k + 3, file_count, input_bytes, result_bytes, null, error_code from lifecycle where finished_at is not null and odd)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("client"), F.when(F.col("event_type").isin("purchase", "signup"), "ai").otherwise("local").alias("class"), (1 + F.col("event_id") % 3).alias("units"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))


REQUESTS_SQL = """requests as (select user_id client, case when event_type in ('purchase', 'signup') then 'ai' else 'local' end class, 1 + event_id % 3 units, ts, event_id seq from events)"""


def lease_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views, clicks and purchases reserve a job named by the event; a signup releases the user's event before it."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").where("event_type <> 'error'")
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    release = F.col("event_type") == "signup"
    e = e.withColumn("job_id", F.when(release, before).otherwise(F.col("event_id")))
    return e.select(F.col("user_id").alias("client"), F.col("job_id").cast("string").alias("job_id"), F.when(release, "release").otherwise("reserve").alias("kind"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))


LEASES_SQL = """lease_events as (
  select user_id client, (case when event_type = 'signup' then lag(event_id) over (partition by user_id order by ts, event_id) else event_id end)::varchar job_id,
    case when event_type = 'signup' then 'release' else 'reserve' end kind, ts, event_id seq
  from events where event_type <> 'error')"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of jobs of up to 20, with an operation for each job."""
    d = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*[F.lit(x) for x in (".png", ".jpg", ".webp", ".pdf", ".docx", ".rtf", ".xyz")]), (F.col("doc_id") % 7 + 1).cast("int"))
    job = F.floor(F.col("doc_id") / 8).cast("long")
    op = F.element_at(F.array(*[F.lit(x) for x in ("image-convert", "document-convert", "pdf-merge", "upscale")]), (job % 4 + 1).cast("int"))
    return d.select(job.alias("job_id"), op.alias("operation"), (F.col("doc_id") % 8 + 1).cast("int").alias("idx"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(" "), F.substring("text", 1, 20), ext).alias("original"), ext.alias("ext"), F.col("n_chars").alias("size"), "text")


FILES_SQL = """files as (
  select (doc_id // 8)::bigint job_id, ['image-convert', 'document-convert', 'pdf-merge', 'upscale'][(doc_id // 8) % 4 + 1] operation, (doc_id % 8 + 1)::int idx,
    lang || '/' || doc_id::varchar || ' ' || substring(text, 1, 20) || ['.png', '.jpg', '.webp', '.pdf', '.docx', '.rtf', '.xyz'][doc_id % 7 + 1] original,
    ['.png', '.jpg', '.webp', '.pdf', '.docx', '.rtf', '.xyz'][doc_id % 7 + 1] ext, n_chars size, text
  from documents)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents of pages; some without text, some with little."""
    c = table(spark, sf_dir, "conversations")
    text = F.when(F.col("conv_id") % 4 == 0, "  \n").when((F.col("conv_id") % 4 == 1) & (F.col("turn") > 0), F.substring("text", 1, 5)).otherwise(F.col("text"))
    return c.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_no"), text.alias("text"), (595 + F.col("conv_id") % 3 * 100).cast("double").alias("width_pt"), F.lit(842).cast("double").alias("height_pt"))


PAGES_SQL = """pdf_pages as (
  select conv_id doc_id, (turn + 1)::int page_no, case when conv_id % 4 = 0 then '  ' || chr(10) when conv_id % 4 = 1 and turn > 0 then substring(text, 1, 5) else text end as text,
    (595 + conv_id % 3 * 100)::double width_pt, 842::double height_pt
  from conversations)"""


def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for page ranges of each document, with its number of pages."""
    n = pages(spark, sf_dir).groupBy("doc_id").agg(F.count("*").cast("int").alias("page_count"))
    asked = F.element_at(F.array(*[F.lit(x) for x in ("1-2, 3", "1", "2-1", " , ", "1-99")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return n.select("doc_id", asked.alias("ranges"), "page_count")


RANGES_SQL = f"""{PAGES_SQL},
page_ranges as (select doc_id, ['1-2, 3', '1', '2-1', ' , ', '1-99'][doc_id % 5 + 1] ranges, count(*)::int page_count from pdf_pages group by doc_id)"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("image_id"), (F.col("p_size") * 400).cast("long").alias("width"), F.floor(F.col("p_retailprice") * 10).cast("long").alias("height"), F.when(F.col("p_partkey") % 2 == 0, 2).otherwise(4).cast("long").alias("scale"))


IMAGES_SQL = """images as (select p_partkey image_id, (p_size * 400)::bigint width, floor(p_retailprice * 10)::bigint height, (case when p_partkey % 2 = 0 then 2 else 4 end)::bigint scale from part)"""


def directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("job_id"), F.col("o_orderdate").cast("timestamp").alias("mtime"))
