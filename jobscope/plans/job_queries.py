"""Admission, validation, page, file and retention queries over the supplied tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.functions import geometry as g
from jobscope.functions import responses, scalars
from jobscope.functions.scalars import iso
from jobscope.operators import admission, pages, retention, validate
from jobscope.sources import adapters as a
from jobscope.sources import directories
from jobscope.sources import files as sources
from jobscope.sources.scratch import scratch_path

DAY_S = 86_400
#: Limits of the fixture, so that each rule bites.
LIMITS = validate.Limits(image=4_000, document=8_000, job=20_000, chunk=1_000)
NOW = "1998-01-01"


def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    out = admission.rate_limit(a.requests(spark, d), DAY_S, ai=4, local=6)
    return out.select("client", "class", "seq", "units", "accepted")


RATE_SQL = f"""with recursive {a.REQUESTS_SQL},
q as (select *, epoch_us(ts) us, case when class = 'ai' then 4 else 6 end lim, row_number() over (partition by client, class order by ts, seq) n from requests),
s as (
  select client, class, seq, units, n, units <= lim accepted, case when units <= lim then [{{'t': us, 'u': units}}] else [] end log from q where n = 1
  union all
  select q.client, q.class, q.seq, q.units, q.n,
    coalesce(list_sum([x.u for x in s.log if x.t > q.us - {DAY_S}000000]), 0) + q.units <= q.lim,
    [x for x in s.log if x.t > q.us - {DAY_S}000000] || case when coalesce(list_sum([x.u for x in s.log if x.t > q.us - {DAY_S}000000]), 0) + q.units <= q.lim then [{{'t': q.us, 'u': q.units}}] else [] end
  from s join q on q.client = s.client and q.class = s.class and q.n = s.n + 1)
select client, class, seq, units, accepted from s"""


def lease_limit(spark: SparkSession, d: str) -> DataFrame:
    return admission.leases(a.lease_events(spark, d), 3, DAY_S).select("client", "job_id", "kind", "seq", "accepted")


LEASE_SQL = f"""with recursive {a.LEASES_SQL},
q as (select *, epoch_us(ts) us, row_number() over (partition by client order by ts, seq) n from lease_events),
s as (
  select client, job_id, kind, seq, n, true accepted, case when kind = 'reserve' then [{{'j': job_id, 'e': us + {DAY_S}000000}}] else [] end held from q where n = 1
  union all
  select q.client, q.job_id, q.kind, q.seq, q.n, q.kind = 'release' or len([x for x in s.held if x.e > q.us]) < 3,
    case when q.kind = 'release' then [x for x in s.held if x.j is distinct from q.job_id]
      when len([x for x in s.held if x.e > q.us]) < 3 then [x for x in s.held if x.e > q.us and x.j <> q.job_id] || [{{'j': q.job_id, 'e': q.us + {DAY_S}000000}}]
      else [x for x in s.held if x.e > q.us] end
  from s join q on q.client = s.client and q.n = s.n + 1)
select client, job_id, kind, seq, accepted from s"""


def admission_replay(spark: SparkSession, d: str) -> DataFrame:
    return admission.admission_replay(a.requests(spark, d), 3, DAY_S, DAY_S, ai=4, local=6).select("client", "class", "seq", "accepted")


_LIVE = f"len([x for x in s.held if x > q.us]) < 3"
_USED = f"coalesce(list_sum([x.u for x in s.log if x.t > q.us - {DAY_S}000000 and x.c = q.class]), 0) + q.units <= q.lim"
REPLAY_SQL = f"""with recursive {a.REQUESTS_SQL},
q as (select *, epoch_us(ts) us, case when class = 'ai' then 4 else 6 end lim, row_number() over (partition by client order by ts, seq) n from requests),
s as (
  select client, class, seq, n, units <= lim accepted, case when units <= lim then [us + {DAY_S}000000] else [] end held, case when units <= lim then [{{'t': us, 'u': units, 'c': class}}] else [] end log from q where n = 1
  union all
  select q.client, q.class, q.seq, q.n, {_LIVE} and {_USED},
    [x for x in s.held if x > q.us] || case when {_LIVE} and {_USED} then [q.us + {DAY_S}000000] else [] end,
    [x for x in s.log if x.t > q.us - {DAY_S}000000] || case when {_LIVE} and {_USED} then [{{'t': q.us, 'u': q.units, 'c': q.class}}] else [] end
  from s join q on q.client = s.client and q.n = s.n + 1)
select client, class, seq, accepted from s"""


def client_addresses(spark: SparkSession, d: str) -> DataFrame:
    e = a.table(spark, d, "events")
    forwarded = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" 10.0.0."), (F.col("user_id") % 256).cast("string"), F.lit(" , 10.1.1.1"))).when(F.col("event_id") % 3 == 1, F.lit("  "))
    host = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("host"), F.col("user_id").cast("string")))
    operation = F.when(F.col("event_type") == "view", "upscale").when(F.col("event_type") == "click", "remove-background").otherwise("pdf-merge")
    return e.select("event_id", scalars.client_address(forwarded, host).alias("client"), scalars.route(operation).alias("route"))


def record_views(spark: SparkSession, d: str) -> DataFrame:
    j = a.jobs(spark, d)
    pairs = [
        ("job_id", F.col("job_id")), ("operation", F.col("operation")), ("status", F.col("status")), ("total", F.when(F.col("job_id").cast("long") % 3 == 0, F.col("file_count").cast("string"))),
        ("error_code", F.col("error_code")), ("error_message", F.when(F.col("error_code") == "TIMEOUT", "too slow")),
    ]
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in pairs]), lambda x: x["v"].isNotNull())
    v = j.select(scalars.record_view(F.map_from_entries(entries)).alias("v"))
    return v.select("v.job_id", "v.operation", "v.status", "v.progress", "v.total", F.col("v.error.code").alias("code"), F.col("v.error.message").alias("message"))


def record_files(spark: SparkSession, d: str) -> DataFrame:
    f = a.files(spark, d)
    record = F.struct(F.concat(F.lit("/jobs/"), F.col("job_id").cast("string")).alias("path"), "original", scalars.mime(F.col("ext")).alias("content_type"), "size")
    json = f.groupBy("job_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("idx", record.alias("r")))), lambda x: x["r"])).alias("files"))
    out = json.select("job_id", F.posexplode(scalars.record_files(F.col("files"))).alias("k", "f"))
    return out.select("job_id", (F.col("k") + 1).alias("ordinal"), F.col("f.original").alias("original"), F.col("f.content_type").alias("content_type"), F.col("f.size").alias("size"))


_OPTION = """case when event_id % 11 = 0 then '[1, 2]' when event_id % 11 = 1 then '{"k": ' when event_id % 11 = 2 then '{"quality": ' || event_id::varchar || ', "format": "PNG", "scale": 4}'
  when event_id % 11 = 3 then '{"quality": "high", "margin": 90}' when event_id % 11 = 4 then '{"format": "gif", "dpi": 300, "mode": "ranges", "quality": 0}' when event_id % 11 = 5 then null
  when event_id % 11 = 6 then '{"mode": "each", "pageSize": "original", "orientation": "Landscape", "format": "png", "quality": "bad"}' when event_id % 11 = 7 then '{"mode": "EACH", "format": "webp", "quality": "bad", "maxWidth": null, "margin": "7"}'
  when event_id % 11 = 8 then '{"quality": null, "format": null, "pageSize": "A4"}' when event_id % 11 = 9 then '{"maxWidth": "640", "maxHeight": 480.9, "scale": 3, "dpi": "300"}' else props end"""


_OPTION_OPERATIONS = ["image-convert", "upscale", "remove-background", "images-to-pdf", "pdf-to-images"]


def option_values(spark: SparkSession, d: str) -> DataFrame:
    operation = F.element_at(F.array(*map(F.lit, _OPTION_OPERATIONS)), (F.col("event_id") % 5 + 1).cast("int"))
    e = a.table(spark, d, "events").select("event_id", operation.alias("operation"), F.expr(_OPTION.replace("::varchar", "::string")).alias("options"))
    columns = scalars.option_columns(F.col("options"), F.col("operation"))
    return e.select("event_id", "operation", scalars.options_valid(F.col("options")).alias("valid"), *[c.alias(n) for n, c in columns.items()])


def _whole(key: str, default: int) -> str:
    """A number of the JSON j cut down to a whole one; null if it can't be read."""
    x = f"(j ->> '$.{key}')"
    return f"""case json_type(j, '$.{key}') when 'VARCHAR' then case when regexp_full_match({x}, '\\s*[+-]?\\d+\\s*') then trim({x})::bigint end when 'DOUBLE' then trunc({x}::double)::bigint
      when 'BOOLEAN' then ({x} = 'true')::bigint when 'UBIGINT' then {x}::bigint when 'BIGINT' then {x}::bigint when 'NULL' then null else case when j is null or json_type(j, '$.{key}') is null then {default} end end"""


def _str(key: str, default: str) -> str:
    return f"case when json_type(j, '$.{key}') = 'NULL' then 'None' else coalesce(j ->> '$.{key}', {default}) end"


OPTION_SQL = f"""with e as (select event_id, {_OPTION_OPERATIONS}[event_id % 5 + 1] operation, {_OPTION} o from events),
p as (select event_id, operation, o is not null and json_valid(o) and json_type(case when json_valid(o) then o end) = 'OBJECT' valid, case when json_valid(o) then o end::json j from e),
v as (
  select *, lower({_str("format", "case operation when 'upscale' then 'jpeg' when 'remove-background' then 'png' when 'pdf-to-images' then 'png' else 'webp' end")}) format, {_whole("quality", 100)} q, {_whole("scale", 2)} sc, {_whole("dpi", 150)} d,
    {_whole("margin", 10)} m, case when json_type(j, '$.maxWidth') = 'NULL' or j ->> '$.maxWidth' = '' then 0 else {_whole("maxWidth", 0)} end w, case when json_type(j, '$.maxHeight') = 'NULL' or j ->> '$.maxHeight' = '' then 0 else {_whole("maxHeight", 0)} end h
  from p)
select event_id, operation, coalesce(valid, false) valid, format, (case when operation = 'image-convert' and q is not null then greatest(1, least(100, q)) else q end)::bigint quality,
  (case when w is not null then greatest(0, w) end)::bigint max_width, (case when h is not null then greatest(0, h) end)::bigint max_height, sc::bigint scale, d::bigint dpi, (case when m is not null then greatest(0, least(30, m)) end)::bigint margin,
  case when j ->> '$.mode' = 'each' then 'each' else 'ranges' end as mode, {_str("pageSize", "'a4'")} page_size, {_str("orientation", "'auto'")} orientation,
  case operation
    when 'image-convert' then case when format not in ('jpg', 'jpeg', 'png', 'webp') then 'UNSUPPORTED_FORMAT' when q is null or w is null or h is null then 'INTERNAL_ERROR' end
    when 'upscale' then case when sc is null or sc not in (2, 4) then 'INVALID_FILE' when format not in ('jpg', 'jpeg', 'png', 'webp') then 'UNSUPPORTED_FORMAT' when format <> 'png' and q is null then 'INTERNAL_ERROR' end
    when 'remove-background' then case when format not in ('png', 'webp') then 'UNSUPPORTED_FORMAT' when format = 'webp' and q is null then 'INTERNAL_ERROR' end
    when 'images-to-pdf' then case when m is null then 'INTERNAL_ERROR' end
    when 'pdf-to-images' then case when format not in ('jpg', 'jpeg', 'png', 'webp') then 'UNSUPPORTED_FORMAT' when d is null then 'INTERNAL_ERROR' when d not in (150, 300) then 'INVALID_FILE' when q is null then 'INTERNAL_ERROR' end
  end options_error
from v"""


def file_names(spark: SparkSession, d: str) -> DataFrame:
    p = a.table(spark, d, "pages")
    return p.select("page_id", scalars.clean_stem(F.col("url")).alias("stem"), scalars.sanitize(F.col("url"), F.lit(".pdf")).alias("safe"))


FILE_NAME_SQL = r"""with b as (select page_id, regexp_extract(url, '([^/]*)/*$', 1) b from pages)
select page_id, coalesce(nullif(substring(trim(regexp_replace(regexp_replace(b, '(.)\.[^.]+$', '\1'), '[^\p{L}\p{N}_.-]+', '_', 'g'), '._'), 1, 80), ''), 'result') stem,
  regexp_replace(coalesce(nullif(substring(regexp_replace(b, '[^\p{L}\p{N} ._()-]', '_', 'g'), 1, 150), ''), 'file.pdf'), '^\s+|\s+$', '', 'g') safe
from b"""


def output_names(spark: SparkSession, d: str) -> DataFrame:
    f = a.files(spark, d)
    op = F.element_at(F.array(*[F.lit(x) for x in ("image-convert", "upscale", "remove-background", "pdf-split", "pdf-to-images")]), (F.col("job_id") % 5 + 1).cast("int"))
    fmt = F.element_at(F.array(*[F.lit(x) for x in ("jpeg", "png", "webp", "gif")]), (F.col("idx") % 4 + 1).cast("int"))
    ext = scalars.image_extension(fmt)
    name = scalars.output_name(op, F.lit("stem"), F.col("idx"), ext, F.col("idx"), F.col("idx") + 2)
    return f.select("job_id", "idx", name.alias("name"), scalars.image_format(fmt).alias("format"), scalars.mime(scalars.extension(name)).alias("mime"))


OUTPUT_NAME_SQL = f"""with {a.FILES_SQL},
n as (select job_id, idx, ['image-convert', 'upscale', 'remove-background', 'pdf-split', 'pdf-to-images'][job_id % 5 + 1] op, ['.jpg', '.png', '.webp', '.png'][idx % 4 + 1] ext, ['JPEG', 'PNG', 'WEBP', 'PNG'][idx % 4 + 1] format from files),
m as (select *, case op when 'upscale' then 'upscaled_stem_' || idx || ext when 'remove-background' then 'no-background_stem_' || idx || ext when 'pdf-split' then 'pages-' || idx || '-' || (idx + 2) || '_' || idx || '.pdf'
  when 'pdf-to-images' then 'page-' || printf('%03d', idx) || ext else 'stem_' || idx || ext end as name from n)
select job_id, idx, name, format, case when name like '%.jpg' then 'image/jpeg' when name like '%.png' then 'image/png' when name like '%.webp' then 'image/webp' else 'application/pdf' end mime from m"""


def job_eta(spark: SparkSession, d: str) -> DataFrame:
    i = a.images(spark, d)
    op = F.element_at(F.array(*[F.lit(x) for x in ("upscale", "remove-background", "document-convert", "pdf-to-images", "pdf-merge")]), (F.col("image_id") % 5 + 1).cast("int"))
    return i.select("image_id", scalars.eta(op, F.col("scale"), F.col("image_id") % 4, F.col("width") * F.col("height")).alias("seconds"))


ETA_SQL = f"""with {a.IMAGES_SQL}, e as (select *, image_id % 5 op, greatest(1, image_id % 4) n, width * height / 1e6::double mp from images)
select image_id, (case op when 0 then case when scale = 4 then floor(n * 90 + mp * 30 + 0.5) else floor(n * 60 + mp * 12 + 0.5) end when 1 then n * 60 when 2 then n * 45 when 3 then 75 else greatest(8, n * 8) end)::bigint as seconds from e"""


def image_geometry(spark: SparkSession, d: str) -> DataFrame:
    i, w, h = a.images(spark, d), F.col("width"), F.col("height")
    orientation = F.element_at(F.array(*[F.lit(x) for x in ("auto", "portrait", "landscape")]), (F.col("image_id") % 3 + 1).cast("int"))
    out = i.select(
        "image_id", g.thumbnail(w, h, F.lit(1200), F.lit(0)).alias("t"), g.page_layout(w, h, F.when(F.col("image_id") % 7 == 0, "original").otherwise("a4"), orientation, F.col("image_id") % 40).alias("a"),
        g.thumbnail(w, h, F.lit(97), F.lit(61)).alias("s"), g.upscaled(w, h, F.col("scale")).alias("u"), g.mask_size(w, h).alias("m"), g.render_size(w.cast("double"), F.lit(150)).alias("rendered"),
    )
    return out.select("image_id", F.col("t.width").alias("thumb_w"), F.col("t.height").alias("thumb_h"), F.col("s.width").alias("small_w"), F.col("s.height").alias("small_h"), "a.page_width", "a.page_height", F.col("a.width").alias("on_page_w"), F.col("a.height").alias("on_page_h"), "a.x", "a.y", F.col("u.width").alias("up_w"), F.col("m.width").alias("mask_w"), F.col("m.height").alias("mask_h"), "rendered")


GEOMETRY_SQL = f"""with {a.IMAGES_SQL},
l as (select *, image_id % 3 = 2 or image_id % 3 = 0 and width > height land, round_even(greatest(0, least(30, image_id % 40)) / 25.4::double * 150, 0)::bigint m, least(1200, width) lw, greatest(width, height) side from images),
p as (select *, case when land then 1754 else 1240 end pw, case when land then 1240 else 1754 end ph from l),
r as (select *, pw - 2 * m rw, ph - 2 * m rh from p),
f as (select *, case when rw * height <= rh * width then rw else greatest(1, round_even(width * rh / height::double, 0))::bigint end fw, case when rw * height <= rh * width then greatest(1, round_even(height * rw / width::double, 0))::bigint else rh end fh, width / height::double asp from r),
z as (select image_id, 0 k, width w, height h, asp, least(1200, width) x, height y from f union all select image_id, 1, width, height, asp, least(97, width), least(61, height) from f),
c as (select *, x >= w and y >= h fits, x / y::double >= asp by_height, y * asp nx, x / asp ny from z),
th as (
  select image_id, k, (case when fits then w when not by_height then x when floor(nx) = 0 or abs(asp - floor(nx) / y) <= abs(asp - ceil(nx) / y) then greatest(1, floor(nx)) else ceil(nx) end)::bigint tw,
    (case when fits then h when by_height then y when floor(ny) = 0 then 1 when abs(asp - x / floor(ny)) <= abs(asp - x / ceil(ny)) then floor(ny) else ceil(ny) end)::bigint th from c)
select image_id, t.tw thumb_w, t.th thumb_h, s.tw small_w, s.th small_h, (case when image_id % 7 = 0 then width else pw end)::bigint page_width, (case when image_id % 7 = 0 then height else ph end)::bigint page_height,
  case when image_id % 7 = 0 then width else fw end on_page_w, case when image_id % 7 = 0 then height else fh end on_page_h,
  (case when image_id % 7 = 0 then 0 else floor((pw - fw) / 2) end)::bigint x, (case when image_id % 7 = 0 then 0 else floor((ph - fh) / 2) end)::bigint y, width * scale up_w,
  (case when side > 512 then floor(width * (512::double / side)) else width end)::bigint mask_w, (case when side > 512 then floor(height * (512::double / side)) else height end)::bigint mask_h, ceil(width::double * 150 / 72)::bigint rendered
from f join th t using (image_id) join th s using (image_id) where t.k = 0 and s.k = 1"""


def png_probe(spark: SparkSession, d: str) -> DataFrame:
    """Heads and ends of PNG files with the images' sizes, each seventh broken."""
    i = a.images(spark, d)
    size = F.concat(*[F.unhex(F.lpad(F.hex(F.col(c)), 8, "0")) for c in ("width", "height")])
    head = F.when(F.col("image_id") % 7 == 0, F.lit(b"\x89PNG\r\n\x1a\r")).otherwise(F.lit(b"\x89PNG\r\n\x1a\n"))
    content = F.concat(head, F.lit(b"\0\0\0\rIHDR"), size, F.lit(b"\x08\x02\0\0\0"), F.lit(b"\0\0\0\0IEND\xaeB`\x82"))
    wrong = responses.upscaled_code(content, F.col("width") + F.when(F.col("image_id") % 5 == 0, 1).otherwise(0), F.col("height"))
    p = i.select("image_id", "width", responses.png_probe(content).alias("p"), F.octet_length(content).cast("long").alias("n_bytes"), wrong.alias("wrong"))
    return p.select("image_id", F.col("p.width").alias("got_width"), F.col("p.height").alias("got_height"), "n_bytes", F.col("wrong.code").alias("code"), F.to_json("wrong.details").alias("details"))


def response_triage(spark: SparkSession, d: str) -> DataFrame:
    e = a.table(spark, d, "events")
    k = F.col("event_id") % 7  # 6 is an image as it should be
    status = F.when(k == 0, 500).otherwise(200)
    body = F.when(k == 1, F.lit('  {"detail": "CUDA Out of Memory"}')).when(k == 2, F.lit('{"detail": "busy"}')).when(k == 3, F.concat(F.lit('{"result_image": "'), F.base64(F.col("event_type").cast("binary")), F.lit('"}'))).when(k == 4, F.lit('{"result_image": "aGk"}')).otherwise(F.lit("PNG"))
    kind = F.when(k == 5, F.lit("application/JSON")).otherwise(F.lit("image/png"))
    return e.select("event_id", responses.triage(status, kind, body).alias("code"), F.decode(responses.base64_payload(body), "UTF-8").alias("payload"), responses.background_code(status, body).alias("background_code"))


def file_validation(spark: SparkSession, d: str) -> DataFrame:
    return validate.file_rules(a.files(spark, d), LIMITS).select("job_id", "idx", "bytes_before", "unsupported", "too_large", "empty", "file_code")


_FILE_RULES = f"""{a.FILES_SQL},
rb as (select *, coalesce(sum(size) over (partition by job_id order by idx rows between unbounded preceding and 1 preceding), 0)::bigint bytes_before, case when ext in ('.png', '.jpg', '.webp') then 4000 else 8000 end lim from files),
rl as (select *, least(lim, 20000 - bytes_before) least_left from rb),
fr as (
  select job_id, operation, idx, ext, size, bytes_before,
    case when operation in ('image-convert', 'upscale') and ext in ('.png', '.jpg', '.webp') or operation = 'document-convert' and ext in ('.pdf', '.docx', '.rtf') or operation = 'pdf-merge' and ext = '.pdf' then null else 'UNSUPPORTED_FORMAT' end unsupported,
    case when size > least_left then case when least(size, (floor(least_left / 1000) + 1) * 1000) > lim then 'FILE_TOO_LARGE' else 'JOB_TOO_LARGE' end end too_large, case when size = 0 then 'INVALID_FILE' end empty
  from rl)"""


def _job_rules(spark: SparkSession, d: str) -> DataFrame:
    f = a.files(spark, d).groupBy("job_id").agg(F.count("*").alias("n_files"))
    options = F.when(F.col("job_id") % 10 == 0, "[]").otherwise("{}")
    return f.select("job_id", "n_files", options.alias("options"), (F.col("job_id") % 9 != 0).alias("lease_ok"), (F.col("job_id") % 8 != 0).alias("rate_ok"))


def job_validation(spark: SparkSession, d: str) -> DataFrame:
    return validate.job_rules(_job_rules(spark, d)).select("job_id", "n_files", "job_code")


_JOB_RULES = "jr as (select job_id, count(*) n_files, case when job_id % 10 = 0 then 'INVALID_FILE' when job_id % 9 = 0 then 'ACTIVE_JOB_EXISTS' when job_id % 8 = 0 then 'RATE_LIMITED' end job_code from files group by job_id)"


def checked_files(spark: SparkSession, d: str) -> DataFrame:
    """The files, most with an extension that their operation takes, and with what their content shows, made up from the number of the document."""
    f = a.files(spark, d).withColumn("k", F.col("job_id") * 8 + F.col("idx") - 1)
    k = F.col("k")

    def one_of(*values: str) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))

    fitting = F.when(F.col("operation").isin("image-convert", "upscale"), one_of(".png", ".jpg", ".webp")).when(F.col("operation") == "pdf-merge", ".pdf").otherwise(one_of(".pdf", ".docx", ".rtf"))
    f = f.withColumn("ext", F.when(k % 29 == 0, ".xyz").otherwise(fitting))
    head = F.when(k % 17 == 0, "").when(F.col("ext") == ".pdf", "%PDF-").otherwise("{\\rtf")
    content = F.concat(head, F.coalesce("text", F.lit(""))).cast("binary")
    names = F.when(k % 23 != 0, F.array(F.when(k % 37 == 0, "mimetype").otherwise("word/document.xml")))
    width, height = F.when(k % 31 != 0, 1000 + k % 60 * 300), F.lit(6000)
    signature = validate.signature_code(F.col("ext"), content, k % 19 == 0, F.col("size") / 20, width, height, names)
    scale = F.when(k % 41 == 0, 3).when(F.col("job_id") % 3 == 0, 4).otherwise(2)
    f = f.withColumn("signature_code", signature).withColumn("upscale_code", validate.upscale_code(width, height, scale)).withColumn("content_hash", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    return validate.malware_code(f, f.where("k % 43 = 0").select(F.col("content_hash").alias("hash"))).drop("content_hash", "k")


def classify_jobs(spark: SparkSession, d: str) -> DataFrame:
    limits = validate.Limits(image=4_000, document=8_000, job=12_000, chunk=1_000)
    return validate.classify(validate.file_rules(checked_files(spark, d), limits), validate.job_rules(_job_rules(spark, d)))


_CHECKED = _FILE_RULES.replace("20000", "12000").replace("lim from files)", "lim from kf)").replace(",\nrb as", """,
kf as (select * replace (case when (job_id * 8 + idx - 1) % 29 = 0 then '.xyz' when operation in ('image-convert', 'upscale') then ['.png', '.jpg', '.webp'][(job_id * 8 + idx - 1) % 3 + 1] when operation = 'pdf-merge' then '.pdf'
  else ['.pdf', '.docx', '.rtf'][(job_id * 8 + idx - 1) % 3 + 1] end as ext), job_id * 8 + idx - 1 k, sha256(coalesce(text, '')) hash from files),
rb as""")
CLASSIFY_SQL = f"""with {_CHECKED}, {_JOB_RULES},
ck as (
  select job_id, idx,
    case when ext = '.pdf' then case when k % 17 = 0 then 'INVALID_FILE' when k % 19 = 0 then 'PDF_PASSWORD_PROTECTED' when size / 20 > 250 then 'PDF_TOO_MANY_PAGES' end
      when ext in ('.png', '.jpg', '.webp') then case when k % 31 = 0 then 'INVALID_FILE' when (1000 + k % 60 * 300) * 6000 > 100000000 then 'IMAGE_TOO_LARGE' end
      when ext = '.docx' then case when k % 23 = 0 or k % 37 = 0 then 'INVALID_FILE' end when ext = '.rtf' then case when k % 17 = 0 then 'INVALID_FILE' end end signature,
    case when operation = 'upscale' then case when k % 41 = 0 then 'INVALID_FILE' when k % 31 <> 0 and (1000 + k % 60 * 300) * 6000 * (case when job_id % 3 = 0 then 16 else 4 end) > 420000000 then 'IMAGE_TOO_LARGE' end end upscale,
    case when hash in (select hash from kf where k % 43 = 0) then 'MALWARE_DETECTED' end malware
  from kf),
al as (select fr.job_id, fr.idx, coalesce(unsupported, too_large, empty, signature, upscale, malware) code from fr join ck using (job_id, idx))
select jr.job_id, coalesce(job_code, c.code) error_code from jr left join (select job_id, arg_min(code, idx) code from al where code is not null group by 1) c on c.job_id = jr.job_id"""


WORK = ("pdf-merge", "pdf-split", "images-to-pdf", "pdf-to-images", "image-convert", "upscale")


def job_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of jobs whose files are the short documents, with an operation and options by their number."""
    f = a.files(spark, d).groupBy("job_id").agg(F.count_if(F.col("size") < 700).alias("n_files"), F.sum("size").alias("result_bytes"))
    n = F.col("job_id")
    operation = F.element_at(F.array(*map(F.lit, WORK)), (n % 6 + 1).cast("int"))
    options = F.when(n % 5 == 0, '{"margin": "wide", "format": "gif"}').when(n % 5 == 1, '{"dpi": 200, "scale": 3}').otherwise("{}")
    rejected = f.select("job_id", F.when(n % 9 == 0, "ACTIVE_JOB_EXISTS").alias("error_code"))
    return validate.outcomes(rejected, f.select("job_id", operation.alias("operation"), "n_files", options.alias("options"), "result_bytes"), validate.Limits(result=25_000))


OUTCOME_SQL = f"""with {a.FILES_SQL},
j as (select job_id, count(*) filter (where size < 700) n, sum(size) bytes, {list(WORK)}[job_id % 6 + 1] op, job_id % 5 o from files group by job_id),
w as (select *, case when op = 'pdf-merge' and n < 2 or op in ('pdf-split', 'pdf-to-images') and n <> 1 or op = 'images-to-pdf' and n < 1 then 'INVALID_FILE' end arity,
  case when op = 'images-to-pdf' and o = 0 then 'INTERNAL_ERROR' when op = 'pdf-to-images' and o = 0 or op = 'image-convert' and o = 0 or op = 'upscale' and o = 0 then 'UNSUPPORTED_FORMAT' when op in ('pdf-to-images', 'upscale') and o = 1 then 'INVALID_FILE' end unusable from j),
c as (select job_id, case when job_id % 9 = 0 then 'ACTIVE_JOB_EXISTS' end rejected, coalesce(case when op = 'images-to-pdf' then unusable end, arity, unusable, case when bytes > 25000 then 'RESULT_TOO_LARGE' end) work from w)
select job_id, case when rejected is not null then 'rejected' when work is not null then 'failed' else 'succeeded' end status, coalesce(rejected, work) error_code from c"""


def document_gates(spark: SparkSession, d: str) -> DataFrame:
    """Signature, page, pixel and text rules over documents, whose texts stand for the files' bytes."""
    f = a.table(spark, d, "documents")
    content = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("%PDF-"), F.col("text"))).otherwise(F.concat(F.lit("  {\\rtf"), F.col("text"))).cast("binary")
    pdf = validate.pdf_code(content, F.col("doc_id") % 5 == 0, F.col("n_chars") / 10)
    ext = F.when(F.col("doc_id") % 3 == 0, ".rtf").otherwise(".doc")
    names = F.when(F.col("doc_id") % 4 != 0, F.array(F.when(F.col("doc_id") % 4 == 1, "mimetype").otherwise("word/document.xml")))
    return f.select("doc_id", pdf.alias("pdf_code"), validate.magic_code(ext, content).alias("magic_code"), validate.archive_code(F.lit(".docx"), names).alias("zip_code"), validate.result_code(F.col("n_chars"), validate.Limits(result=5000)).alias("result_code"))


GATE_SQL = """select doc_id, case when doc_id % 2 <> 0 then 'INVALID_FILE' when doc_id % 5 = 0 then 'PDF_PASSWORD_PROTECTED' when n_chars / 10 > 250 then 'PDF_TOO_MANY_PAGES' end pdf_code,
  case when doc_id % 3 = 0 and doc_id % 2 <> 0 then null else 'INVALID_FILE' end magic_code, case when doc_id % 4 in (0, 1) then 'INVALID_FILE' end zip_code, case when n_chars > 5000 then 'RESULT_TOO_LARGE' end result_code from documents"""


def image_gates(spark: SparkSession, d: str) -> DataFrame:
    w, h, s = F.col("width"), F.col("height"), F.col("scale")
    arity = validate.arity_code(F.element_at(F.array(F.lit("pdf-merge"), F.lit("pdf-split"), F.lit("images-to-pdf")), (F.col("image_id") % 3 + 1).cast("int")), F.col("image_id") % 4)
    return a.images(spark, d).select("image_id", validate.image_code(w, h).alias("image_code"), validate.upscale_code(w, h, s).alias("upscale_code"), arity.alias("arity_code"), validate.count_code(F.col("image_id") % 25).alias("count_code"), F.to_json(validate.upscale_details(w, h, s)).alias("details"))


IMAGE_GATE_SQL = f"""with {a.IMAGES_SQL}
select image_id, case when width * height > 100000000 then 'IMAGE_TOO_LARGE' end image_code, case when width * height * scale * scale > 420000000 then 'IMAGE_TOO_LARGE' end upscale_code,
  case when image_id % 3 = 0 and image_id % 4 < 2 or image_id % 3 = 1 and image_id % 4 <> 1 or image_id % 3 = 2 and image_id % 4 < 1 then 'INVALID_FILE' end arity_code,
  case when image_id % 25 = 0 then 'INVALID_FILE' when image_id % 25 > 20 then 'TOO_MANY_FILES' end count_code,
  '{{"width":' || width || ',"height":' || height || ',"scale":' || scale || ',"maxOutputPixels":420000000}}' details
from images"""


def malware(spark: SparkSession, d: str) -> DataFrame:
    docs = a.table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("content_hash"))
    known = a.table(spark, d, "benchmark").select(F.sha2(F.col("text").cast("binary"), 256).alias("hash")).union(docs.where("doc_id % 97 = 0").select("content_hash"))
    return validate.malware_code(docs, known).select("doc_id", "malware_code")


def malware_scanners(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts where each fifth file met no scanner, required and not."""
    docs = a.table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("content_hash"), (F.col("doc_id") % 5 != 0).alias("scanner_up"))
    known = docs.where("doc_id % 97 = 0").select(F.col("content_hash").alias("hash"))
    out = validate.scanned_code(docs, known).withColumnRenamed("malware_code", "required_code")
    return validate.scanned_code(out, known, required=False).select("doc_id", "required_code", F.col("malware_code").alias("optional_code"))


def text_layer(spark: SparkSession, d: str) -> DataFrame:
    return pages.text_layer(a.pages(spark, d))


TEXT_LAYER_SQL = rf"""with {a.PAGES_SQL}, n as (select doc_id, length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) n from pdf_pages),
t as (select doc_id, count(*) n_pages, sum(n)::bigint chars, count(*) filter (where n >= 20) pages_with_text from n group by doc_id)
select *, chars >= 50 and pages_with_text >= greatest(1, (n_pages + 1) // 2) has_text from t"""


def text_gate(spark: SparkSession, d: str) -> DataFrame:
    docs = a.page_ranges(spark, d).select("doc_id")
    return validate.text_gate(docs, pages.text_layer(a.pages(spark, d))).select("doc_id", "error_code")


def merge_pages(spark: SparkSession, d: str) -> DataFrame:
    members = a.page_ranges(spark, d).select(F.floor(F.col("doc_id") / 3).alias("job_id"), (F.col("doc_id") % 3).alias("file_idx"), "doc_id")
    return pages.merge(a.pages(spark, d), members)


def split_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages.split(a.pages(spark, d), a.page_ranges(spark, d))[0]


_RANGES = f"""{a.RANGES_SQL},
part as (select doc_id, page_count, unnest(ranges.string_split(',')) x, unnest(range(1, len(ranges.string_split(',')) + 1)) i from page_ranges),
trimmed as (select doc_id, page_count, i, trim(x) x from part where trim(x) <> ''),
pr as (select *, row_number() over (partition by doc_id order by i) part, split_part(x, '-', 1)::bigint f, case when x like '%-%' then split_part(x, '-', 2)::bigint else x::bigint end l from trimmed),
good as (select doc_id from pr group by doc_id having bool_and(f >= 1 and l >= f and l <= page_count))"""


def bad_ranges(spark: SparkSession, d: str) -> DataFrame:
    return pages.split(a.pages(spark, d), a.page_ranges(spark, d))[1]


def page_range_function(spark: SparkSession, d: str) -> DataFrame:
    pages.register_page_ranges(spark)
    return spark.sql("select * from page_ranges(table(select doc_id, ranges, page_count from {asked}))", asked=a.page_ranges(spark, d))


def expired_jobs(spark: SparkSession, d: str) -> DataFrame:
    j = a.jobs(spark, d).select("job_id", scalars.expires(F.col("accepted_at")).alias("expires_at"))
    records = a.jobs(spark, d).where(F.col("job_id").cast("long") % 10 != 0).select("job_id", "status")
    return retention.expired_records(j, records, NOW).select("job_id", iso(F.col("expires_at")).alias("expires_at"), "status")


def orphan_directories(spark: SparkSession, d: str) -> DataFrame:
    records = a.jobs(spark, d).where(F.col("job_id").cast("long") % 10 != 0).select("job_id", "status")
    return retention.orphans(a.directories(spark, d), records, NOW).select("job_id", "status")


def orphan_folders(spark: SparkSession, d: str) -> DataFrame:
    """The texts of documents as files in a folder for each of their jobs, listed as they lie there; a job in four has no record, the others have one by their number."""
    docs = a.table(spark, d, "documents")
    job = F.floor(F.col("doc_id") / 64)
    path = scratch_path(spark, "jobs")
    docs.select(F.concat(F.lit("job"), job.cast("string")).alias("job"), F.coalesce("text", F.lit("")).alias("value")).repartition("job").write.partitionBy("job").option("lineSep", "\u0003").text(path)
    found = directories.job_directories(directories.list_tree(spark, path, folders=50).where("folder like 'job=%'"))
    number = F.regexp_extract("job_id", r"job=job(\d+)$", 1).cast("long")
    records = docs.select(job.alias("n")).where("n % 4 <> 0").distinct().select(F.concat(F.lit("job=job"), F.col("n").cast("string")).alias("job_id"), F.when(F.col("n") % 4 == 1, "failed").otherwise("running").alias("status"))
    return retention.orphans(found, records, "2100-01-01").select(number.alias("job"), "n_bytes", "status")


def image_source(spark: SparkSession, d: str) -> DataFrame:
    """PNG files made of part, some cut short, read back as images: their size, or the code of a file that can't be read."""
    p = a.table(spark, d, "part")
    height = (F.col("p_partkey") % 40 + 1).cast("int")
    folder = F.floor(F.col("p_partkey") / 1000).cast("string")
    made = p.select(F.concat(folder, F.lit("/p"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("name"), sources.png_content(F.col("p_size").cast("int"), height).alias("content"))
    number = F.regexp_extract("name", r"p(\d+)", 1).cast("long")
    made = made.withColumn("content", F.when(number % 7 == 0, F.substring("content", 1, 20)).otherwise(F.col("content")))
    path = scratch_path(spark, "images")
    sources.write_files(made, path)
    found = sources.image_dimensions(spark, path)
    return found.select(F.regexp_extract("path", r"p(\d+)\.png$", 1).cast("long").alias("p_partkey"), "width", "height", "channels", "code")


def removal_plan(spark: SparkSession, d: str) -> DataFrame:
    return retention.removal_plan(a.jobs(spark, d), NOW)


def live_workers(spark: SparkSession, d: str) -> DataFrame:
    beats = a.table(spark, d, "events").select(F.col("user_id").alias("worker_id"), F.col("ts").cast("timestamp").alias("ts"))
    return retention.workers(beats, "2024-01-20", 6 * 3600).select("worker_id", F.unix_micros("last_beat").alias("last_us"), "alive")


def live_status(spark: SparkSession, d: str) -> DataFrame:
    beats = a.table(spark, d, "events").select(F.col("user_id").alias("worker_id"), F.col("ts").cast("timestamp").alias("ts"))
    return retention.status(retention.workers(beats, "2024-01-20", 6 * 3600))


def live_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Users as workers, their events as beats, errors as probes."""
    e = a.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    k = F.col("event_id")
    probes = e.where("event_type = 'error'").select(k.alias("probe_id"), "ts", (k % 11 != 0).alias("store_ok"), (k % 13 != 0).alias("scanner_ok"), (k % 10 * 50 * 2**20).cast("long").alias("free_bytes"))
    return retention.snapshots(e.select(F.col("user_id").alias("worker_id"), "ts"), probes, 6 * 3600, 8)


def first_files(spark: SparkSession, d: str) -> DataFrame:
    return retention.first_files(a.files(spark, d), 3).select("job_id", "idx", "ordinal")


def _reverse(name: str, content: bytes) -> list[tuple[str, bytes]]:
    if len(content) < 200:
        raise sources.JobError("INVALID_FILE")
    return [(f"{name}.rev", content[::-1])]


def _transformed(spark: SparkSession, d: str) -> DataFrame:
    f = a.files(spark, d).select("job_id", "idx", F.concat(F.lit("f"), F.col("idx").cast("string")).alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return sources.transform_files(f, _reverse)


def transform_files(spark: SparkSession, d: str) -> DataFrame:
    return _transformed(spark, d).select("job_id", "idx", "name", F.octet_length("content").cast("long").alias("n_bytes"), "error_code")


def transform_states(spark: SparkSession, d: str) -> DataFrame:
    return sources.job_states(_transformed(spark, d)).select("job_id", "status", "error_code")


def transform_events(spark: SparkSession, d: str) -> DataFrame:
    return sources.transform_events(_transformed(spark, d)).select("job_id", "kind", "seq", "result_bytes", "status", "error_code")


def archives(spark: SparkSession, d: str) -> DataFrame:
    out = sources.archive(_transformed(spark, d))
    names = sources.zip_entries(F.col("content"))
    return out.select("job_id", "result_name", "n_bytes", "n_entries", F.array_join(names, ",").alias("entries"))


def corpus_scan(spark: SparkSession, d: str) -> DataFrame:
    """The texts of documents as a corpus of files in the shared folder, scanned with their content: per language and extension, files, bytes and lines."""
    ext = F.when(F.col("doc_id") % 2 == 0, "txt").otherwise("md")
    docs = a.table(spark, d, "documents").select(F.coalesce("lang", F.lit("none")).alias("lang"), ext.alias("ext"), F.coalesce(F.col("text"), F.lit("")).alias("value"))
    folder = scratch_path(spark, "corpus")
    for kind in ("txt", "md"):
        docs.where(F.col("ext") == kind).select("lang", "value").write.partitionBy("lang").option("maxRecordsPerFile", 10_000).option("lineSep", "\u0003").text(f"{folder}/{kind}")
    out = sources.scan(spark, folder, content=True).where("size > 0")
    found = out.select(F.regexp_extract("path", r"/(txt|md)/lang=", 1).alias("ext"), F.regexp_extract("path", r"lang=([^/]+)/", 1).alias("lang"), "size", F.decode("content", "UTF-8").alias("content"))
    texts = F.size(F.split("content", "\u0003")) - 1
    return found.groupBy("ext", "lang").agg(F.sum(texts).alias("n"), F.sum(F.col("size") - texts).alias("bytes"))


QUERIES = {f.__name__: f for f in (
    rate_limit, lease_limit, admission_replay, client_addresses, record_views, record_files, option_values, file_names, output_names, job_eta, image_geometry, png_probe,
    response_triage, file_validation, job_validation, classify_jobs, document_gates, image_gates, malware, malware_scanners, text_layer, text_gate, merge_pages, split_pages, bad_ranges,
    page_range_function, expired_jobs, orphan_directories, removal_plan, live_workers, live_status, live_snapshots, first_files, transform_files, transform_states, transform_events, archives, corpus_scan, orphan_folders, image_source, job_outcomes,
)}

_REV = f"""{a.FILES_SQL}, tf as (select job_id, idx, octet_length(encode(coalesce(text, ''))) n from files)"""
SQL = {
    "rate_limit": RATE_SQL,
    "lease_limit": LEASE_SQL,
    "admission_replay": REPLAY_SQL,
    "client_addresses": "select event_id, case when event_id % 3 = 0 then '10.0.0.' || (user_id % 256) when event_id % 2 = 0 then 'host' || user_id else 'unknown' end client, case when event_type in ('view', 'click') then 'ai' else 'local' end route from events",
    "record_views": f"with {a.JOBS_SQL} select job_id, operation, status, 0 progress, case when job_id::bigint % 3 = 0 then file_count else 0 end::int total, error_code code, case when error_code = 'TIMEOUT' then 'too slow' when error_code is not null then '' end message from jobs",
    "record_files": f"with {a.FILES_SQL} select job_id, row_number() over (partition by job_id order by idx)::int ordinal, original, case ext when '.png' then 'image/png' when '.jpg' then 'image/jpeg' when '.webp' then 'image/webp' when '.pdf' then 'application/pdf' when '.docx' then 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' else 'application/octet-stream' end content_type, size from files",
    "option_values": OPTION_SQL,
    "file_names": FILE_NAME_SQL,
    "output_names": OUTPUT_NAME_SQL,
    "job_eta": ETA_SQL,
    "image_geometry": GEOMETRY_SQL,
    "png_probe": f"with {a.IMAGES_SQL} select image_id, case when image_id % 7 <> 0 then width end got_width, case when image_id % 7 <> 0 then height end got_height, 41::bigint n_bytes, case when image_id % 7 = 0 or image_id % 5 = 0 then 'UPSTREAM_ERROR' end code, case when image_id % 7 <> 0 and image_id % 5 = 0 then '{{\"expected\":[' || (width + 1) || ',' || height || '],\"actual\":[' || width || ',' || height || ']}}' end details from images",
    "response_triage": "select event_id, case event_id % 7 when 6 then null when 1 then 'IMAGE_TOO_LARGE' else 'UPSTREAM_ERROR' end code, case when event_id % 7 = 3 then event_type end payload, case when event_id % 7 <> 3 then 'UPSTREAM_ERROR' end background_code from events",
    "file_validation": f"with {_FILE_RULES} select job_id, idx, bytes_before, unsupported, too_large, empty, coalesce(unsupported, too_large, empty) file_code from fr",
    "job_validation": f"with {a.FILES_SQL}, {_JOB_RULES} select * from jr",
    "classify_jobs": CLASSIFY_SQL,
    "job_outcomes": OUTCOME_SQL,
    "corpus_scan": "select case when doc_id % 2 = 0 then 'txt' else 'md' end ext, coalesce(lang, 'none') lang, count(*) n, sum(octet_length(encode(coalesce(text, ''))))::bigint bytes from documents group by 1, 2",
    "document_gates": GATE_SQL,
    "image_gates": IMAGE_GATE_SQL,
    "malware": "with h as (select doc_id, sha256(coalesce(text, '')) h from documents) select doc_id, case when h in (select sha256(text) from benchmark union all select h from h where doc_id % 97 = 0) then 'MALWARE_DETECTED' end malware_code from h",
    "malware_scanners": "with h as (select doc_id, sha256(coalesce(text, '')) h from documents), v as (select doc_id, case when h in (select h from h where doc_id % 97 = 0) then 'MALWARE_DETECTED' end c from h) select doc_id, case when doc_id % 5 = 0 then 'SCANNER_UNAVAILABLE' else c end required_code, case when doc_id % 5 <> 0 then c end optional_code from v",
    "text_layer": TEXT_LAYER_SQL,
    "text_gate": f"select doc_id, case when not has_text then 'PDF_NO_TEXT_LAYER' end error_code from ({TEXT_LAYER_SQL})",
    "merge_pages": f"with {a.PAGES_SQL} select doc_id // 3 job_id, doc_id, page_no, row_number() over (partition by doc_id // 3 order by doc_id % 3, page_no)::int new_page from pdf_pages",
    "split_pages": f"with {_RANGES} select pr.doc_id, part::int part, f - 1 as first, l - 1 as last, page_no from pr join good using (doc_id) join pdf_pages p on p.doc_id = pr.doc_id and page_no between f and l",
    "bad_ranges": f"with {_RANGES} select doc_id, 'INVALID_FILE' error_code from page_ranges anti join good using (doc_id)",
    "page_range_function": f"with {_RANGES} select pr.doc_id, f - 1 as first, l - 1 as last from pr join good using (doc_id)",
    "expired_jobs": f"with {a.JOBS_SQL} select job_id, strftime(accepted_at + interval 1 hour, '%Y-%m-%dT%H:%M:%SZ') expires_at, case when job_id::bigint % 10 <> 0 then status end status from jobs where accepted_at + interval 1 hour <= timestamp '{NOW}' order by accepted_at, job_id limit 100",
    "orphan_directories": f"with {a.JOBS_SQL} select job_id, case when job_id::bigint % 10 <> 0 then status end status from jobs where accepted_at < timestamp '{NOW}' - interval 2 hour and (job_id::bigint % 10 = 0 or status <> 'queued')",
    "orphan_folders": "select doc_id // 64 job, (sum(octet_length(encode(coalesce(text, ''))) + 1))::bigint n_bytes, case doc_id // 64 % 4 when 1 then 'failed' end status from documents where doc_id // 64 % 4 < 2 group by 1",
    "image_source": "select p_partkey, case when p_partkey % 7 <> 0 then p_size end::int width, case when p_partkey % 7 <> 0 then (p_partkey % 40 + 1)::int end height, case when p_partkey % 7 <> 0 then 3 end channels, case when p_partkey % 7 = 0 then 'INVALID_FILE' end code from part",
    "removal_plan": f"with {a.JOBS_SQL} select job_id, 'inputs' kind from jobs where status <> 'queued' union all select job_id, 'result' from jobs where accepted_at + interval 1 hour <= timestamp '{NOW}' union all select job_id, 'record' from jobs where accepted_at + interval 2 hour <= timestamp '{NOW}'",
    "live_workers": "select user_id worker_id, epoch_us(max(ts)) last_us, epoch_us(timestamp '2024-01-20') - epoch_us(max(ts)) < 21600000000 alive from events where ts <= timestamp '2024-01-20' group by 1",
    "live_status": "with w as (select user_id, epoch_us(timestamp '2024-01-20') - epoch_us(max(ts)) < 21600000000 alive from events where ts <= timestamp '2024-01-20' group by 1), n as (select count(*) filter (where alive) workers from w) select workers, 4 expected, 262144001::bigint free_bytes, case when workers >= 4 then 'ok' else 'degraded' end status from n",
    "live_snapshots": """with p as (select event_id probe_id, ts, event_id % 11 <> 0 and event_id % 13 <> 0 up, (event_id % 10 * 50 * 1048576)::bigint free_bytes from events where event_type = 'error'),
c as (select probe_id, count(distinct user_id) workers from p join events e on e.ts <= p.ts and e.ts > p.ts - interval 6 hour group by 1)
select probe_id, workers, 8 expected, free_bytes, case when up and workers >= 8 and free_bytes > 262144000 then 'ok' else 'degraded' end status from p join c using (probe_id)""",
    "first_files": f"with {a.FILES_SQL} select job_id, idx, ordinal from (select job_id, idx, row_number() over (partition by job_id order by idx)::int ordinal from files) where ordinal <= 3",
    "transform_files": f"with {_REV} select job_id, idx, case when n >= 200 then 'f' || idx || '.rev' end as name, case when n >= 200 then n end n_bytes, case when n < 200 then 'INVALID_FILE' end error_code from tf",
    "transform_states": f"with {_REV} select job_id, case when min(n) < 200 then 'failed' else 'succeeded' end status, case when min(n) < 200 then 'INVALID_FILE' end error_code from tf group by 1",
    "transform_events": f"with {_REV}, j as (select job_id::varchar job_id, min(n) < 200 bad, sum(n)::bigint n from tf group by 1) select job_id, 'started' kind, 2::bigint seq, null::bigint result_bytes, null status, null error_code from j union all select job_id, 'terminal', 3, case when bad then 0 else n end, case when bad then 'failed' else 'succeeded' end, case when bad then 'INVALID_FILE' end from j",
    "archives": f"with {_REV} select job_id, case when count(*) = 1 then 'f' || min(idx) || '.rev' else 'results.zip' end result_name, sum(n)::bigint n_bytes, count(*) n_entries, case when count(*) > 1 then string_agg('f' || idx || '.rev', ',' order by idx) end entries from tf where n >= 200 group by job_id",
}
