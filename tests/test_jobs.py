"""Admission, validation, files, pages and lifetimes, with known values."""

import io
import struct
import zipfile
import zlib
from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from jobscope.functions import geometry, responses, scalars
from jobscope.operators import admission, pages, retention, validate
from jobscope.schema import PAGES
from jobscope.sources import files
from jobscope.streaming import operators as streams

T0 = datetime(2026, 1, 1, tzinfo=UTC)


def png(w, h):
    def part(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + b"\x10\x20\x30" * w for _ in range(h))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).collect()[0]


def test_leases(spark):
    kinds = [("1", "reserve"), ("2", "reserve"), ("3", "reserve"), ("4", "reserve"), ("2", "release"), ("4", "reserve")]
    events = [(9, j, k, T0 + timedelta(seconds=n), n) for n, (j, k) in enumerate(kinds)]
    got = admission.leases(spark.createDataFrame(events, "client long, job_id string, kind string, ts timestamp, seq long")).orderBy("seq").collect()
    assert [x.accepted for x in got] == [True, True, True, False, True, True]


def test_rate(spark):
    rows = [(1, "ai", 15, T0, 0), (1, "ai", 6, T0, 1), (1, "ai", 5, T0 + timedelta(seconds=5), 2), (1, "local", 60, T0, 3), (1, "ai", 15, T0 + timedelta(seconds=3600), 4), (1, "ai", 6, T0 + timedelta(seconds=3604), 5), (2, "ai", 21, T0, 6)]
    df = spark.createDataFrame(rows, "client long, class string, units long, ts timestamp, seq long")
    assert [x.accepted for x in admission.rate_limit(df).orderBy("seq").collect()] == [True, False, True, True, True, False, False]


def test_admission_gives_the_lease_back(spark):
    rows = [(1, "ai", 20, T0, 0), (1, "ai", 1, T0, 1), (1, "local", 1, T0, 2), (1, "local", 1, T0, 3), (1, "local", 1, T0, 4)]
    df = spark.createDataFrame(rows, "client long, class string, units long, ts timestamp, seq long")
    assert [x.accepted for x in admission.admission_replay(df).orderBy("seq").collect()] == [True, False, True, True, False]


def test_page_ranges(spark):
    got = one(spark, a=scalars.page_ranges(F.lit("1-3, 5, 8-10"), F.lit(10)), b=scalars.page_ranges(F.lit("0-2"), F.lit(10)), c=scalars.page_ranges(F.lit(" , "), F.lit(3)), d=scalars.page_ranges(F.lit("2-1"), F.lit(3)), e=scalars.page_ranges(F.lit("1,1"), F.lit(1)))
    assert [tuple(x) for x in got.a] == [(0, 2), (4, 4), (7, 9)] and got.b is None and got.c is None and got.d is None and len(got.e) == 2


def test_pages(spark):
    rows = [(1, 1, "", 595.0, 842.0), (1, 2, None, 595.0, 842.0), (2, 1, "x" * 60, 595.0, 842.0), (3, 1, "y" * 25, 1.0, 1.0), (3, 2, "y" * 25, 1.0, 1.0), (3, 3, " ", 1.0, 1.0)]
    p = spark.createDataFrame(rows, PAGES)
    assert {x.doc_id: x.has_text for x in pages.text_layer(p).collect()} == {1: False, 2: True, 3: True}
    members = spark.createDataFrame([("j", 1, 1), ("j", 2, 2)], "job_id string, file_idx int, doc_id long")
    assert [(x.doc_id, x.new_page) for x in pages.merge(p, members).orderBy("new_page").collect()] == [(1, 1), (1, 2), (2, 3)]
    got, bad = pages.split(p, spark.createDataFrame([(3, "1-2,3", 3), (1, "9", 2)], "doc_id long, ranges string, page_count int"))
    assert sorted((x.part, x.page_no) for x in got.collect()) == [(1, 1), (1, 2), (2, 3)] and [x.doc_id for x in bad.collect()] == [1]
    gated = validate.text_gate(p.select("doc_id").distinct(), pages.text_layer(p)).collect()
    assert {x.doc_id: x.error_code for x in gated}[1] == "PDF_NO_TEXT_LAYER"


def test_options_as_the_service_reads_them(spark):
    def read(options, operation):
        return one(spark, **scalars.option_columns(F.lit(options), F.lit(operation)))

    assert read('{"format": "png", "quality": "bad"}', "upscale").options_error is None  # a PNG isn't written anew
    assert read('{"format": "webp", "quality": "bad"}', "upscale").options_error == "INTERNAL_ERROR"
    assert read('{"quality": "bad"}', "remove-background").options_error is None
    assert read('{"quality": "bad", "format": "WEBP"}', "remove-background").options_error == "INTERNAL_ERROR"
    assert read('{"quality": null}', "image-convert").options_error == "INTERNAL_ERROR"
    assert read('{"scale": "x"}', "upscale").options_error == read('{"scale": null}', "upscale").options_error == "INVALID_FILE"
    assert [read(x, "pdf-split").mode for x in ("{}", '{"mode": "each"}', '{"mode": "EACH"}')] == ["ranges", "each", "ranges"]
    x = read('{"pageSize": "Original", "orientation": "Landscape", "maxWidth": null, "maxHeight": ""}', "images-to-pdf")
    assert (x.page_size, x.orientation, x.max_width, x.max_height) == ("Original", "Landscape", 0, 0)


def test_geometry_of_thin_and_of_whole_pages(spark):
    g = one(spark, thin=geometry.thumbnail(F.lit(8108), F.lit(100), F.lit(120), F.lit(0)), same=geometry.thumbnail(F.lit(50), F.lit(40), F.lit(120), F.lit(90)), tall=geometry.thumbnail(F.lit(100), F.lit(1000), F.lit(0), F.lit(333)), own=geometry.page_layout(F.lit(320), F.lit(180), F.lit("original"), F.lit("auto"), F.lit(10)))
    assert tuple(g.thin) == (120, 2) and tuple(g.same) == (50, 40) and tuple(g.tall) == (33, 333) and tuple(g.own) == (320, 180, 320, 180, 0, 0)


def test_responses_of_both_models(spark):
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (360).to_bytes(4, "big") + b"\x08\x02\0\0\0\0\0\0\0IEND\xaeB`\x82"
    ok, other, broken = (responses.upscaled_code(F.lit(x), F.lit(w), F.lit(360)) for x, w in ((png, 640), (png, 1280), (b"x" * 64, 640)))
    got = one(spark, ok=ok, other=other, broken=broken, teapot=responses.background_code(F.lit(418), F.lit('{"result_image": "aGk="}')), fine=responses.background_code(F.lit(200), F.lit('{"result_image": "aGk="}')))
    assert got.ok is None and got.other.code == got.broken.code == got.teapot == "UPSTREAM_ERROR" and got.fine is None
    assert got.other.details.expected == [1280, 360] and got.other.details.actual == [640, 360] and got.broken.details is None


def test_every_code_of_the_classification(spark):
    from jobscope.plans import job_queries

    codes = {x.error_code for d in ("sf0.01", "sf0.1") for x in job_queries.classify_jobs(spark, f"/root/testdata/{d}").select("error_code").distinct().collect()}
    assert codes >= {None, "INVALID_FILE", "ACTIVE_JOB_EXISTS", "RATE_LIMITED", "UNSUPPORTED_FORMAT", "FILE_TOO_LARGE", "JOB_TOO_LARGE", "PDF_PASSWORD_PROTECTED", "PDF_TOO_MANY_PAGES", "IMAGE_TOO_LARGE", "MALWARE_DETECTED"}


def test_rules_of_content_come_in_order(spark):
    rows = [(1, "upscale", 1, ".png", 10, None, "IMAGE_TOO_LARGE", "MALWARE_DETECTED"), (2, "pdf-merge", 1, ".pdf", 10, None, "IMAGE_TOO_LARGE", "MALWARE_DETECTED"), (3, "pdf-merge", 1, ".pdf", 0, "PDF_TOO_MANY_PAGES", None, None), (4, "pdf-merge", 1, ".pdf", 5, "PDF_TOO_MANY_PAGES", None, "MALWARE_DETECTED")]
    f = spark.createDataFrame(rows, "job_id long, operation string, idx int, ext string, size long, signature_code string, upscale_code string, malware_code string")
    assert {x.job_id: x.file_code for x in validate.file_rules(f).collect()} == {1: "IMAGE_TOO_LARGE", 2: "MALWARE_DETECTED", 3: "INVALID_FILE", 4: "PDF_TOO_MANY_PAGES"}
    down = validate.malware_code(f.drop("malware_code"), None, scanner_up=False)
    assert {x.malware_code for x in down.collect()} == {"SCANNER_UNAVAILABLE"} and {x.malware_code for x in validate.malware_code(f.drop("malware_code"), None, False, False).collect()} == {None}


def test_names_and_options(spark):
    got = one(
        spark, stem=scalars.clean_stem(F.lit("a/b/My  file (1).tar.gz")), dot=scalars.clean_stem(F.lit(".hidden")), none=scalars.clean_stem(F.lit("...")), safe=scalars.sanitize(F.lit("x/é*?.pdf"), F.lit(".pdf")), empty=scalars.sanitize(F.lit(None).cast("string"), F.lit(".pdf")),
        eta=scalars.eta(F.lit("remove-background"), F.lit(2), F.lit(2), F.lit(0)), ok=scalars.options_valid(F.lit('{"a": 1}')), array=scalars.options_valid(F.lit("[1]")), missing=scalars.options_valid(F.lit(None).cast("string")),
        page=scalars.output_name(F.lit("pdf-to-images"), F.lit("s"), F.lit(1234), F.lit(".png"), F.lit(0), F.lit(0)),
    )
    assert (got.stem, got.dot, got.none, got.safe, got.empty, got.eta) == ("My_file_1_.tar", "hidden", "result", "é__.pdf", "file.pdf", 120)
    assert got.ok and not got.array and not got.missing and got.page == "page-1234.png"


def test_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(320, 180))
    (tmp_path / "b.txt").write_bytes(b"no image")
    dims = {x.path[-5:]: (x.width, x.height) for x in files.image_dimensions(spark, str(tmp_path / "*.png")).collect()}
    assert dims == {"a.png": (320, 180)}
    got = files.scan(spark, str(tmp_path), content=True).withColumn("p", responses.png_probe(F.col("content"))).collect()
    assert {x.ext: tuple(x.p) if x.p else None for x in got} == {".png": (320, 180), ".txt": None}
    g = one(spark, t=geometry.thumbnail(F.lit(320), F.lit(180), F.lit(120), F.lit(0)), u=validate.upscale_code(F.lit(1280), F.lit(720), F.lit(4)), big=validate.upscale_code(F.lit(12800), F.lit(7200), F.lit(4)), a=geometry.a4_layout(F.lit(320), F.lit(180), F.lit("auto"), F.lit(10)))
    assert g.t.width == 120 and g.u is None and g.big == "IMAGE_TOO_LARGE" and g.a.page_width == 1754
    r = one(spark, oom=responses.triage(F.lit(200), F.lit("application/json"), F.lit('{"detail": "CUDA out of memory"}')), ok=responses.triage(F.lit(200), F.lit("image/png"), F.lit("\x89PNG")), b=responses.base64_payload(F.lit('{"result_image": "aGk"}')), c=responses.base64_payload(F.lit('{"result_image": "aGk="}')))
    assert r.oom == "IMAGE_TOO_LARGE" and r.ok is None and r.b is None and bytes(r.c) == b"hi"


def test_size_rule_agrees_with_a_loop(spark):
    import random

    r = random.Random(1)
    rows = [(r.randint(0, 60), r.randint(0, 50), r.randint(-5, 50)) for _ in range(2000)]

    def loop(size, limit, left, chunk=7):
        seen = 0
        while seen < size:
            seen = min(size, seen + chunk)
            if seen > limit:
                return "FILE_TOO_LARGE"
            if seen > left:
                return "JOB_TOO_LARGE"
        return None

    got = spark.createDataFrame(rows, "s long, l long, r long").where("r >= 0").select("s", "l", "r", validate.size_code(F.col("s"), F.col("l"), F.col("r"), 7).alias("c")).collect()
    assert all(x.c == loop(x.s, x.l, x.r) for x in got)


def test_classification_takes_the_first_failure(spark):
    f = spark.createDataFrame([(1, "upscale", 1, ".png", 5), (1, "upscale", 2, ".pdf", 5), (2, "upscale", 1, ".pdf", 0), (3, "upscale", 1, ".png", 0)], "job_id long, operation string, idx int, ext string, size long")
    j = spark.createDataFrame([(1, 2, "{}", True, True), (2, 1, "[]", True, True), (3, 1, "{}", True, True), (4, 0, None, True, True)], "job_id long, n_files long, options string, lease_ok boolean, rate_ok boolean")
    got = {x.job_id: x.error_code for x in validate.classify(validate.file_rules(f), validate.job_rules(j)).collect()}
    assert got == {1: "UNSUPPORTED_FORMAT", 2: "INVALID_FILE", 3: "INVALID_FILE", 4: "INVALID_FILE"}


def test_outcomes_of_jobs(spark):
    jobs = [("a", "pdf-merge", 1, "{}", 5), ("b", "pdf-merge", 2, "{}", 5), ("c", "pdf-split", 2, "{}", 5), ("d", "images-to-pdf", 0, '{"margin": "x"}', 5), ("e", "images-to-pdf", 0, "{}", 5), ("f", "pdf-to-images", 3, '{"dpi": 7}', 5), ("g", "pdf-to-images", 1, '{"dpi": 7}', 5),
            ("h", "image-convert", 1, "{}", 101), ("i", "image-convert", 1, "{}", 100), ("j", "pdf-merge", 1, "{}", 500)]
    classified = spark.createDataFrame([("i", None), ("j", "RATE_LIMITED")], "job_id string, error_code string")
    got = validate.outcomes(classified, spark.createDataFrame(jobs, "job_id string, operation string, n_files long, options string, result_bytes long"), validate.Limits(result=100))
    failed = {"a": "INVALID_FILE", "c": "INVALID_FILE", "d": "INTERNAL_ERROR", "e": "INVALID_FILE", "f": "INVALID_FILE", "g": "INVALID_FILE", "h": "RESULT_TOO_LARGE"}
    assert {x.job_id: (x.status, x.error_code) for x in got.collect()} == {k: ("failed", v) for k, v in failed.items()} | {"b": ("succeeded", None), "i": ("succeeded", None), "j": ("rejected", "RATE_LIMITED")}


def test_transforming_and_packing(spark):
    def fn(name, content):
        if content == b"bad":
            raise files.JobError("INVALID_FILE")
        if content == b"odd":
            raise ValueError
        return [(f"{name}{k}", content * k) for k in (1, 2)] if name == "two" else [(name, content)]

    rows = [(1, 1, "a", b"x"), (2, 1, "a", b"bad"), (2, 2, "b", b"odd"), (3, 1, "two", b"y")]
    out = files.transform_files(spark.createDataFrame(rows, "job_id long, idx int, name string, content binary"), fn)
    states = {x.job_id: (x.status, x.error_code) for x in files.job_states(out).collect()}
    assert states == {1: ("succeeded", None), 2: ("failed", "INVALID_FILE"), 3: ("succeeded", None)}
    packed = {x.job_id: x for x in files.archive(out).collect()}
    assert packed[1].result_name == "a" and bytes(packed[1].content) == b"x"
    assert zipfile.ZipFile(io.BytesIO(packed[3].content)).namelist() == ["two1", "two2"]
    names = files.archive(out).select("job_id", files.zip_entries(F.col("content")).alias("n")).collect()
    assert {x.job_id: x.n for x in names} == {1: None, 3: ["two1", "two2"]}


def test_lifetimes(spark):
    jobs = spark.createDataFrame([("a", T0), ("b", T0 - timedelta(hours=1)), ("c", T0 + timedelta(hours=1))], "job_id string, expires_at timestamp")
    assert [x.job_id for x in retention.expired(jobs, "2026-01-01").collect()] == ["b", "a"]
    d = spark.createDataFrame([("a", T0), ("b", T0), ("c", T0), ("d", T0 + timedelta(hours=9))], "job_id string, mtime timestamp")
    r = spark.createDataFrame([("a", "running"), ("b", "failed")], "job_id string, status string")
    assert {x.job_id for x in retention.orphans(d, r, "2026-01-01 03:00:00").collect()} == {"b", "c"}
    beats = spark.createDataFrame([(1, T0), (2, T0 + timedelta(seconds=1))], "worker_id long, ts timestamp")
    alive = retention.workers(beats, "2026-01-01 00:01:30")
    assert {x.worker_id: x.alive for x in alive.collect()} == {1: False, 2: True}
    assert retention.status(alive).collect()[0].status == "degraded" and retention.status(alive, expected=1).collect()[0].status == "ok"
    assert retention.status(alive, expected=1, scanner_ok=False).collect()[0].status == "degraded"


def test_streams_over_several_batches(spark, tmp_path):
    rows = [(1, "ai", 1 + k % 3, T0 + timedelta(minutes=7 * k), k) for k in range(60)]
    schema = "client long, class string, units long, ts timestamp, seq long"
    for k in range(3):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got = {x.seq: x.accepted for x in streams.run_available(streams.rate_limit_stream(stream, 3600, 6, 9), "append").collect()}
    batch = {x.seq: x.accepted for x in admission.rate_limit(spark.createDataFrame(rows, schema), 3600, 6, 9).collect()}
    assert got == batch and not all(batch.values())


def in_batches(spark, path, rows, schema, n):
    """rows as a stream of n files, one a batch."""
    size = -(-len(rows) // n)
    for k in range(n):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.parquet(f"{path}/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(path))


def test_rate_stream_with_timers(spark, tmp_path):
    schema = "client long, class string, units long, ts timestamp, seq long"
    rows = [(k % 3, "ai", k % 4, T0 + timedelta(minutes=9 * k), k) for k in range(80)]
    got = {x.seq: x.accepted for x in streams.run_available(streams.rate_limit_stream(in_batches(spark, tmp_path / "in", rows, schema, 4), 3600, 4, 9, late="0 seconds"), "append").collect()}
    assert got == {x.seq: x.accepted for x in admission.rate_limit(spark.createDataFrame(rows, schema), 3600, 4, 9).collect()} and not all(got.values())


def test_lease_stream_over_several_batches(spark, tmp_path):
    schema = "client long, job_id string, kind string, ts timestamp, seq long"
    rows = [(1, str(k // 2 if k % 5 == 4 else k), "release" if k % 5 == 4 else "reserve", T0 + timedelta(minutes=4 * k), k) for k in range(60)]
    batch = {x.seq: x.accepted for x in admission.leases(spark.createDataFrame(rows, schema), 3, 1800).collect()}
    for n, late in ((1, None), (3, None), (3, "0 seconds")):
        got = {x.seq: x.accepted for x in streams.run_available(streams.lease_stream(in_batches(spark, tmp_path / f"in{n}{late is None}", rows, schema, n), 3, 1800, late), "append").collect()}
        assert got == batch and not all(batch.values())


def test_lifecycle_stream_lets_old_jobs_go(spark, tmp_path):
    schema = "job_id string, kind string, operation string, ts timestamp, seq long, file_count long, result_bytes long, status string, error_code string"

    def event(job, kind, hours, seq, status=None):
        return (job, kind, "pdf-merge", T0 + timedelta(hours=hours), seq, 1, 7, status, None)

    rows = [event("a", "accepted", 0, 1), event("b", "accepted", 0, 2), event("a", "started", 1, 3), event("c", "accepted", 30, 4), event("b", "terminal", 31, 5, "succeeded"), event("c", "terminal", 31, 6, "failed"), event("d", "accepted", 60, 7), event("a", "terminal", 61, 8, "cancelled")]
    out = streams.run_available(streams.lifecycle_stream(in_batches(spark, tmp_path / "in", rows, schema, 4), "0 seconds", 40 * 3600), "update").collect()
    last = {}
    for x in sorted(out, key=lambda x: x.batch):
        last[x.job_id] = x.status
    assert last == {"a": "cancelled", "b": "succeeded", "c": "failed", "d": "queued"}
    out = streams.run_available(streams.lifecycle_stream(in_batches(spark, tmp_path / "in2", rows, schema, 4), "0 seconds", 3600), "update").collect()
    assert {x.status for x in out if x.job_id == "a"} == {"queued", "running"}  # it was let go before its end came


def test_liveness_stream_stops_and_times_out(spark, tmp_path):
    schema = "worker_id long, kind string, ts timestamp"
    rows = [(1, "beat", T0), (2, "beat", T0), (2, "stop", T0 + timedelta(seconds=5)), (3, "beat", T0 + timedelta(seconds=600)), (3, "beat", T0 + timedelta(seconds=610)), (4, "beat", T0 + timedelta(seconds=620))]
    out = streams.run_available(streams.liveness_stream(in_batches(spark, tmp_path / "in", rows, schema, 3), "0 seconds", 90), "update").collect()
    last = {}
    for x in sorted(out, key=lambda x: x.batch):
        last[x.worker_id] = x.last_us
    assert last[1] is None and last[2] is None and last[3] and last[4]
    seen = spark.createDataFrame(list(last.items()), "worker_id long, last_us long")
    assert {x.worker_id: x.alive for x in streams.alive(seen, (T0 + timedelta(seconds=650)).strftime("%Y-%m-%d %H:%M:%S")).collect()} == {1: False, 2: False, 3: True, 4: True}


def test_snapshots_agree_with_a_loop(spark):
    beats = [("a", 0), ("a", 50), ("a", 140), ("b", 60), ("b", 60), ("c", 86_390), ("c", 86_480), (None, 70), ("d", None)]
    times = [0, 49, 89, 139, 140, 150, 229, 230, 86_390, 86_400, 86_569, 86_570]
    at = lambda s: None if s is None else T0 + timedelta(seconds=s)
    b = spark.createDataFrame([(w, at(s)) for w, s in beats], "worker_id string, ts timestamp")
    p = spark.createDataFrame([(i, at(s), True, True, 10**9) for i, s in enumerate(times)] + [(90, None, True, True, 10**9), (91, at(60), None, True, 10**9)], "probe_id int, ts timestamp, store_ok boolean, scanner_ok boolean, free_bytes long")
    got = {r.probe_id: (r.workers, r.status) for r in retention.snapshots(b, p, 90, 1).collect()}
    for i, t in enumerate(times):
        n = len({w for w, s in beats if w and s is not None and s <= t < s + 90})
        assert got[i] == (n, "ok" if n else "degraded")
    assert got[90] == (None, "degraded") and got[91] == (2, "degraded")
    assert retention.snapshots(b.limit(0), p, 90, 1).where("workers > 0").count() == 0
    assert retention.snapshots(b, p.limit(0), 90, 1).count() == 0


def test_transform_events_fold_to_facts(spark):
    out = spark.createDataFrame([(1, 1, "x", b"abc", None, 10.0, 11.0), (1, 2, None, None, "INVALID_FILE", 11.0, 13.0), (2, 1, "y", b"abcd", None, 5.0, 6.0)], files.OUTPUTS)
    got = {(r.job_id, r.kind): r for r in files.transform_events(out).collect()}
    assert got["1", "terminal"].status == "failed" and got["1", "terminal"].error_code == "INVALID_FILE" and got["1", "terminal"].result_bytes == 0
    assert got["2", "terminal"].status == "succeeded" and got["2", "terminal"].result_bytes == 4
    assert got["1", "started"].ts.timestamp() < got["1", "terminal"].ts.timestamp()
