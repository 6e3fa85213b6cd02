"""Ranges, folders, arriving files, images and the Arrow table function against plain Python."""

import json
import os
import random
from bisect import bisect_right
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from jobscope.functions import scalars
from jobscope.operators import lifecycle, pages, ranges, report, retention
from jobscope.operators.validate import Limits
from jobscope.schema import EVENTS, REJECTIONS
from jobscope.sources import directories, files
from jobscope.streaming import operators as streams

T0 = datetime(2026, 1, 1, tzinfo=UTC)


@pytest.mark.parametrize("n", [1, 3, 16])
def test_prefix_sums_over_ranges(spark, n):
    rng = random.Random(n)
    rows = [(rng.randint(-500, 500), rng.randint(-3, 5)) for _ in range(3000)] + [(7, 1)] * 500 + [(None, 9)]
    got = dict(map(tuple, ranges.prefix_sums(spark.createDataFrame(rows, "t long, v long"), "t", "v", n).collect()))
    expected, total = {}, 0
    for t in sorted({t for t, _ in rows if t is not None}):
        total += sum(v for x, v in rows if x == t)
        expected[t] = total
    assert got == expected
    assert ranges.prefix_sums(spark.createDataFrame([], "t long, v long"), "t", "v", n).count() == 0


def test_probes_of_one_day_over_several_tasks(spark):
    rng = random.Random(4)
    beats = [(w, T0 + timedelta(seconds=rng.randint(0, 40_000))) for w in range(40) for _ in range(60)]
    probes = [(k, T0 + timedelta(seconds=rng.randint(0, 45_000))) for k in range(2500)]
    b = spark.createDataFrame(beats, "worker_id long, ts timestamp")
    p = spark.createDataFrame([(k, t, True, True, 10**9) for k, t in probes], "probe_id int, ts timestamp, store_ok boolean, scanner_ok boolean, free_bytes long")
    got = {x.probe_id: (x.workers, x.status) for x in retention.snapshots(b, p, 90, 5).collect()}
    by = {}
    for w, t in sorted(beats):
        by.setdefault(w, []).append(t)
    for k, t in probes:
        n = sum((i := bisect_right(ts, t)) > 0 and t < ts[i - 1] + timedelta(seconds=90) for ts in by.values())
        assert got[k] == (n, "ok" if n >= 5 else "degraded")
    starts = spark.createDataFrame([(int(t.timestamp()), 1) for _, t in beats], "t long, v int")
    assert ranges.prefix_sums(starts, "t", "v", 4).select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_folders_touched_and_untouched(spark, tmp_path):
    now = datetime(2026, 6, 1, 12, tzinfo=UTC)
    hours = {"old": 5, "new": 1, "edge": 2, "running": 9, "ended": 9, "empty": 4, "late": 3}
    for name, h in hours.items():
        folder = tmp_path / name
        (folder / "in").mkdir(parents=True)
        if name != "empty":
            (folder / "in" / "a b.pdf").write_bytes(b"x" * 10)
            (folder / "é.txt").write_bytes(b"yz")
            (folder / ".a.crc").write_bytes(b"hidden")
        at = (now - timedelta(hours=h)).timestamp()
        os.utime(folder, (at, at))
    (tmp_path / "file-at-the-top").write_bytes(b"q")
    os.utime(tmp_path / "late", (now.timestamp(), now.timestamp()))  # touched again
    for path in (str(tmp_path), f"file://{tmp_path}"):
        tree = directories.list_tree(spark, path, folders=2)
        assert tree.rdd.getNumPartitions() == 4
        found = directories.job_directories(tree)
        assert {x.job_id: (x.n_files, x.n_bytes) for x in found.collect()} == {n: (0, 0) if n == "empty" else (2, 12) for n in hours}
        records = spark.createDataFrame([("running", "running"), ("ended", "failed"), ("edge", "failed"), ("new", "failed")], "job_id string, status string")
        assert {x.job_id for x in retention.orphans(found, records, "2026-06-01 12:00:00").collect()} == {"old", "ended", "empty"}
    (tmp_path / "none").mkdir()
    assert directories.list_tree(spark, str(tmp_path / "none")).count() == 0


def test_files_that_arrive_are_checked_once(spark, tmp_path):
    made = {"a.pdf": b"%PDF-1.7 x", "b.pdf": b"no", "c.rtf": b"  {\\rtf1", "d.docx": b"PK", "e.xyz": b"%PDF-", "f.doc": bytes.fromhex("D0CF11E0A1B11AE1") + b"..", "g.pdf": b"%PDF-" + b"x" * 500, "h.odt": b"", "i.xyz": b"", "j.pdf": None}
    expected = {"a.pdf": None, "b.pdf": "INVALID_FILE", "c.rtf": None, "d.docx": "INVALID_FILE", "e.xyz": "UNSUPPORTED_FORMAT", "f.doc": None, "g.pdf": "FILE_TOO_LARGE", "h.odt": "INVALID_FILE", "i.xyz": "UNSUPPORTED_FORMAT", "j.pdf": "INVALID_FILE"}
    root, limits, seen = f"file://{tmp_path}/in", Limits(document=200), []

    def write(lot, names):
        df = spark.createDataFrame([(f"{lot}/{n}", made[n]) for n in names], "name string, content binary").repartition(2)
        assert files.write_files(df, root) == len(names)

    def arrive():
        def sink(batch, k):
            rows = batch.collect()
            seen.append((k, sorted(x.path.rpartition("/")[2] for x in rows)))
            batch.write.mode("overwrite").parquet(f"{tmp_path}/out/{k}")

        streams.run_sink(files.checked_arrivals(files.scan_stream(spark, root, 2), "document-convert", limits), sink, f"{tmp_path}/checkpoint")

    write("one", ["a.pdf", "b.pdf", "c.rtf", "d.docx", "e.xyz", "h.odt"])
    arrive()
    assert len(seen) == 3 and all(len(names) <= 2 for _, names in seen)
    write("two", ["f.doc", "g.pdf", "i.xyz", "j.pdf"])
    arrive()  # a restart takes what is new only
    arrive()
    names = [n for _, batch in seen for n in batch]
    assert sorted(names) == sorted(n for n, c in made.items() if c) and [k for k, _ in seen] == list(range(len(seen)))
    got = spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/out")
    got = got.unionByName(files.checked_arrivals(files.empty_files(spark, root), "document-convert", limits)).collect()
    assert {x.path.rpartition("/")[2]: x.code for x in got} == expected and len(got) == len(made)


def test_images_that_can_not_be_read(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.png", 5, 3), ("a/y.png", 1, 1), ("z.png", 7, 9)], "name string, w int, h int")
    good = rows.select("name", files.png_content(F.col("w"), F.col("h")).alias("content"))
    bad = spark.createDataFrame([("bad.png", b"\x89PNG\r\n\x1a\nrest"), ("text.png", b"text")], "name string, content binary")
    assert files.write_files(good.unionByName(bad), str(tmp_path)) == 5
    got = {x.path.rpartition("/")[2]: (x.width, x.height, x.channels, x.code) for x in files.image_dimensions(spark, str(tmp_path)).collect()}
    assert got == {"x.png": (5, 3, 3, None), "y.png": (1, 1, 3, None), "z.png": (7, 9, 3, None), "bad.png": (None, None, None, "INVALID_FILE"), "text.png": (None, None, None, "INVALID_FILE")}


def test_small_files_that_arrive_share_tasks(spark, tmp_path):
    """400 files of a batch are listed by 16 tasks and read by some 4, before by 400 and 13."""
    n, key = 400, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    files.write_files(spark.range(n).select(F.concat(F.lit("d/"), F.col("id").cast("string"), F.lit(".rtf")).alias("name"), F.lit(b"{\\rtf1 x").alias("content")), str(tmp_path / "in"))
    spark.conf.set("spark.sql.files.openCostInBytes", "4000000")
    before = spark.conf.get(key)
    with files.small_files(spark):
        assert int(spark.conf.get(key)) == 4 * spark.sparkContext.defaultParallelism
        streams.run_sink(files.checked_arrivals(files.scan_stream(spark, str(tmp_path / "in")), "document-convert"), lambda batch, k: batch.write.parquet(f"{tmp_path}/out/{k}"), f"{tmp_path}/checkpoint")
    assert spark.conf.get("spark.sql.files.openCostInBytes") == "4000000" and spark.conf.get(key) == before
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len([x for x in os.listdir(tmp_path / "out" / "0") if x.startswith("part-")]) <= 6
    got = spark.read.parquet(f"{tmp_path}/out/0")
    assert got.count() == n and got.where("code is null").count() == n


@pytest.mark.parametrize("at_once", [1, 2, 3, 100])
def test_images_are_read_some_at_a_time(spark, tmp_path, at_once):
    """The driver never takes more files than that at once, and each of them once."""
    names = ["a/x.png", "a/y.png", "a/b/z.png", "a[1]/v {2}.png", "c/d/e/u.png", "top*.png", "top1.png", ".hidden/h.png", "_h/i.png", "c/_j.png"]
    rows = spark.createDataFrame([(n, k + 1, 2) for k, n in enumerate(names)], "name string, w int, h int")
    assert files.write_files(rows.select("name", files.png_content(F.col("w"), F.col("h")).alias("content")), str(tmp_path)) == len(names)
    held = [spark.read.format("binaryFile").option("recursiveFileLookup", True).load(p).count() for p in files.portions(spark, str(tmp_path), at_once)]
    assert max(held) <= at_once and sum(held) == 7
    got = files.image_dimensions(spark, str(tmp_path), at_once).collect()
    assert sorted(x.width for x in got) == [1, 2, 3, 4, 5, 6, 7] and all(x.height == 2 and x.code is None for x in got)
    (tmp_path / "none").mkdir()
    assert files.image_dimensions(spark, str(tmp_path / "none"), at_once).collect() == []


def test_arrow_table_function_agrees_with_the_columns(spark):
    rng = random.Random(9)
    parts = ["1", "2-3", " 4 - 5", "7-7", "3-2", "0", "99", "1-99", "", "  ", "x", "2-", "-2", "10-12", " 8\t", "2-3-4", "1.5", "9" * 19]
    rows = [(k, ",".join(rng.choice(parts[: rng.choice([4, 9, 18])]) for _ in range(rng.randint(0, 4))), rng.choice([1, 5, 12, 200])) for k in range(800)]
    df = spark.createDataFrame([*rows, (900, None, 3), (901, "1", None)], "doc_id long, ranges string, page_count int").repartition(3)
    pages.register_page_ranges(spark)
    got = sorted(map(tuple, spark.sql("select * from page_ranges(table({asked}))", asked=df).collect()))
    column = df.select("doc_id", F.explode(scalars.page_ranges(F.col("ranges"), F.col("page_count"))).alias("p")).select("doc_id", "p.first", "p.last")
    assert got == sorted(map(tuple, column.collect())) and len(got) > 150


def test_document_of_an_hour_with_all_parts(spark):
    def event(seq, kind, seconds, job="a", **more):
        row = {"job_id": job, "kind": kind, "operation": "upscale", "ts": T0 + timedelta(seconds=seconds), "seq": seq, "file_count": 2, "input_bytes": 1200, "result_bytes": 0, "status": None, "error_code": None}
        return tuple((row | more).values())

    rows = [event(1, "accepted", 36_000), event(2, "started", 36_120), event(3, "terminal", 37_200, status="succeeded", result_bytes=2400), event(4, "accepted", 40_000, "b", operation="pdf-split"), event(5, "terminal", 40_001, "b", status="failed", error_code="TIMEOUT")]
    rejected = [(T0 + timedelta(seconds=36_010), "pdf-merge", 1, 0, "INVALID_FILE"), (T0 + timedelta(seconds=36_011), "pdf-merge", 1, 0, "INVALID_FILE")]
    facts = lifecycle.fold(spark.createDataFrame(rows, EVENTS))
    doc = json.loads(report.document(facts, spark.createDataFrame(rejected, REJECTIONS), "2026-01-01", "2026-01-01", "hour").first()[0])
    none = {"count": 0, "average": None, "p50": None, "p95": None}
    jobs = {"accepted": 0, "succeeded": 0, "failed": 0, "cancelled": 0, "rejected": 0}
    one = {"jobs": jobs | {"accepted": 1, "succeeded": 1}, "filesAccepted": 2, "inputBytes": 1200, "resultBytes": 2400}
    split = {"jobs": jobs | {"accepted": 1, "failed": 1}, "filesAccepted": 2, "inputBytes": 1200, "resultBytes": 0}
    merge = {"jobs": jobs | {"rejected": 2}, "filesAccepted": 0, "inputBytes": 0, "resultBytes": 0}
    timing = {"queueSeconds": {"count": 1, "average": 120.0, "p50": 120.0, "p95": 120.0}, "processingSeconds": {"count": 1, "average": 1080.0, "p50": 1080.0, "p95": 1080.0}}
    idle = {"queueSeconds": none, "processingSeconds": none}
    assert doc["period"] == {"from": "2026-01-01", "to": "2026-01-01", "bucket": "hour", "timezone": "UTC"}
    assert doc["summary"] == {"jobs": jobs | {"accepted": 2, "succeeded": 1, "failed": 1, "rejected": 2}, "filesAccepted": 4, "inputBytes": 2400, "resultBytes": 2400, "timing": timing}
    assert doc["operations"] == [{"operation": "pdf-merge", **merge, "timing": idle}, {"operation": "pdf-split", **split, "timing": idle}, {"operation": "upscale", **one, "timing": timing}]
    assert doc["errors"] == [{"code": "INVALID_FILE", "count": 2}, {"code": "TIMEOUT", "count": 1}]
    assert len(doc["series"]) == 24 and doc["series"][10]["operations"] == {"pdf-merge": merge, "upscale": one} and doc["series"][11]["operations"] == {"pdf-split": split}
    assert doc["series"][3] == {"start": "2026-01-01T03:00:00Z", "jobs": jobs, "filesAccepted": 0, "inputBytes": 0, "resultBytes": 0, "operations": {}}
    empty = json.loads(report.document(facts.where("false"), spark.createDataFrame([], REJECTIONS), "2026-01-01", "2026-01-02", "day").first()[0])
    assert empty["summary"]["timing"] == idle and empty["operations"] == [] and empty["errors"] == [] and len(empty["series"]) == 2
