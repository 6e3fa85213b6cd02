"""The report and the life of jobs, with known values."""

import random
from datetime import UTC, date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from jobscope.functions.scalars import hmac_sha256, iso
from jobscope.operators import lifecycle, percentile, report, retention
from jobscope.schema import EVENTS, JOB_FACTS, REJECTIONS

T0 = datetime(2026, 7, 11, 10, tzinfo=UTC)


def event(seq, kind, ts, **more):
    row = {"job_id": "job", "kind": kind, "operation": "upscale", "ts": ts, "seq": seq, "file_count": 2, "input_bytes": 1200, "result_bytes": 0, "status": None, "error_code": None}
    return tuple((row | more).values())


@pytest.fixture
def history(spark):
    rows = [
        event(1, "accepted", T0), event(2, "started", T0 + timedelta(seconds=120)), event(3, "terminal", T0 + timedelta(minutes=20), status="succeeded", result_bytes=2400),
        event(4, "terminal", T0 + timedelta(minutes=20, seconds=10), status="cancelled"), event(5, "started", T0, job_id="unknown"),
    ]
    return spark.createDataFrame(rows, EVENTS)


def test_fold(history):
    fact = lifecycle.fold(history).collect()
    assert len(fact) == 1 and fact[0].status == "succeeded" and fact[0].result_bytes == 2400 and fact[0].file_count == 2


def test_fold_agrees_with_a_sequential_one(spark):
    r = random.Random(1)
    rows, expected = [], {}
    for j in range(150):
        fact = None
        for seq in range(r.randint(1, 7)):
            kind = r.choice(["accepted", "started", "terminal"])
            status = r.choice(["succeeded", "failed", "cancelled", "odd"]) if kind == "terminal" else None
            ts = T0 + timedelta(seconds=r.randint(0, 99))
            rows.append(event(seq, kind, ts, job_id=str(j), status=status))
            if fact is None:
                fact = ["queued", None] if kind == "accepted" else None
            elif kind == "started" and fact[0] in ("queued", "running"):
                fact = ["running", fact[1] or ts]
            elif kind == "terminal" and status != "odd" and fact[0] in ("queued", "running"):
                fact[0] = status
        if fact:
            expected[str(j)] = (fact[0], fact[1].timestamp() if fact[1] else None)
    out = lifecycle.fold(spark.createDataFrame(rows, EVENTS)).select("job_id", "status", F.col("started_at").cast("double").alias("s")).collect()
    assert {x.job_id: (x.status, x.s) for x in out} == expected


def test_cancellation_wins(spark, history):
    assert lifecycle.status_fold(history).collect()[0].status == "removed"
    rows = [event(1, "terminal", T0, status="cancelled"), event(2, "terminal", T0, status="succeeded")]
    assert lifecycle.status_fold(spark.createDataFrame(rows, EVENTS)).collect()[0].status == "cancelled"


def test_hourly_report(spark, history):
    facts = lifecycle.fold(history)
    rejections = spark.createDataFrame([(T0 + timedelta(seconds=10), "pdf-merge", 1, 0, "INVALID_FILE")], REJECTIONS)
    day = "2026-07-11"
    c = report.contributions(facts, rejections, day, day, "hour")
    s = report.summary(c).collect()[0]
    assert (s.accepted, s.succeeded, s.failed, s.cancelled, s.rejected, s.files_accepted, s.input_bytes, s.result_bytes) == (1, 1, 0, 0, 1, 2, 1200, 2400)
    t = {x.measure: x for x in report.timing(c, []).collect()}
    assert t["queue"].p50 == 120 and t["processing"].p95 == 1080
    assert [tuple(x) for x in report.errors(c).collect()] == [("INVALID_FILE", 1)]
    assert report.series(c, day, day, "hour").count() == 24
    assert '"p50":120.0' in report.document(facts, rejections, day, day, "hour").collect()[0].document
    assert report.document(facts.where("false"), rejections.where("false"), day, day, "hour").count() == 1
    maps = report.operation_maps(c, day, day, "hour").where(F.size("operations") > 0).select(F.map_keys("operations").alias("keys")).collect()
    assert [x["keys"] for x in maps] == [["pdf-merge", "upscale"]]


def test_percentiles(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", None), ("c", 5)], "g string, x long")
    got = {x.g: x for x in percentile.lower_rank(df, ["g"], "x", [0.5, 0.95]).collect()}
    assert set(got) == {"a", "c"} and (got["a"].p50, got["a"].p95, got["a"].n) == (1, 1, 2)
    r = random.Random(2)
    values = [(r.randint(0, 30),) for _ in range(500)]
    p = percentile.lower_rank(spark.createDataFrame(values, "x long"), [], "x", [0.5, 0.95]).collect()[0]
    levels = percentile.lower_rank(spark.createDataFrame([(v * 10**k, "g" if k else None) for k in (0, 12) for v, in values], "x long, g string"), ["g"], "x", [0.5, 0.95], window_rows=0)
    assert {x.g: (x.p50, x.p95, x.n) for x in levels.collect()} == {None: (p.p50, p.p95, 500), "g": (p.p50 * 10**12, p.p95 * 10**12, 500)}
    whole = percentile.lower_rank(spark.createDataFrame(values, "x long"), [], "x", [0.5], window_rows=0).collect()
    assert [x.p50 for x in whole] == [p.p50]
    ordered = sorted(v for v, in values)
    assert (p.p50, p.p95) == (ordered[int(499 * 0.5)], ordered[int(499 * 0.95)])
    q = spark.createDataFrame(values, "x long").agg(percentile.lower_rank_95(F.col("x").cast("double")).alias("p"))
    assert q.collect()[0].p == p.p95


def test_period():
    today = date(2026, 7, 11)
    assert report.period(None, None, "day", today) == (date(2026, 7, 5), today)
    assert report.period("2026-06-10", "2026-07-11", "hour", today) is None
    assert report.period("2026-06-11", "2026-07-11", "hour", today) is not None
    assert report.period("x", None, "day", today) is None and report.period("2026-07-12", "2026-07-11", "day", today) is None


def test_prune_is_strict(spark):
    r = spark.createDataFrame([(datetime.fromtimestamp(1, UTC), "x", 1, 0, "E")], REJECTIONS)
    assert lifecycle.prune(r, "occurred_at", "1970-01-01 00:00:02").count() == 0
    assert lifecycle.prune(r, "occurred_at", "1970-01-01 00:00:01").count() == 1
    assert retention.prune_plan(r, "occurred_at", "1970-01-01 00:00:02").collect()[0].action == "drop"


def test_pseudonyms(spark):
    import hashlib
    import hmac

    words = ["", "sensitive-job-id", "été"]
    for key in (b"k", b"x" * 100):
        got = spark.createDataFrame([(w,) for w in words], "w string").select(hmac_sha256(key, F.col("w")).alias("h")).collect()
        assert [x.h for x in got] == [hmac.new(key, w.encode(), hashlib.sha256).hexdigest() for w in words]


def test_iso(spark):
    got = spark.range(1).select(iso(F.lit("2026-07-11 10:00:00").cast("timestamp")).alias("a"), iso(F.lit("2026-07-11 10:00:00.5").cast("timestamp")).alias("b")).collect()[0]
    assert tuple(got) == ("2026-07-11T10:00:00Z", "2026-07-11T10:00:00.500000Z")


def test_accepting_and_splitting(spark, history):
    facts = spark.createDataFrame([], JOB_FACTS)
    assert lifecycle.accept_new(facts, history.union(history)).count() == 1
    assert lifecycle.accept_new(lifecycle.fold(history), history).count() == 0
    attempts = spark.createDataFrame([("a", "op", 1, 5, "E1", True), ("b", "op", 1, 5, "E2", False), ("c", "op", 1, 5, None, True)], "job_id string, operation string, file_count long, input_bytes long, error_code string, accepted boolean")
    ended, refused = lifecycle.split_failures(attempts)
    assert [x.error_code for x in ended.collect()] == ["E1"] and [x.error_code for x in refused.collect()] == ["E2"]


def test_prune_of_a_table(spark, tmp_path):
    rows = [("1995-01-08 01:00:00", 1), ("1995-01-10 11:59:59", 2), ("1995-01-10 12:00:00", 3), ("1995-01-11 00:00:00", 4), (None, 5)]
    r = spark.createDataFrame(rows, "at string, input_bytes long").selectExpr("cast(at as timestamp) occurred_at", "input_bytes")
    path = f"file://{tmp_path}/rejections"

    def left():
        return sorted(x.input_bytes for x in spark.read.parquet(path).collect())

    lifecycle.append_rejections(r, path)
    for _ in range(2):
        lifecycle.prune_table(spark, path, "occurred_at", "occurred_date", "1995-01-10 12:00:00")
        assert left() == [3, 4, 5]
    lifecycle.prune_table(spark, path, "occurred_at", "occurred_date", "1995-01-10 13:00:00")
    assert left() == [4, 5]
