"""Sessions of hot clients, streams that start from batches, sinks that append once, chained streams and deadlines."""

import random
from datetime import UTC, datetime, timedelta
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from jobscope.operators import admission, lifecycle, report, retention
from jobscope.schema import EVENTS, REJECTIONS
from jobscope.streaming import operators as streams
from tests import test_jobs as jobs

T0 = datetime(2026, 1, 1, tzinfo=UTC)
REQUESTS = "client long, class string, units long, ts timestamp, seq long"
LEASES = "client long, job_id string, kind string, ts timestamp, seq long"


def in_batches(spark, path, rows, schema, n):
    """rows as a stream of n files, one a batch."""
    size = -(-len(rows) // n)
    for k in range(n):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.parquet(f"{path}/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(path))


def test_one_client_of_two_million_requests(spark):
    """500 sessions of 4000 requests, an hour and more apart, over several tasks: as one walk over all of them."""
    n, each = 2_000_000, 4000
    burst = F.floor(F.col("id") / each)
    ts = F.timestamp_seconds(burst * 9000 + (F.col("id") % each) * F.lit(1.3))
    requests = spark.range(n, numPartitions=8).select(F.lit(7).cast("long").alias("client"), F.lit("ai").alias("class"), (1 + F.pmod(F.xxhash64("id"), F.lit(3))).alias("units"), ts.alias("ts"), F.col("id").alias("seq"))
    out = admission.rate_limit(requests, 3600, 20, 60)
    got = out.select("seq", "accepted", F.spark_partition_id().alias("task")).toPandas().sort_values("seq")
    assert got["task"].nunique() >= 3 and got.groupby("task").size().max() < n * 0.6
    given = requests.select("seq", "units", F.unix_micros("ts").alias("us")).toPandas().sort_values("seq")
    log = admission.RateLog(3600 * 1_000_000)
    expected = [log.take(us, units, 20) for us, units in zip(given["us"].tolist(), given["units"].tolist(), strict=True)]
    assert len(got) == n and np.array_equal(got["accepted"].to_numpy(), expected) and 0.001 < np.mean(expected) < 0.5


def test_sessions_end_at_pauses_of_exactly_the_window(spark):
    seconds = [0, 10, 3609, 7209, 10_808, 14_408, 30_000, 33_599, 37_199]  # from 3609 to 7209 it is 3600
    rows = [(1, s * 1_000_000, s) for s in seconds] + [(None, s * 1_000_000, s) for s in seconds] + [(2, None, 5), (2, -1, 6), (2, -3_600_000_001, 7)]
    out = admission.sessions(spark.createDataFrame(rows, "client long, ts_us long, seq long"), ["client"], 3600 * 1_000_000).collect()
    assert len(out) == len(rows)
    for client in (1, None):
        mine = {x.seq: x.session for x in out if x.client == client}
        numbers = [mine[s] for s in seconds]
        assert [b - a for a, b in zip(numbers, numbers[1:], strict=False)] == [int(y - x >= 3600) for x, y in zip(seconds, seconds[1:], strict=False)]
    assert len({x.session for x in out if x.client == 2 and x.ts_us is not None}) == 2


@pytest.mark.parametrize("seed", range(2))
def test_replays_by_session_agree_with_one_walk(spark, seed):
    rng = random.Random(seed)
    rows, now = [], {}
    for k in range(3000):
        c = rng.choice([1, 1, 1, 2, 3])
        now[c] = now.get(c, 0) + rng.choice([0, 1, 20, 300, 900, 3599, 3600, 5000])
        rows.append((c, rng.choice(["ai", "local"]), rng.randint(0, 5), T0 + timedelta(seconds=now[c]), k))
    df = spark.createDataFrame(rows, REQUESTS)
    logs, held, rates = {}, {}, {}
    rate, admitted = {}, {}
    for c, kind, units, ts, k in rows:
        us, limit = int(ts.timestamp() * 1_000_000), 8 if kind == "ai" else 11
        rate[k] = logs.setdefault((c, kind), admission.RateLog(3_600_000_000)).take(us, units, limit)
        leases = held.setdefault(c, admission.Leases(1_800_000_000))
        admitted[k] = leases.reserve(us, str(k), 3)
        if admitted[k] and not rates.setdefault((c, kind), admission.RateLog(3_600_000_000)).take(us, units, limit):
            leases.release(str(k))
            admitted[k] = False
    assert {x.seq: x.accepted for x in admission.rate_limit(df, 3600, 8, 11).collect()} == rate
    assert {x.seq: x.accepted for x in admission.admission_replay(df, 3, 1800, 3600, 8, 11).collect()} == admitted
    assert 0.1 < np.mean(list(rate.values())) < 0.95 and 0.1 < np.mean(list(admitted.values())) < 0.95


@pytest.mark.parametrize("late", [None, "0 seconds"])
def test_streams_go_on_from_batches(spark, tmp_path, late):
    rows = [(k % 3, "ai", k % 4, T0 + timedelta(minutes=9 * k), k) for k in range(120)]
    whole = {x.seq: x.accepted for x in admission.rate_limit(spark.createDataFrame(rows, REQUESTS), 3600, 4, 9).collect()}
    first = admission.rate_limit(spark.createDataFrame(rows[:61], REQUESTS), 3600, 4, 9)
    stream = in_batches(spark, tmp_path / "rates", rows[61:], REQUESTS, 3)
    got = {x.seq: x.accepted for x in streams.run_available(streams.rate_limit_stream(stream, 3600, 4, 9, late, streams.rate_logs(first, 3600)), "append").collect()}
    assert got == {k: v for k, v in whole.items() if k > 60}
    alone = {x.seq: x.accepted for x in streams.run_available(streams.rate_limit_stream(stream, 3600, 4, 9, late), "append").collect()}
    assert alone != got  # the start matters

    rows = [(k % 2, str((k * 7) % 11), "release" if k % 5 == 4 else "reserve", T0 + timedelta(minutes=4 * k), k) for k in range(120)]
    whole = {x.seq: x.accepted for x in admission.leases(spark.createDataFrame(rows, LEASES), 3, 1800).collect()}
    first = admission.leases(spark.createDataFrame(rows[:60], LEASES), 3, 1800)
    stream = in_batches(spark, tmp_path / "leases", rows[60:], LEASES, 3)
    got = {x.seq: x.accepted for x in streams.run_available(streams.lease_stream(stream, 3, 1800, late, streams.held_leases(first, 1800)), "append").collect()}
    assert got == {k: v for k, v in whole.items() if k >= 60} and not all(got.values())


def lives(seed, n_jobs=60, spread=90):
    """Events of jobs in the order of time; some of them twice, some for jobs that were never accepted."""
    rng = random.Random(seed)
    events = []
    for j in range(n_jobs):
        at = timedelta(minutes=rng.randint(0, 2000))
        marks = [("accepted", at), ("started", at + timedelta(minutes=rng.randint(0, spread // 2))), ("terminal", at + timedelta(minutes=rng.randint(spread // 2, spread)))]
        marks = marks[: rng.choice([1, 2, 3, 3, 3])] + ([rng.choice(marks)] if rng.random() < 0.3 else [])
        marks = marks[1:] if rng.random() < 0.1 else marks
        events += [(m, str(j), kind) for kind, m in marks]
    events.sort(key=lambda x: x[0])
    status = lambda k: random.Random(k).choice(["succeeded", "failed", "cancelled"])
    return [(j, kind, "upscale", T0 + m, k, 2, 1200, 2400 if kind == "terminal" else 0, status(k) if kind == "terminal" else None, None) for k, (m, j, kind) in enumerate(events)]


def test_lifecycle_goes_on_from_facts(spark, tmp_path):
    rows = lives(1)
    whole = {x.job_id: (x.status, x.result_bytes) for x in lifecycle.fold(spark.createDataFrame(rows, EVENTS)).collect()}
    half = len(rows) // 2
    facts = lifecycle.fold(spark.createDataFrame(rows[:half], EVENTS))
    out = streams.run_available(streams.lifecycle_stream(in_batches(spark, tmp_path / "in", rows[half:], EVENTS, 3), start=facts), "update").collect()
    got = {x.job_id: (x.status, x.result_bytes) for x in facts.collect()}
    for x in sorted(out, key=lambda x: x.batch):
        got[x.job_id] = (x.status, x.result_bytes)
    assert got == whole and len({s for s, _ in whole.values()}) >= 4


def test_accept_sink_appends_once(spark, tmp_path):
    rows = [("accepted" if k % 4 else "started", f"j{k % 37}", T0 + timedelta(minutes=k), k) for k in range(120)]
    events = [(j, kind, "upscale", ts, k, 1, k, 0, None, None) for kind, j, ts, k in rows]
    first = {}
    for kind, j, _, k in rows:
        if kind == "accepted":
            first.setdefault(j, k)
    path = f"file://{tmp_path}/table"
    sink = streams.AcceptSink(spark, path, "s")
    assert sink.accepted().count() == 0
    stream = in_batches(spark, tmp_path / "in", events, EVENTS, 4)
    seen = []

    def twice(batch, k):
        """Every batch is delivered twice, and the first delivery of one of them stops before its mark."""
        seen.append(k)
        if k == 2:
            fs = sink._fs
            sink._fs = lambda p: (_ for _ in ()).throw(OSError("stopped")) if "/ledger/" in p else fs(p)
            with pytest.raises(OSError):
                sink(batch, k)
            sink._fs = fs
            assert {x.job_id for x in sink.accepted().collect()} == {j for j, n in first.items() if n < 60}  # half-written rows don't count
        sink(batch, k)
        sink(batch, k)

    streams.run_sink(stream, twice, f"{tmp_path}/checkpoint")
    assert seen == [0, 1, 2, 3]

    def table():
        return sorted((x.job_id, x.input_bytes) for x in sink.accepted().collect())

    assert table() == sorted(first.items())
    more = [("j5", "accepted", "upscale", T0, 500, 1, 500, 0, None, None), ("new", "accepted", "upscale", T0, 501, 1, 501, 0, None, None)]
    spark.createDataFrame(more, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/9")
    streams.run_sink(stream, twice, f"{tmp_path}/checkpoint")  # a restart takes up where it was
    assert seen == [0, 1, 2, 3, 4] and table() == sorted([*first.items(), ("new", 501)])
    streams.run_sink(stream, streams.AcceptSink(spark, path, "again"), f"{tmp_path}/checkpoint2")  # all of it once more, from the start
    assert table() == sorted([*first.items(), ("new", 501)])


def test_chained_stream_agrees_with_the_hourly_report(spark, tmp_path):
    rows = lives(3, 80)
    last = (str(999), "accepted", "upscale", T0 + timedelta(hours=200), 10_000, 1, 1, 0, None, None)  # closes all hours before it
    stream = in_batches(spark, tmp_path / "in", rows, EVENTS, 3)
    spark.createDataFrame([last], EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/8")
    out = streams.run_available(streams.status_report_stream(stream, late="30 minutes"), "append").collect()
    got = {(x.start.strftime("%Y-%m-%dT%H:%M:%SZ"), x.status): x.n for x in out}
    assert len(got) == len(out)
    c = report.contributions(lifecycle.fold(spark.createDataFrame(rows, EVENTS)), spark.createDataFrame([], REJECTIONS), "2026-01-01", "2026-01-05", "hour")
    series = report.series(c, "2026-01-01", "2026-01-05", "hour").collect()
    assert got == {(x.start, s): x[s] for x in series for s in ("accepted", "succeeded", "failed", "cancelled") if x[s]} and len(got) > 60


def test_removals_agree_with_the_plan_at_each_time(spark, tmp_path):
    rows = lives(5, 50)
    stream = in_batches(spark, tmp_path / "in", rows, EVENTS, 5)
    spark.createDataFrame([(str(999), "accepted", "upscale", T0 + timedelta(hours=200), 10_000, 1, 1, 0, None, None)], EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/8")
    out = streams.run_available(streams.removal_stream(stream, "10 minutes"), "append").collect()
    assert len({(x.job_id, x.kind) for x in out}) == len(out)
    for hours in (1, 7, 12, 20, 33, 150):
        now = T0 + timedelta(hours=hours)
        facts = lifecycle.fold(spark.createDataFrame([r for r in rows if r[3] <= now], EVENTS))
        plan = {(x.job_id, x.kind) for x in retention.removal_plan(facts, now.strftime("%Y-%m-%d %H:%M:%S")).collect()}
        assert {(x.job_id, x.kind) for x in out if x.due_us <= now.timestamp() * 1_000_000} == plan and (plan or hours == 1)


class Handle(dict):
    """The state of one bucket, in memory; counts the calls."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def getMapState(self, *schemas):  # noqa: N802
        return self

    def called(self, result=None):
        self.calls += 1
        return result

    def exists(self):
        return self.called(bool(self))

    def containsKey(self, k):  # noqa: N802
        return self.called(k in self)

    def getValue(self, k):  # noqa: N802
        return self.called(self[k])

    def updateValue(self, k, v):  # noqa: N802
        self.called(self.update({k: v}))

    def removeKey(self, k):  # noqa: N802
        self.called(self.pop(k))

    def iterator(self):
        return self.called(iter(list(self.items())))

    def listTimers(self):  # noqa: N802
        return self.called(iter(sorted(self.timers)))

    def registerTimer(self, ms):  # noqa: N802
        self.called(self.timers.add(ms))

    def deleteTimer(self, ms):  # noqa: N802
        self.called(self.timers.remove(ms))


def test_many_jobs_in_one_group(spark):
    """500 jobs, 100 of them never accepted, are one group: a call for each accepted job, none for the others, one timer; each goes at its own time."""
    n, handle = 500, Handle()
    p = streams.LifecycleProcessor(10_000_000, True)
    p.init(handle)
    rows = [Row(job_id=str(k), kind=kind, operation="x", ts_us=k * 1_000_000 + add, seq=k * 10 + seq, file_count=1, result_bytes=None, status=status, error_code=None)
            for k in range(n) for kind, seq, add, status in (("terminal", 2, 5, "failed"), ("accepted", 1, 0, None)) if k % 5 or kind != "accepted"]
    out = list(p.handleInputRows((0,), iter(rows), None))
    assert {(x.job_id, x.status, x.accepted_us, x.finished_us, x.result_bytes) for x in out} == {(str(k), "failed", k * 1_000_000, k * 1_000_000 + 5, 0) for k in range(n) if k % 5} and len(out) == 400
    assert handle.calls <= 400 + 4 and handle.timers == {11_001}
    left = {int(k) for k, in handle}
    for watermark in (11_002, 12_001, 100_000, 600_000):
        for ms in [x for x in handle.timers if x < watermark]:
            assert list(p.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda w=watermark: w), SimpleNamespace(getExpiryTimeInMs=lambda m=ms: m))) == []
            handle.timers.discard(ms)
        left = {k for k in left if k * 1000 + 10_001 >= watermark}
        assert {int(k) for k, in handle} == left and handle.timers == ({min(left) * 1000 + 10_001} if left else set())
    assert not left


def test_jobs_that_share_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams._Bucketed, "BUCKETS", 2)
    jobs.test_lifecycle_stream_lets_old_jobs_go(spark, tmp_path)


def test_facts_that_share_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams._Bucketed, "BUCKETS", 2)
    test_lifecycle_goes_on_from_facts(spark, tmp_path)


def test_removals_that_share_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams._Bucketed, "BUCKETS", 2)
    test_removals_agree_with_the_plan_at_each_time(spark, tmp_path)


def test_statuses_of_jobs_that_share_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams._Bucketed, "BUCKETS", 2)
    test_chained_stream_agrees_with_the_hourly_report(spark, tmp_path)


@pytest.mark.parametrize("late", [None, "0 seconds"])
def test_clients_that_share_buckets(spark, tmp_path, monkeypatch, late):
    monkeypatch.setattr(streams._Bucketed, "BUCKETS", 2)
    test_streams_go_on_from_batches(spark, tmp_path, late)


def test_a_stream_ends_by_itself_or_by_the_callers_limit(spark, tmp_path):
    rows = [(k % 3, "ai", 1, T0 + timedelta(minutes=k), k) for k in range(30)]
    stream = streams.rate_limit_stream(in_batches(spark, tmp_path / "in", rows, REQUESTS, 1), 3600, 4, 9)
    assert streams.run_available.__defaults__ == streams.run_sink.__defaults__ == (None,)
    with pytest.raises(TimeoutError):
        streams.run_available(stream, "append", 1)
    assert streams.run_available(stream, "append", 600).count() == 30
