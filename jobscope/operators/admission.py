"""Admission rules over request streams, replayed in order for each client.

The rules are greedy: a refused request uses nothing, so no window function gives them. But whatever came before, a client that
was idle for a whole window (or lease) has nothing left in its state. So a client's requests fall into sessions that don't
depend on each other, and each session is brought to one task, sorted and walked over with a state that the limit bounds. A
client with very many requests is spread over tasks by its pauses; only a session without any such pause takes its time in one
task, never memory.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobscope.schema import ACTIVE_JOBS, LEASE, RATE_AI, RATE_LOCAL, RATE_WINDOW


class RateLog:
    """Units accepted within the window, oldest first."""

    def __init__(self, window_us: int) -> None:
        self.window, self.log, self.used = window_us, deque(), 0

    def take(self, now: int, units: int, limit: int) -> bool:
        while self.log and self.log[0][0] <= now - self.window:
            self.used -= self.log.popleft()[1]
        if self.used + units > limit:
            return False
        if units:  # requests of none would stay for nothing
            self.log.append((now, units))
            self.used += units
        return True


class Leases:
    """Leases of jobs with their ends."""

    def __init__(self, lease_us: int) -> None:
        self.lease, self.ends = lease_us, {}

    def reserve(self, now: int, job: str, limit: int) -> bool:
        self.ends = {j: e for j, e in self.ends.items() if e > now}
        if len(self.ends) >= limit:
            return False
        self.ends[job] = now + self.lease
        return True

    def release(self, job: str) -> None:
        self.ends.pop(job, None)


def sessions(df: DataFrame, keys: list[str], idle_us: int) -> DataFrame:
    """df (keys, ts_us, ...) with session: numbers of the stretches of a key's rows without a pause of idle_us or more.

    Rows are never sorted or gathered by key for this: time is cut into slots of idle_us, and only the first and last time of
    each slot with rows (partial aggregates) are put in order. Within a slot there is no such pause, and after an empty slot
    there is one. The rows get their number by a join on key and slot, which spreads a key with many rows.
    """
    slotted = df.withColumn("_slot", F.floor(F.col("ts_us") / idle_us))
    spans = slotted.groupBy(*keys, "_slot").agg(F.min("ts_us").alias("_first"), F.max("ts_us").alias("_last"))
    order = Window.partitionBy(*keys).orderBy("_slot")
    pause = F.coalesce((F.col("_first") - F.lag("_last").over(order) >= idle_us).cast("long"), F.lit(0))
    numbered = spans.select(*keys, "_slot", pause.alias("_new")).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_slot").alias("_at"), F.sum("_new").over(order).alias("session"))
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys), F.col("_slot").eqNullSafe(F.col("_at")))
    return slotted.join(numbered, same).drop("_slot", "_at", *[f"_{k}" for k in keys])


def _replay(df: DataFrame, keys: list[str], idle_us: int, make, step, columns: list[str], result: str) -> DataFrame:
    """Runs step(state, row) over the rows of each session in the order of (ts, seq); the state is made anew for each, as nothing in it outlasts idle_us."""
    keys = [*keys, "session"]
    columns = [*keys, *[c for c in columns if c not in keys]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = state = None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                now = tuple(row[k] for k in range(len(keys)))  # the keys come first
                if now != key:
                    key, state = now, make()
                out.append(step(state, row))
            batch[result] = out
            yield batch.drop(columns=["ts_us", "session"])

    rows = sessions(df.select(*[c for c in columns if c != "session"], F.unix_micros("ts").alias("ts_us")), keys[:-1], idle_us).select(*columns, "ts_us")
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "ts_us", "seq")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("ts_us", "session"))
    return rows.mapInPandas(run, f"{schema}, {result} boolean")


def rate_limit(requests: DataFrame, window_s: int = RATE_WINDOW, ai: int = RATE_AI, local: int = RATE_LOCAL) -> DataFrame:
    """requests (client, class, units, ts, seq) with accepted: a sliding log of accepted units for each client and class.

    A unit counts until window_s after it was taken; at the very end of that time it doesn't.
    """
    return _replay(requests, ["client", "class"], window_s * 1_000_000, lambda: RateLog(window_s * 1_000_000), lambda s, r: s.take(r.ts_us, r.units, ai if r[1] == "ai" else local), ["client", "class", "units", "ts", "seq"], "accepted")


def leases(events: DataFrame, limit: int = ACTIVE_JOBS, lease_s: int = LEASE) -> DataFrame:
    """events (client, job_id, kind, ts, seq) with accepted: at most limit unended leases of a client; a release ends one and is always accepted."""

    def step(state: Leases, row) -> bool:
        if row.kind == "release":
            state.release(row.job_id)
            return True
        return state.reserve(row.ts_us, row.job_id, limit)

    return _replay(events, ["client"], lease_s * 1_000_000, lambda: Leases(lease_s * 1_000_000), step, ["client", "job_id", "kind", "ts", "seq"], "accepted")


def admission_replay(requests: DataFrame, limit: int = ACTIVE_JOBS, lease_s: int = LEASE, window_s: int = RATE_WINDOW, ai: int = RATE_AI, local: int = RATE_LOCAL) -> DataFrame:
    """requests with accepted: lease first, then rate; a refusal by rate gives the lease back. The job is named by seq."""

    def make() -> tuple[Leases, dict[str, RateLog]]:
        return Leases(lease_s * 1_000_000), {c: RateLog(window_s * 1_000_000) for c in ("ai", "local")}

    def step(state: tuple[Leases, dict[str, RateLog]], row) -> bool:
        held, rates = state
        kind = row[2]  # client, session, class
        if not held.reserve(row.ts_us, str(row.seq), limit):
            return False
        if rates[kind].take(row.ts_us, row.units, ai if kind == "ai" else local):
            return True
        held.release(str(row.seq))
        return False

    return _replay(requests, ["client"], max(lease_s, window_s) * 1_000_000, make, step, ["client", "class", "units", "ts", "seq"], "accepted")
