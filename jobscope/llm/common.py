"""What the corpus operators share: scratch tables and vectorised word hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache, reduce, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobscope.sources.scratch import scratch_path

#: A side of a join is broadcast only after it was measured and has no more rows and bytes than these.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20

#: A word is a run of anything but these bytes; same set as bytes.split().
WORD = r"[^\x20\x09-\x0D]+"

#: Python tasks work on slices of a partition with about this many bytes of text at once.
SLICE_BYTES = 2 << 20
#: and hash so many of them at once.
HASHED_BYTES = 1 << 18


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder once and reads it from there: later steps neither recompute it nor depend on executors that held it."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bytes(column: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes in memory."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, T.StringType | T.BinaryType | T.ArrayType | T.StructType):
            return F.coalesce(F.aggregate(column, F.lit(0).cast("long"), lambda n, x: n + _bytes(x, inner)), F.lit(0)) + 16
        return F.greatest(F.size(column), F.lit(0)) * 8 + 16
    if isinstance(kind, T.StructType):
        return reduce(lambda x, y: x + y, (_bytes(column[f.name], f.dataType) for f in kind.fields), F.lit(8))
    return F.lit(8)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most rows rows and, in memory, about size bytes. df should be cheap to read (staged)."""
    each = reduce(lambda x, y: x + y, (_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16))
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(each.cast("long")), F.lit(0))).first()
    return n <= rows and total <= size


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Marks df for broadcast if measuring shows that it is small; otherwise the join shuffles."""
    return F.broadcast(df) if is_small(df, rows, size) else df


def word_count(text: str = "text"):
    """Words of a text column, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


# ---------------------------------------------------------------- memory and hashing in tasks


@cache
def _trim():
    """glibc's malloc_trim, if this is it."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda keep: None


def give_back() -> None:
    """Returns memory that Arrow and malloc hold for later use; a Python worker outlives its task and would keep it."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def lean(run):
    """A function over Arrow batches that gives unused memory back after each of them."""

    @wraps(run)
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                give_back()

        yield from run(each())
        give_back()

    return work


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64; kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(1 << 16, n + n // 8), base, dtype=np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each values[start:end]; equal content gives equal hashes wherever it stands."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.multiply(values, powers(_BASE, len(values)), out=sums[1:])
    np.cumsum(sums[1:], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * powers(_INVERSE, len(values) + 1)[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of several texts: byte ranges in one buffer, a hash for each, and each text's first word (first has one entry more)."""

    def __init__(self, texts: list[bytes]) -> None:
        joined = b"\n".join(texts) + b"\n"
        self.buffer = np.frombuffer(joined, dtype=np.uint8)
        gap = np.concatenate([[True], _GAP[self.buffer]])
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        self.starts, self.ends = edges[0::2], edges[1::2]
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = np.zeros(len(self.starts), dtype=np.uint64)
        # Piece by piece, as a byte takes eight while it is hashed.
        cuts = np.unique(np.searchsorted(self.starts, np.arange(0, len(self.buffer), HASHED_BYTES))).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(self.starts)], strict=True):
            if a < b:
                low, high = int(self.starts[a]), int(self.ends[b - 1])
                self.hashes[a:b] = range_hashes(_BYTE[self.buffer[low:high]], self.starts[a:b] - low, self.ends[a:b] - low)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive entries."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(_BASE) + hashes[k : k + len(out)]
    return mix64(out)


def slices(sizes: list[int], limit: int = SLICE_BYTES) -> Iterator[slice]:
    """Cuts a batch into runs of rows of about limit bytes; a longer text is a run of its own."""
    start = total = 0
    for k, size in enumerate(sizes):
        if total and total + size > limit:
            yield slice(start, k)
            start, total = k, 0
        total += size + 1
    if start < len(sizes):
        yield slice(start, len(sizes))
