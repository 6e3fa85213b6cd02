"""Media columns: texts as 8-bit audio, cut into content-defined chunks, stored once each, rebuilt from ordered chunk lists."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.llm.common import is_small, maybe_broadcast, mix64, slices, staged

#: Bytes of the padding unit, and of a chunk: at least, on the way to the next cut on average, at most.
UNIT, LEAST, MEAN_BITS, MOST = 64, 256, 10, 8192
RATE = 8000
#: Cells of the bitmap of rows with shared chunks, at most (one bit each); it only saves shuffle, whatever its size.
CELLS = 1 << 28
#: A row is known by two hashes of it: one of 64 bits would be shared by different rows among very many.
KEY = ["row_key", "row_crc"]
_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)).astype(np.uint32)


def payload(text: bytes | None) -> bytes:
    text = text or b""
    return text + bytes(max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def header(n: int) -> bytes:
    """The header of a WAV file of n 8-bit mono samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)


def gear_cuts(data: np.ndarray) -> np.ndarray:
    """Places after which the rolling gear hash of the last 32 bytes allows a cut: h = 2 h + gear[byte], by doubling."""
    h = _GEAR[data]
    for width in (1, 2, 4, 8, 16):
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
    return np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1


def chunks(payloads: list[bytes]) -> list[list[bytes]]:
    """The chunks of each payload. A cut depends on the bytes before it and the last cut only, so equal stretches soon cut alike."""
    joined = b"".join(payloads)
    cuts = gear_cuts(np.frombuffer(joined, dtype=np.uint8))
    out, start = [], 0
    for p in payloads:
        end, at, parts = start + len(p), start, []
        # The first LEAST bytes of a chunk are never cut, so bytes of the payload before can't matter.
        inside = cuts[np.searchsorted(cuts, start) : np.searchsorted(cuts, end)].tolist()
        for cut in [*inside, end]:
            while cut - at > MOST:
                parts.append(joined[at : at + MOST])
                at += MOST
            if cut - at >= LEAST or cut == end and cut > at:
                parts.append(joined[at:cut])
                at = cut
        out.append(parts)
        start = end
    return out


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[list[bytes]], list[list[bytes]]]]:
    """Slices of batches with their payloads, chunks and the chunks' digests."""
    for batch in batches:
        for part in slices(pc.fill_null(pc.binary_length(batch["text"]), 0).to_pylist()):
            piece = batch.slice(part.start, part.stop - part.start)
            found = [payload(x) for x in piece["text"].to_pylist()]
            cut = chunks(found)
            yield piece, found, cut, [[hashlib.sha256(c).digest() for c in x] for x in cut]


def _list_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece, _, _, digests in _payloads(batches):
        yield pa.RecordBatch.from_arrays([piece["row_key"], piece["row_crc"], pa.array(digests, pa.list_(pa.binary()))], names=[*KEY, "digests"])


STORE = "row_key long, row_crc long, doc_id long, n_bytes long, media_head binary, digests array<binary>, own array<struct<place:int,bytes:binary>>, lent array<int>, borrowed array<int>"
_OWN = pa.list_(pa.struct([("place", pa.int32()), ("bytes", pa.binary())]))


def _fill_store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece, payloads, cut, digests in _payloads(batches):
        lent, borrowed = ([x or [] for x in piece[k].to_pylist()] for k in ("lent", "borrowed"))
        own = []
        for parts, others in zip(cut, borrowed, strict=True):
            others = set(others)
            own.append([{"place": k, "bytes": c} for k, c in enumerate(parts) if k not in others])
        columns = [
            piece["row_key"], piece["row_crc"], piece["doc_id"], pc.fill_null(pc.cast(pc.binary_length(piece["text"]), pa.int64()), 0), pa.array([header(len(p)) for p in payloads], pa.binary()),
            pa.array(digests, pa.list_(pa.binary())), pa.array(own, _OWN), pa.array(lent, pa.list_(pa.int32())), pa.array(borrowed, pa.list_(pa.int32())),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=[*KEY, "doc_id", "n_bytes", "media_head", "digests", "own", "lent", "borrowed"])


def may_be_among(marks: DataFrame) -> Column:
    """Whether a row's key may be among those of marks: never false for one that is, seldom true for another. A bitmap of at most CELLS bits."""
    cells = min(CELLS, max(1 << 10, 1 << (16 * marks.count()).bit_length()))
    cell = F.col("row_key").bitwiseAND(F.lit(cells - 1))
    found = marks.select(cell.alias("cell")).groupBy(F.shiftright("cell", 3).alias("at")).agg(F.bit_or(F.expr("shiftleft(1, cast(cell & 7 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(cells // 8, dtype=np.uint8)
    bitmap[found["at"].to_numpy()] = found["bits"].to_numpy()
    shared = marks.sparkSession.sparkContext.broadcast(bitmap)

    @F.arrow_udf("boolean")
    def among(keys: pa.Array) -> pa.Array:
        at = keys.to_numpy(zero_copy_only=False) & (8 * len(shared.value) - 1)
        return pa.array(shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1)

    return among(F.col("row_key"))


def _with_marks(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """rows with lent and borrowed, null for those without shared chunks. Where marks aren't small, only texts of rows that may have some are shuffled."""
    if is_small(marks):
        return rows.join(F.broadcast(marks), KEY, "left")
    sorted_out = rows.withColumn("may", may_be_among(marks))
    none = F.lit(None).cast("array<int>")
    apart = sorted_out.where(~F.col("may")).withColumns({"lent": none, "borrowed": none})
    return sorted_out.where("may").join(marks, KEY, "left").unionByName(apart).drop("may")


def store(docs: DataFrame) -> DataFrame:
    """The chunk store, a written table: for each row of docs its ordered chunk digests and the bytes of the chunks it owns.

    Of equal chunks the one with the least (row, place) is stored; the others borrow it. Digests alone are shuffled to find
    the owners; payload bytes are written where they are read. A row's key is of its doc_id and text, so repeated rows agree.
    """
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("doc_id", "text").alias("row_key"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("row_crc"))
    lists = staged(rows.select(*KEY, "text").mapInArrow(_list_chunks, "row_key long, row_crc long, digests array<binary>"), "chunk-lists")
    places = lists.select(*KEY, F.posexplode("digests").alias("place", "digest"))
    at = F.struct(*KEY, "place")
    shared = places.groupBy("digest").agg(F.min(at).alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n")
    marks = places.join(maybe_broadcast(staged(shared, "shared-chunks")), "digest").withColumn("own", at == F.col("owner"))
    marks = marks.groupBy(*KEY).agg(F.collect_set(F.when(F.col("own"), F.col("place"))).alias("lent"), F.collect_set(F.when(~F.col("own"), F.col("place"))).alias("borrowed"))
    return staged(_with_marks(rows, staged(marks, "chunk-marks")).mapInArrow(_fill_store, STORE), "chunk-store")


def rebuild(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media_head and chunks (place, digest, bytes) of each stored row; only borrowed chunks move between tasks."""
    whole = stored.where(F.size("borrowed") == 0)
    part = stored.where(F.size("borrowed") > 0)
    lent = stored.where(F.size("lent") > 0).select("digests", F.explode(F.filter("own", lambda x: F.array_contains("lent", x["place"]))).alias("c"))
    lent = lent.select(F.element_at("digests", F.col("c.place") + 1).alias("digest"), F.col("c.bytes").alias("bytes")).groupBy("digest").agg(F.first("bytes").alias("bytes"))
    # Written, so that it has a plain shuffle: Spark can split those who want one and the same chunk. Bytes of chunks are never sent to all.
    lent = staged(lent, "lent-chunks")
    wanted = part.select(*KEY, "digests", F.explode("borrowed").alias("place")).select(*KEY, "place", F.element_at("digests", F.col("place") + 1).alias("digest")).distinct()
    fetched = wanted.join(lent, "digest").groupBy(*KEY).agg(F.collect_list(F.struct("place", "bytes")).alias("fetched"))
    part = part.join(fetched, KEY).withColumn("own", F.concat("own", "fetched")).drop("fetched")
    return whole.unionByName(part).select("doc_id", "n_bytes", "media_head", "digests", F.col("own").alias("chunks"))


def features(samples: np.ndarray) -> str:
    """Mean and root mean square about the middle level, and crossings of it, from whole-number sums."""
    x = samples.astype(np.int64) - 128
    crossings = int(np.count_nonzero(np.diff(x >= 0)))
    return f"sum={int(x.sum())};squares={int((x * x).sum())};crossings={crossings};peak={int(np.abs(x).max(initial=0))}"


MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(k, 500) for b in batches for k in range(0, len(b), 500)):
        rows = []
        for doc_id, n, head, digests, parts in zip(*(batch[c].to_pylist() for c in ("doc_id", "n_bytes", "media_head", "digests", "chunks")), strict=True):
            by_place = {c["place"]: c["bytes"] for c in parts}
            for k, digest in enumerate(digests):
                if hashlib.sha256(by_place.get(k, b"")).digest() != digest:
                    raise ValueError(f"document {doc_id}: chunk {k} isn't what was stored")
            media = head + b"".join(by_place[k] for k in range(len(digests)))
            samples = media[len(head) :]
            if struct.unpack("<I", head[-4:])[0] != len(samples):
                raise ValueError(f"document {doc_id}: {len(samples)} samples, not as many as its header says")
            rows.append((doc_id, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), features(np.frombuffer(samples, dtype=np.uint8))))
        kinds = [pa.string() if "string" in x else pa.int64() for x in MEDIA.split(", ")]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in MEDIA.split(", ")])


def read_back(stored: DataFrame) -> DataFrame:
    """One row for each stored row: sizes, digests and features of the media rebuilt from the store, each chunk verified.

    A null or empty text has a payload of UNIT zero bytes. Equal texts give equal values.
    """
    return rebuild(stored).mapInArrow(_read_back, MEDIA)


def op10_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(store(spark.read.parquet(f"{sf_dir}/documents.parquet")))
