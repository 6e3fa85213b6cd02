"""Substring dedup by seed and extend: winnowed anchors seed the matches, whole runs around an anchor extend them."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobscope.llm.common import Words, grams, mix64, range_hashes, slices, staged

#: Words of a window, and of an anchor. Each window has WINDOW - GRAM + 1 grams and takes the one with the least hash.
WINDOW, GRAM = 20, 10
#: Slices of a partition over which repeats are settled before the shuffle.
SLICES = 24
#: Stands for a null doc_id inside: such documents come last.
NO_ID = (1 << 63) - 1
#: A place is start << 32 | span << 28 | 28 bits of the text's CRC, which tells apart rows that share a doc_id.
CRC = (1 << 28) - 1

#: An anchor that stands in so many runs of a stretch is in different runs for sure.
HOT = 32
#: state: 0 of most rows; 1 of runs of a hot anchor, which needn't meet at it; 2 of rows that only tell others of that anchor.
FOUND = "a long, b long, key long, place long, last long, state int"


def _places(starts: np.ndarray, spans: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    return starts << 32 | spans << 28 | crcs


class _Text:
    """Grams, windows and anchors of some texts. row, start: of each window that lies inside one text; anchor: the gram it takes."""

    def __init__(self, texts: list[bytes]) -> None:
        self.words = w = Words(texts)
        self.crcs = np.array([zlib.crc32(t) & CRC for t in texts], dtype=np.int64)
        self.grams = g = grams(w.hashes, GRAM)
        n = max(0, len(w.hashes) - WINDOW + 1)
        least, at = g[:n].copy(), np.zeros(n, dtype=np.int64)
        for k in range(1, WINDOW - GRAM + 1):
            other = g[k : k + n]
            less = other <= least
            least[less] = other[less]
            at[less] = k
        row = np.repeat(np.arange(len(texts)), w.counts())[:n]
        self.start = np.flatnonzero(np.arange(n) + WINDOW <= w.first[row + 1])
        self.row, self.anchor = row[self.start], self.start + at[self.start]

    def runs(self) -> tuple[np.ndarray, ...]:
        """Row, first and last window, anchor's hash and the run's hash, for each run of windows with one anchor."""
        cut = np.flatnonzero(np.diff(self.anchor, prepend=-1))
        low, high = self.start[cut], self.start[np.append(cut[1:], len(self.start)) - 1] if len(cut) else self.start[:0]
        anchor = self.anchor[cut]
        run = range_hashes(self.words.hashes, low, high + WINDOW) + (anchor - low).astype(np.uint64)
        return self.row[cut], low, high, self.grams[anchor], mix64(run)

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each window start."""
        g = self.grams
        halves = g[chosen] * np.uint64(3) + g[chosen + WINDOW - GRAM]
        whole = range_hashes(self.words.hashes, chosen, chosen + WINDOW)
        return whole, mix64(halves)


def _settle(a: np.ndarray, b: np.ndarray, key: np.ndarray, place: np.ndarray, anchors: bool) -> pa.RecordBatch:
    """Of rows with equal hashes a, b only those at the least (key, start) stay candidates; the others repeat these and are merged to intervals.

    With anchors, candidates of an anchor a with HOT runs and more are grouped by their run, not at the anchor; two rows in
    their place tell the group of the anchor that it has different runs.
    """
    start, span = place >> 32, place >> 28 & 15
    order = np.lexsort((place, key, b, a))
    a, b, key, place, start, span = (x[order] for x in (a, b, key, place, start, span))
    head = np.ones(len(a), dtype=bool)
    head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    lead = np.flatnonzero(head)[np.cumsum(head) - 1] if len(a) else head.astype(int)
    repeat = (key != key[lead]) | (start != start[lead])
    k, s, e, c = key[repeat], start[repeat], (start + span)[repeat], (place & CRC)[repeat]
    order = np.lexsort((s, c, k))
    k, s, e, c = (x[order] for x in (k, s, e, c))
    cut = np.ones(len(k), dtype=bool)
    cut[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1]) | (s[1:] > e[:-1] + 1)
    first = np.flatnonzero(cut)
    last = e[np.append(first[1:], len(k)) - 1] if len(first) else e[:0]
    keep = ~repeat
    k, place2 = k[first], _places(s[first], np.zeros(len(first), dtype=np.int64), c[first])
    spread = mix64(k.astype(np.uint64) * np.uint64(31) + place2.astype(np.uint64))
    n = int(keep.sum())
    own, state = a[keep], np.zeros(n, dtype=np.int32)
    told = own[:0]
    if anchors and n:
        heads = np.flatnonzero(np.diff(own, prepend=own[0] + np.uint64(1)) != 0)  # rows are in the order of a
        size = np.diff(np.append(heads, n))
        state = np.repeat(size >= HOT, size).astype(np.int32)
        told = np.repeat(own[heads][size >= HOT], 2)
        own = np.where(state == 1, mix64(own * np.uint64(3) + b[keep]), own)
    zero = np.zeros(len(told), dtype=np.int64)
    pairs = (np.arange(len(told)) % 2).astype(np.uint64)
    return pa.RecordBatch.from_pydict({
        "a": pa.array(np.concatenate([own, spread, told]).view(np.int64)),
        "b": pa.array(np.concatenate([b[keep], spread, pairs]).view(np.int64)),
        "key": pa.array(np.concatenate([key[keep], k, zero])),
        "place": pa.array(np.concatenate([place[keep], place2, zero])),
        "last": pa.array(np.concatenate([np.zeros(n, dtype=np.int64), last, zero]), mask=(np.arange(n + len(first) + len(told)) < n) | (np.arange(n + len(first) + len(told)) >= n + len(first))),
        "state": pa.array(np.concatenate([state, np.zeros(len(first), dtype=np.int32), np.full(len(told), 2, dtype=np.int32)])),
    })


def _settled(parts: Iterator[tuple[np.ndarray, ...]], anchors: bool) -> Iterator[pa.RecordBatch]:
    held = []
    for part in parts:
        held.append(part)
        if len(held) == SLICES:
            yield _settle(*(np.concatenate(x) for x in zip(*held, strict=True)), anchors)
            held = []
    if held:
        yield _settle(*(np.concatenate(x) for x in zip(*held, strict=True)), anchors)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch["text"]
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        for part in slices(sizes):
            yield batch.slice(part.start, part.stop - part.start)


def _find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def parts() -> Iterator[tuple[np.ndarray, ...]]:
        for batch in _cut(batches):
            t = _Text([x or b"" for x in batch["text"].to_pylist()])
            row, low, high, a, b = t.runs()
            yield a, b, batch["key"].to_numpy()[row], _places(low - t.words.first[row], high - low, t.crcs[row])

    yield from _settled(parts(), True)


def _find_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def parts() -> Iterator[tuple[np.ndarray, ...]]:
        for batch in _cut(batches):
            t = _Text([x or b"" for x in batch["text"].to_pylist()])
            places = batch["places"]
            place, row = places.flatten().to_numpy(), np.repeat(np.arange(len(batch)), pc.list_value_length(places).to_numpy())
            spans = (place >> 28 & 15) + 1
            row, low = np.repeat(row, spans), np.repeat((place >> 32), spans)
            low = low + np.arange(len(low)) - np.repeat(np.cumsum(spans) - spans, spans)
            a, b = t.windows(low + t.words.first[row])
            yield a, b, batch["key"].to_numpy()[row], _places(low, np.zeros_like(low), t.crcs[row])

    yield from _settled(parts(), False)


RESULT = "doc_id long, text string, n_words long, n_removed long, kept_sha256 string"


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _cut(batches):
        kept, n_words, n_removed, digests = [], [], [], []
        gone = [batch[x].to_pylist() for x in ("low", "high")]
        for text, lows, highs in zip(batch["text"].to_pylist(), *gone, strict=True):
            words = (text or b"").split()
            n_words.append(len(words))
            if lows:
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(edge, lows, 1)
                np.add.at(edge, np.array(highs) + WINDOW, -1)
                words = [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
            digests.append(hashlib.sha256(kept[-1]).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests)],
            names=["doc_id", "text", "n_words", "n_removed", "kept_sha256"],
        )


def repeats(docs: DataFrame) -> DataFrame:
    """key, crc, low, high: window starts (inclusive) whose words also start earlier; for the documents of keyed()."""
    found = docs.mapInArrow(_find_runs, FOUND)
    start, span = F.shiftright("place", 32), F.shiftright("place", 28).bitwiseAND(15)
    at = F.struct("key", start.alias("start"))

    def repeated(group: list[str]):
        return F.col("last").isNotNull() | (at != F.min(at).over(Window.partitionBy(*group)))

    # Runs with equal hashes are extended on both sides alike, so all of their windows repeat those of the first.
    found = found.withColumn("repeat", repeated(["a", "b"]))
    every = Window.partitionBy("a")
    found = found.withColumn("mixed", (F.col("state") == 1) | (F.min("b").over(every) != F.max("b").over(every)))
    found = staged(found.where("(repeat or mixed) and state < 2").select("key", "place", "last", "repeat"), "runs")
    # Where one anchor stands in different runs, the match may end inside: the first of each kind are compared window by window.
    edges = found.where("not repeat").groupBy("key", F.col("place").bitwiseAND(CRC).alias("crc")).agg(F.collect_set("place").alias("places"))
    windows = docs.join(edges, ["key", "crc"]).select("key", "text", "places").mapInArrow(_find_windows, FOUND)
    windows = windows.withColumn("repeat", repeated(["a", "b"])).where("repeat").select("key", "place", "last")
    out = found.where("repeat").select("key", "place", "last").unionByName(windows)
    return out.select("key", F.col("place").bitwiseAND(CRC).alias("crc"), start.alias("low"), F.coalesce("last", start + span).alias("high"))


def keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("binary")
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), F.coalesce(F.crc32(text).bitwiseAND(CRC), F.lit(0)).alias("crc"), "doc_id", text.alias("text"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text (kept words, joined by a space), n_words, n_removed, kept_sha256, one row for each row of docs.

    A window is WINDOW consecutive words of one document; a word goes if any window over it has the same words as a window
    that starts earlier (smaller doc_id, or the same document and an earlier start), judged on the input. Rows with one
    doc_id count as one document: neither is earlier at the same start. A null doc_id comes after all others; a null or
    empty text has no words and keeps the empty string. Matches are by two 64-bit hashes each.

    Before the shuffle each task keeps only its first occurrence of a run, so a passage in very many documents comes to
    its group once from each task.
    """
    docs = keyed(docs)
    gone = repeats(docs).groupBy("key", "crc").agg(F.collect_list(F.struct("low", "high")).alias("gone"))
    out = docs.join(gone, ["key", "crc"], "left").select("doc_id", "text", F.col("gone.low").alias("low"), F.col("gone.high").alias("high"))
    return out.mapInArrow(_remove, RESULT)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text")


OP4_SQL = r"""
with d as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) l from documents),
w as (select doc_id, unnest(l) word, unnest(range(1, len(l) + 1)) i from d),
g as (select doc_id, i, array_to_string(l[i:i + 19], ' ') g from (select doc_id, l, unnest(range(1, len(l) - 18)) i from d)),
r as (select doc_id, i from g qualify (doc_id, i) <> first_value((doc_id, i)) over (partition by g order by doc_id, i)),
c as (select distinct doc_id, unnest(range(i, i + 20)) i from r),
k as (select doc_id, count(*) n, string_agg(word, ' ' order by i) t from w anti join c using (doc_id, i) group by doc_id)
select d.doc_id, len(l) n_words, len(l) - coalesce(n, 0) n_removed, sha256(coalesce(t, '')) kept_sha256
from d left join k on d.doc_id = k.doc_id
"""
