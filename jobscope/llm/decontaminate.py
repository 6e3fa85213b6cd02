"""Benchmark decontamination: windows of canonical tokens are hash-joined, runs of them checked for consistent slots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobscope.llm.common import Words, grams, is_small, lean, maybe_broadcast, mix64, range_hashes, slices, staged
from jobscope.llm.common import _BYTE as BYTE_HASHES

#: Tokens of a window; a run of windows is a leak from RUN tokens on, or all but one of a shorter item's.
WINDOW, RUN = 8, 13
#: Share of a run that has to be ordinary words, not placeholders; with fewer than one in MOSTLY a window has to stand as written.
PLAIN, MOSTLY = 0.5, 4
#: Items of fewer tokens leak nothing: their words stand everywhere.
LEAST = 5
#: Hashes of benchmark windows that a task looks up while reading; of a larger benchmark all windows of documents are joined by shuffle.
LOOKUP = 4_000_000
#: Bytes of text whose tokens a task holds at once: a byte takes about a hundred meanwhile.
SLICE = 1 << 18
#: Words that stand for the placeholder of units.
UNITS = """kg g mg lb lbs oz ton tons km m cm mm mi mile miles ft foot feet inch inches yard yards l ml liter liters litre litres
gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph kmh
dollar dollars cent cents euro euros pound pounds percent degree degrees celsius fahrenheit watt watts volt volts""".split()  # fmt: skip

_ALNUM, _DIGIT, _LETTER, _UPPER, _STOP = (np.zeros(256, dtype=bool) for _ in range(5))
_DIGIT[48:58] = True
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_ALNUM[:] = _DIGIT | _LETTER
_UPPER[65:91] = True
_STOP[[*b".!?:"]] = True
_NUMBER, _NAME, _UNIT = (mix64(np.array([k], dtype=np.uint64))[0] for k in (101, 102, 103))


class Tokens:
    """Canonical tokens of several texts: hash as written (lower case), hash with placeholders, first token of each text.

    Words are cut between digits and letters (5kg, 12-year), and lose ASCII punctuation at both ends; what is only punctuation
    is no token. A number is a word with digits; a unit is in UNITS; a name starts with a capital (A-Z and the Latin-1 ones),
    goes on without one, and doesn't start a sentence. As what reads as a name depends on case, windows with names are also
    made with these as written.
    """

    def __init__(self, texts: list[bytes]) -> None:
        w = Words(texts)
        buffer, n = w.buffer, len(w.buffer)
        alnum = _ALNUM[buffer]
        places = np.arange(n)
        after = np.minimum.accumulate(np.where(alnum, places, n)[::-1])[::-1] if n else places
        before = np.maximum.accumulate(np.where(alnum, places, -1))
        # A piece of a word starts with it, and where a digit follows a letter or the other way round (punctuation between them or not).
        marks = np.flatnonzero(alnum)
        changes = marks[1:][_DIGIT[buffer[marks[1:]]] != _DIGIT[buffer[marks[:-1]]]]
        word = np.searchsorted(w.starts, changes, side="right") - 1
        inner = changes > after[w.starts[word]]
        changes, word = changes[inner], word[inner]
        begins = np.concatenate([w.starts, changes])
        order = np.argsort(begins, kind="stable")
        word = np.concatenate([np.arange(len(w.starts)), word])[order]
        begins = begins[order]
        heads = np.diff(word, prepend=-1) != 0
        stops = np.append(begins, n)[1:]
        stops[np.append(heads, True)[1:]] = w.ends
        starts, ends = after[begins], before[stops - 1] + 1
        good = starts < stops
        fresh = np.ones(len(w.starts), dtype=bool)
        fresh[1:] = _STOP[buffer[w.ends[:-1] - 1]] | (buffer[w.ends[:-1]] == 10)
        fresh = fresh[word] & heads
        row = np.repeat(np.arange(len(texts)), w.counts())[word]
        starts, ends, fresh, row = starts[good], ends[good], fresh[good], row[good]
        self.first = np.searchsorted(row, np.arange(len(texts) + 1))
        # Latin-1 capitals are the bytes 80 to 9E after C3, and 32 below their small letters as well.
        latin = np.concatenate([[False], buffer[:-1] == 0xC3]) & (buffer >= 0x80) & (buffer <= 0x9E) & (buffer != 0x97)
        lower = np.where(_UPPER[buffer] | latin, buffer + 32, buffer)
        upper = _UPPER[buffer] | np.concatenate([latin[1:], [False]])
        self.raw = range_hashes(BYTE_HASHES[lower], starts, ends)
        digits, letters = (np.concatenate([[0], np.cumsum(t[buffer])]) for t in (_DIGIT, _LETTER))
        number = (digits[ends] > digits[starts]) & (letters[ends] == letters[starts])
        second = starts + 1 + (buffer[starts] == 0xC3)
        name = upper[starts] & ~fresh & (second < ends) & ~upper[np.minimum(second, n - 1)]
        unit = np.isin(self.raw, _unit_hashes())
        self.slot = number | unit | name
        self.name = name & ~number & ~unit
        self.as_written = np.where(number, _NUMBER, np.where(unit, _UNIT, self.raw))
        self.canonical = np.where(self.name, _NAME, self.as_written)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, place in the row's tokens, hash, and whether it is as written, of each window of size tokens.

        Windows that are nearly all placeholders agree too easily: they are only made as written. One token over and over is none.
        """
        rows = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        at = np.arange(max(0, len(rows) - size + 1))

        def count(marks: np.ndarray, n: int = size) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(marks)])
            return sums[at + n] - sums[at]

        some = at + size <= self.first[rows[: len(at)] + 1]
        some &= (count(self.raw[1:] != self.raw[:-1], size - 1) > 0) | (size == 1)
        names, slots, least = count(self.name), count(self.slot), -(-size // MOSTLY)
        named = some & (names > 0) & (size - slots + names >= least)
        whole = some & (size - slots + names < least)
        some &= size - slots >= least
        hashes = [grams(self.canonical, size)[some], grams(self.as_written, size)[named], grams(self.raw, size)[whole]]
        written = np.arange(sum(map(len, hashes))) >= len(hashes[0])
        at = np.concatenate([at[some], at[named], at[whole]])
        return rows[at], at - self.first[rows[at]], mix64(np.concatenate(hashes) + np.uint64(size)), written

    def slots(self, row: np.ndarray, place: np.ndarray, size: int, written: np.ndarray) -> pa.Array:
        """For each window the places (within it) and hashes as written of its placeholders; where written holds, without names."""
        at = (place + self.first[row])[:, None] + np.arange(size)
        found = self.slot[at] & ~(self.name[at] & written[:, None]) if len(at) else np.zeros((0, size), dtype=bool)
        values = pa.StructArray.from_arrays([pa.array(np.nonzero(found)[1].astype(np.int32)), pa.array(self.raw[at][found].view(np.int64) if len(at) else np.zeros(0, dtype=np.int64))], names=["k", "word"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(found.sum(axis=1))]).astype(np.int32)), values)


_units: list[np.ndarray] = []


def _unit_hashes() -> np.ndarray:
    if not _units:
        w = Words([" ".join(UNITS).encode()])
        _units.append(np.sort(w.hashes))
    return _units[0]


FOUND = "id long, row_hash long, n_tokens long, size int, place long, hash long, slots array<struct<k:int,word:long>>"


def _windows(batches: Iterator[pa.RecordBatch], only: tuple[np.ndarray | None, tuple[int, ...]] | None) -> Iterator[pa.RecordBatch]:
    """The windows of template_windows() in a task, slice by slice."""
    for batch in batches:
        for part in slices(pc.fill_null(pc.binary_length(batch["text"]), 0).to_pylist(), SLICE):
            piece = batch.slice(part.start, part.stop - part.start)
            t = Tokens([x or b"" for x in piece["text"].to_pylist()])
            counts = np.diff(t.first)
            for size in only[1] if only else range(LEAST - 1, WINDOW + 1):
                row, place, hashes, written = t.windows(size)
                if only and only[0] is None:
                    keep = np.ones(len(row), dtype=bool)
                elif only:
                    at = np.minimum(np.searchsorted(only[0], hashes), len(only[0]) - 1)
                    keep = only[0][at] == hashes
                else:
                    keep = (np.minimum(counts - 1, WINDOW)[row] == size) & (counts[row] >= LEAST)
                    written[:] = False  # a name as written goes with itself, see find_leaks
                row, place, hashes, written = row[keep], place[keep], hashes[keep], written[keep]
                if len(row):
                    yield pa.RecordBatch.from_arrays([
                        piece["id"].take(pa.array(row)), piece["row_hash"].take(pa.array(row)), pa.array(counts[row]), pa.array(np.full(len(row), size, dtype=np.int32)),
                        pa.array(place), pa.array(hashes.view(np.int64)), t.slots(row, place, size, written),
                    ], names=[x.split()[0] for x in FOUND.split(", ")][:7])


def template_windows(rows: DataFrame, identifier: str, only: tuple[np.ndarray | None, tuple[int, ...]] | None = None) -> DataFrame:
    """Windows of the canonical tokens of each row. only: sorted hashes to keep (None: all) and the sizes of windows to look for; without it, each row's own size (all tokens but one, at most WINDOW) of rows with at least LEAST tokens."""
    shared = rows.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _windows(batches, shared.value)

    text = F.col("text")
    return rows.select(F.col(identifier).alias("id"), F.xxhash64(identifier, "text").alias("row_hash"), text.cast("binary").alias("text")).mapInArrow(lean(run), FOUND)


def judge(length: int, need: int, at: np.ndarray, item: np.ndarray, doc: np.ndarray) -> tuple[int, bool] | None:
    """Tokens of the longest part of a run that is a leak, and whether its placeholders are as in the item; None without such a part.

    at, item, doc: the places of the run's placeholders, ascending, and their values. A part has need tokens or more. Either
    all its values are as in the item; or PLAIN of its tokens are ordinary words, and each value goes with one value of the
    item throughout the part, and the other way round. If that doesn't hold for the whole run, then a part has to show of
    itself that its values go together: by a value as in the item, or by two placeholders.
    """
    filled, same = (np.zeros(length + 1, dtype=np.int64) for _ in range(2))
    filled[at + 1] = 1
    same[at[item == doc] + 1] = 1
    filled, same = np.cumsum(filled), np.cumsum(same)
    # The longest consistent parts: there, and back, are the last places where a value went with the one it has.
    parts, begin = [], 0
    there: dict[int, tuple[int, int]] = {}
    back: dict[int, tuple[int, int]] = {}
    cut: dict[tuple[int, int], tuple[int, int]] = {}
    for place, i, d in zip(at.tolist(), item.tolist(), doc.tolist(), strict=True):
        # The last placeholder before this one that has one of its two values and another partner.
        against = max(_other(there, cut, 0, i, d), _other(back, cut, 1, d, i)) + 1
        if against > begin:
            parts.append((begin, place))
            begin = against
        for seen, side, key, value in ((there, 0, i, d), (back, 1, d, i)):
            if key in seen and seen[key][0] != value:
                cut[side, key] = seen[key]
            seen[key] = (value, place)
    parts.append((begin, length))
    whole = len(parts) == 1
    found = []
    changed = at[item != doc]
    for a, b in zip([0, *(changed + 1)], [*changed, length], strict=True):
        if b - a >= need and (whole or same[b] > same[a]):
            found.append((int(b - a), True))
    gain = (1 - PLAIN) * np.arange(length + 1) - filled
    for a, b in parts:
        if b - a >= need:
            # For each end the first start from which PLAIN of the tokens are ordinary words.
            least = np.minimum.accumulate(gain[a : b + 1])
            ends = np.arange(a, b + 1)
            starts = a + np.searchsorted(-least, -gain[a : b + 1])
            good = (ends - starts >= need) & (whole | (same[ends] > same[starts]) | (filled[ends] - filled[starts] > 1))
            if good.any():
                k = np.argmax(np.where(good, ends - starts, 0))
                inside = filled[ends[k]] - filled[starts[k]]
                found.append((int(ends[k] - starts[k]), bool(same[ends[k]] - same[starts[k]] == inside)))
    return max(found, default=None)


def _other(seen: dict, cut: dict, side: int, key: int, value: int) -> int:
    """Last place where key went with another value, -1 if it never did."""
    if key not in seen:
        return -1
    return seen[key][1] if seen[key][0] != value else cut.get((side, key), (0, -1))[1]


JUDGED = "doc_id long, row_hash long, item_id long, n_tokens long, matched long, exact boolean"


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, matched, exact = [], [], []
        pairs = batch["pairs"]
        at, item, doc = (pairs.flatten().field(k).to_numpy() for k in range(3))
        edges = np.cumsum([0, *pc.list_value_length(pairs).to_pylist()])
        columns = (batch[x].to_numpy() for x in ("start", "length", "need"))
        for k, (start, length, need) in enumerate(zip(*columns, strict=True)):
            of = slice(edges[k], edges[k + 1])
            if best := judge(int(length), int(need), at[of] - start, item[of], doc[of]):
                kept.append(k)
                matched.append(best[0])
                exact.append(best[1])
        rows = batch.select(["doc_id", "row_hash", "item_id", "n_tokens"]).take(pa.array(kept, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(matched, pa.int64()), pa.array(exact, pa.bool_())], names=[x.split()[0] for x in JUDGED.split(", ")])


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, row_hash, item_id, item_tokens, matched (tokens of the longest run), exact (slots as in the item too).

    One row for each distinct document (doc_id and text) and item that it leaks: a run of consecutive windows of the item stands in
    the document in the same order, and a part of it that judge() accepts has at least RUN tokens or all but one of the
    item's (its first word may read as a name there). Items of fewer than LEAST tokens, and null and empty texts, leak
    nothing. Documents are read once.
    """
    items = staged(template_windows(benchmark, "item_id").distinct(), "items")
    sizes = tuple(sorted(r["size"] for r in items.select("size").distinct().collect()))
    hashes = items.select("hash").distinct()
    found = np.sort(hashes.toArrow()["hash"].to_numpy().view(np.uint64)) if is_small(hashes, LOOKUP, 1 << 30) else None
    if not sizes:
        docs = docs.limit(0)
    hits = template_windows(docs, "doc_id", (found, sizes))
    d = hits.select(F.col("id").alias("doc_id"), "row_hash", "size", "hash", F.col("place").alias("at"), F.col("slots").alias("doc_slots"))
    i = items.select(F.col("id").alias("item_id"), F.col("row_hash").alias("item_hash"), "n_tokens", "size", "hash", "place", "slots")
    joined = d.distinct().join(maybe_broadcast(i), ["size", "hash"])
    key = ["doc_id", "row_hash", "item_id", "item_hash", "n_tokens", "size", (F.col("at") - F.col("place")).alias("shift")]
    # What is a placeholder in the item only stands in the document as written.
    doc = lambda x: F.coalesce(F.try_element_at(F.filter("doc_slots", lambda y: y["k"] == x["k"]), F.lit(1))["word"], x["word"])
    pairs = F.transform("slots", lambda x: F.struct((x["k"] + F.col("place")).alias("at"), x["word"].alias("item"), doc(x).alias("doc")))
    joined = joined.select(*key, "place", pairs.alias("pairs"))
    line = ["row_hash", "doc_id", "item_id", "item_hash", "n_tokens", "size", "shift"]
    # Windows of one run have the same distance between their place and their rank along the shift.
    joined = joined.withColumn("run", F.col("place") - F.dense_rank().over(Window.partitionBy(*line).orderBy("place")))
    runs = joined.groupBy(*line, "run").agg(F.min("place").alias("start"), (F.max("place") - F.min("place") + F.col("size")).alias("length"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("pairs")))).alias("pairs"))
    need = F.least(F.lit(RUN), F.col("n_tokens") - 1)
    runs = runs.select("doc_id", "row_hash", "item_id", "n_tokens", "start", "length", need.alias("need"), "pairs").where("length >= need")
    leaks = runs.mapInArrow(lean(_judged), JUDGED)
    best = F.max(F.struct("matched", "exact")).alias("best")
    out = leaks.groupBy("row_hash", "doc_id", "item_id").agg(best, F.max("n_tokens").alias("item_tokens"))
    return out.select("doc_id", "row_hash", "item_id", "item_tokens", "best.matched", "best.exact")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that leak nothing, all columns unchanged."""
    leaked = maybe_broadcast(staged(find_leaks(docs, benchmark).select(F.col("row_hash").alias("leaked_row")).distinct(), "leaked"))
    return docs.join(leaked, F.xxhash64(docs["doc_id"], docs["text"]) == leaked["leaked_row"], "left_anti")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find_leaks(docs, benchmark).drop("row_hash")
