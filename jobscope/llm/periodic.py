"""Periodic runs of words: maximal pairs of a text's suffixes, listed bottom-up over its LCP-interval tree.

A stretch w[s:e) with period q that no neighbour extends is the maximal pair of the positions s and s + q with e - s - q equal
words: words before them and after them differ. So runs of at least four periods are the maximal pairs whose distance is at
most a third of their length, and nothing has to be extended. Each node of the tree holds its positions by their left word
(class lists); where children meet, the smaller one's positions look up the other's within that distance, in other classes
only. A stretch found with several distances has the least of them as its period.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.llm.common import Words, slices

#: A run has at least MIN_WORDS words and MIN_PERIODS periods.
MIN_WORDS, MIN_PERIODS = 6, 4
#: The least length of a maximal pair of such a run; windows of 4 words, a level of the doubling, rule the others out first.
LEAST = MIN_WORDS - 1
RUNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def suffixes(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of several texts (text k is values[first[k]:first[k + 1]]): the starts of suffixes that share LEAST - 1 words with
    another one of their text, sorted, and for each how many words it shares with the one before it.

    Prefix doubling over whole arrays; only suffixes that aren't told apart yet are sorted again. Memory grows with the number
    of words times the logarithm of the longest repeat.
    """
    n = len(values)
    if n < LEAST:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = np.repeat(first[1:], np.diff(first))
    order = np.lexsort((values, text))
    new = np.concatenate([[True], (values[order][1:] != values[order][:-1]) | (text[order][1:] != text[order][:-1])])
    rank = np.empty(n, dtype=np.int32)  # the place of the first suffix of the group
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    levels = [rank]
    size = np.bincount(rank, minlength=n)
    live = np.flatnonzero(size[rank] > 1)
    step = 1
    while len(live):
        behind = live + step
        key = np.where(behind < end[live], levels[-1][np.minimum(behind, n - 1)], -1)
        old = levels[-1][live]
        by = np.lexsort((key, old))
        live, key, old = live[by], key[by], old[by]
        head = np.concatenate([[True], old[1:] != old[:-1]])
        part = head | np.concatenate([[True], key[1:] != key[:-1]])
        at = np.arange(len(live))
        group, own = at[head][np.cumsum(head) - 1], at[part][np.cumsum(part) - 1]
        rank = levels[-1].copy()
        rank[live] = old + (own - group)
        levels.append(rank)
        alone = part & np.concatenate([part[1:], [True]])
        live = live[~alone]
        step *= 2
    if len(levels) < 4:  # no two suffixes of a text share 4 words
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    of_four = levels[2]
    chosen = np.flatnonzero(np.bincount(of_four, minlength=n)[of_four] > 1)
    chosen = chosen[np.argsort(levels[-1][chosen], kind="stable")]
    left, right = chosen[:-1], chosen[1:]
    near = np.flatnonzero(of_four[left] == of_four[right])
    a, b = left[near], right[near]
    shared = np.zeros(len(near), dtype=np.int64)
    for k in range(len(levels) - 2, -1, -1):
        x, y = a + shared, b + shared
        inside = np.maximum(x, y) < end[a]
        same = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        shared[same] += 1 << k
    lcp = np.zeros(len(chosen), dtype=np.int64)
    lcp[near + 1] = shared
    return chosen, lcp


class _Node:
    """Positions of an LCP interval, all and by left word."""

    __slots__ = ("places", "classes")

    def __init__(self, place: int, left: int) -> None:
        self.places, self.classes = [place], {left: [place]}


def _meet(a: _Node, b: _Node, depth: int, left: list[int], found: dict[tuple[int, int], int]) -> _Node:
    """Joins two children of a node at depth; pairs within depth // 3 and of different left words are runs."""
    if len(a.places) < len(b.places):
        a, b = b, a
    far, places, classes = depth // (MIN_PERIODS - 1), a.places, a.classes
    for p in b.places:
        own = left[p]
        mine = classes.get(own)
        k = bisect_left(places, p - far)
        while k < len(places) and (x := places[k]) <= p + far:
            if left[x] != own:
                d = abs(p - x)
                key = (min(p, x), depth + d)
                if found.get(key, d) >= d:
                    found[key] = d
                k += 1
            else:  # jump over the neighbours of the same class
                c = bisect_left(mine, x)
                low, high = 1, min(len(mine) - c, len(places) - k)
                while low < high:
                    mid = (low + high + 1) // 2
                    if mine[c + mid - 1] == places[k + mid - 1]:
                        low = mid
                    else:
                        high = mid - 1
                k += low
    for p in b.places:
        insort(places, p)
    for own, more in b.classes.items():
        held = classes.setdefault(own, [])
        for p in more:
            insort(held, p)
    return a


def runs(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """start, length, period (columns) of all runs of several texts, by start and period; starts count from the first text's first word."""
    order, lcp = suffixes(values, first)
    before = np.concatenate([[0], np.unique(values, return_inverse=True)[1][:-1] + 1]) if len(values) else values
    before[first[:-1][first[:-1] < len(values)]] = 0  # no word stands before a text
    left, found = before.tolist(), {}
    deep = lcp >= LEAST
    for begin, stop in _stretches(deep):
        places, depths = order[begin:stop].tolist(), lcp[begin:stop].tolist()
        stack: list[tuple[int, _Node]] = []
        node = _Node(places[0], left[places[0]])
        for k in range(1, len(places) + 1):
            depth = depths[k] if k < len(places) else 0
            while stack and stack[-1][0] > depth:
                d, older = stack.pop()
                node = _meet(older, node, d, left, found)
            if k == len(places):
                break
            if stack and stack[-1][0] == depth:
                stack[-1] = (depth, _meet(stack[-1][1], node, depth, left, found))
            else:
                stack.append((depth, node))
            node = _Node(places[k], left[places[k]])
    out = np.array([(s, n, q) for (s, n), q in found.items()], dtype=np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _stretches(deep: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of suffixes of which each shares enough with the one before it; the first one is that before the first True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], deep, [False]]).astype(np.int8)))
    yield from ((a - 1, b) for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True))


def planted(n: int, doc_id: int | None) -> np.ndarray:
    """For the n words of a document which word stands at each place; for a tenth of the documents the end repeats itself."""
    at = np.arange(n)
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if n and h % 10 == 0:
        g = h // 10
        a = g % n
        at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return at


def _describe(ids: list[int | None], texts: list[bytes], plant: bool) -> list[tuple]:
    t = Words(texts)
    source = np.arange(len(t.hashes))
    if plant:
        for k in np.flatnonzero(t.counts()).tolist():
            a, b = t.first[k], t.first[k + 1]
            if ids[k] is not None and crc32(str(ids[k]).encode()) % 10 == 0:
                source[a:b] = a + planted(b - a, ids[k])
    found = runs(t.hashes[source], t.first)
    cut = np.searchsorted(found[:, 0], t.first)
    drop = np.zeros(len(source) + 1, dtype=np.int64)
    np.add.at(drop, found[:, 0] + found[:, 2], 1)
    np.add.at(drop, found[:, 0] + found[:, 1], -1)
    kept = np.cumsum(drop)[:-1] == 0
    out = []
    for k, doc_id in enumerate(ids):
        a, b = int(t.first[k]), int(t.first[k + 1])
        words, own = texts[k].split(), found[cut[k] : cut[k + 1]]
        text = b" ".join(words) if len(own) == 0 and not plant else b" ".join([words[x] for x in (source[a:b][kept[a:b]] - a).tolist()])
        head, rows = (None, None, None, None), [(s - a, n, q) for s, n, q in own.tolist()]
        if rows:
            s, n, q = min(rows, key=lambda x: (-x[1], x[0], x[2]))
            head = (s, n, q, 1000 * n // q)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in rows)
        out.append((doc_id, len(rows), *head, sha256(listed.encode()).hexdigest(), sha256(text).hexdigest()))
    return out


def describe_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """For each row of docs (doc_id, text): its number of runs, the longest one, and hashes of all runs and of the collapsed text.

    A null text has no words; without runs the four columns of the longest one are null, and the hashes are those of what is
    there (of nothing). Repeated rows give repeated rows. Columns but doc_id and text aren't looked at. Words are told apart by
    64-bit hashes. With plant the ends of a tenth of the documents are made periodic first. Texts are whole: a long one is a
    slice of its own.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RUNS.split(", ")]
        for batch in batches:
            for part in slices(pc.fill_null(pc.binary_length(batch["text"]), 0).to_pylist()):
                piece = batch.slice(part.start, part.stop - part.start)
                rows = _describe(piece["doc_id"].to_pylist(), [x or b"" for x in piece["text"].to_pylist()], plant)
                kinds = [pa.int64()] * 6 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(work, RUNS)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), plant=True)


#: CRC-32 of a short text, bit by bit: each byte is followed by eight shifts.
_CRC = """xor(list_reduce([4294967295] || flatten(list_transform(range(1, length(s) + 1), lambda i: [ascii(s[i])::bigint, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, 3988292384 * (c & 1)) end), 4294967295)"""

#: Equal windows of five words at one distance, in stretches: those long enough for the distance are the runs.
OP11_SQL = f"""with texts as materialized (
  select row_number() over () r, doc_id, doc_id::varchar s, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) ws from documents),
hashed as (select r, doc_id, ws, len(ws) n, {_CRC} h from texts),
planned as (select *, case when n > 0 then (h // 10) % n end a, h // 10 g from hashed),
words as materialized (
  select r, doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(range(n), lambda i: ws[case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end + 1]) else ws end ws from planned),
grams as materialized (select r, unnest(range(n - 4)) i, unnest(list_transform(range(n - 4), lambda i: array_to_string(ws[i + 1:i + 5], ' '))) gram from words where n > 4),
pairs as (select x.r, x.i, y.i - x.i d from grams x join grams y on x.r = y.r and x.gram = y.gram and x.i < y.i),
islands as (select r, d, i, i - row_number() over (partition by r, d order by i) k from pairs),
stretches as (select r, d, min(i) s, count(*) + 4 + d n from islands group by r, d, k having count(*) + 4 >= greatest(5, 3 * d)),
runs as materialized (select r, s, n, min(d) q from stretches group by r, s, n),
listed as (select r, count(*) n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' order by s, q) t, first({{'s': s, 'n': n, 'q': q}} order by n desc, s, q) best from runs group by r),
placed as (select r, unnest(range(n)) i, unnest(ws) w from words),
kept as (select p.r, string_agg(w, ' ' order by i) t from placed p where not exists (select 1 from runs x where x.r = p.r and p.i >= x.s + x.q and p.i < x.s + x.n) group by p.r)
select w.doc_id, coalesce(n_runs, 0)::bigint n_runs, best.s::bigint as start, best.n::bigint as length, best.q::bigint as period, (1000 * best.n // best.q)::bigint exponent_milli,
  sha256(coalesce(listed.t, '')) runs_sha256, sha256(coalesce(kept.t, '')) collapsed_sha256
from words w left join listed on listed.r = w.r left join kept on kept.r = w.r"""
