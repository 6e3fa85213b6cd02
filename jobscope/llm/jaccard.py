"""N-gram Jaccard join with PartEnum signatures: the feature domain is partitioned twice, and subsets of the second parts enumerated."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobscope.llm.common import Words, grams, lean, maybe_broadcast, mix64, slices, staged
from jobscope.llm.components import components

SHINGLE = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Second-level parts of each first-level part, and how many of them may differ: signatures are of SPLIT - APART of them.
SPLIT, APART = 3, 1
#: A feature that stands in OFTEN documents of a stretch is counted there; counts of TOTAL and more make it frequent, TABLE
#: features at most being set apart. Any such choice gives the same links; it only keeps candidates few.
OFTEN, TOTAL, TABLE = 3, 12, 1_000_000
#: Bytes of text of a slice, slices of a stretch of documents, and signatures of a stretch of these.
SLICE, COUNTED, SETTLED = 1 << 19, 32, 1_000_000
#: Groups of candidates are compared in blocks of so much text and so many nodes; features of so many nodes of a block are bits there.
BLOCK_BYTES, BLOCK_NODES, BIT = 2 << 20, 4096, 64


def bands(largest: int) -> np.ndarray:
    """Largest size of each band: sets that link are in the same band or in neighbouring ones."""
    tops, low = [], 1
    while not tops or tops[-1] < largest:
        tops.append(low * 100 // PERCENT)
        low = tops[-1] + 1
    return np.array(tops)


def parts(top: np.ndarray) -> np.ndarray:
    """The number of first-level parts for sets of at most top features.

    intersection >= PERCENT / (100 + PERCENT) * (sum of sizes), so two sets that link differ by at most (100 - PERCENT) / (100 + PERCENT)
    of that sum. Of all parts at most a (APART + 1)-th as many differ by more than APART features; some more parts than
    that make up for those in which a set has too few features.
    """
    bad = 2 * top * (100 - PERCENT) // (100 + PERCENT) // (APART + 1)
    return bad + 2 + (bad + 1) // 4


class Shingles:
    """Distinct shingle hashes of several texts, row by row: flat values, row of each, sizes and a hash of each whole set."""

    def __init__(self, texts: list[bytes]) -> None:
        w = Words([t.lower() for t in texts])
        all_grams = grams(w.hashes, SHINGLE)
        sets = []
        for first, last in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if last - first >= SHINGLE:
                x = np.sort(all_grams[first : last - SHINGLE + 1])
                sets.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
            elif last > first:  # fewer words: the whole sequence is the one shingle
                sets.append(mix64(grams(w.hashes[first:last], last - first) + np.uint64(last - first)))
            else:
                sets.append(all_grams[:0])
        self.sizes = np.array([len(x) for x in sets], dtype=np.int64)
        self.values = np.concatenate(sets) if sets else all_grams[:0]
        self.row = np.repeat(np.arange(len(sets)), self.sizes)
        ends = np.cumsum(self.sizes)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(self.values))])
        self.nodes = mix64(sums[ends] - sums[ends - self.sizes] + self.sizes.astype(np.uint64)).view(np.int64)

    def signatures(self, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signatures, and the row of each. Each set takes part in its own band and the next.

        Leaving out the same features everywhere can only lessen a difference, so frequent ones are left out at first. If a
        set has too few full parts then, it goes on to the next way: the finest partition, each feature a part of its own;
        then all features in parts; then all features, each a part of its own, of which there are always enough.
        Two sets that link and share no signature of one way both go on to the next.
        """
        at = np.searchsorted(frequent, self.values)
        rare = frequent[np.minimum(at, len(frequent) - 1)] != self.values if len(frequent) else np.ones(len(self.values), dtype=bool)
        tops = bands(max(2, int(self.sizes.max(initial=0)) * 2 + 1))  # the next band too, even if all sets are empty
        own = np.searchsorted(tops, self.sizes)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for step in (0, 1):
            band = own + step
            largest = self.sizes * 100 // PERCENT  # that a set can link with
            live = (self.sizes > 0) & ((step == 0) | (largest > tops[own]))
            differ = (self.sizes + np.minimum(tops[band], largest)) * (100 - PERCENT) // (100 + PERCENT)
            live &= differ > 0  # where nothing may differ, equal sets are one already
            for lane, use in enumerate((rare, np.ones_like(rare))):
                live &= ~self._enumerated(use, live, band, differ, parts(tops[band]), 2 * lane, out)
                live &= ~self._finest(use, live, band, differ, 2 * lane + 1, out)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _enumerated(self, use: np.ndarray, live: np.ndarray, band: np.ndarray, differ: np.ndarray, n: np.ndarray, way: int, out: list) -> np.ndarray:
        """Adds signatures of the live sets for subsets of second-level parts; returns for which sets these are enough.

        A hash deals features to n first-level parts and within each to SPLIT second-level ones. Where two sets differ by at
        most APART features, they agree on SPLIT - APART second-level parts, and each such subset with features is a signature.
        A part is full if more than APART of its second-level parts have features, so that no subset is empty. At most
        differ // (APART + 1) parts differ by more, so one more full part than that is enough, and the parts after it are left
        out. What may differ depends on the set's own size: the first part on which two sets agree and which is full in either
        comes before both sets' ends.
        """
        n = np.where(live, n, 0)
        offset = np.cumsum(n) - n
        total = int(n.sum())
        sums, filled = np.zeros(total * SPLIT, dtype=np.uint64), np.zeros(total * SPLIT, dtype=bool)
        use = use & live[self.row]
        value, row = mix64(self.values[use] + np.uint64(7)), self.row[use]
        cell = offset[row] * SPLIT + ((value >> np.uint64(32)) * (n[row] * SPLIT).astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        np.add.at(sums, cell, value)
        filled[cell] = True
        sums, filled = sums.reshape(total, SPLIT), filled.reshape(total, SPLIT)
        owner = np.repeat(np.arange(len(n)), n)
        full = filled.sum(axis=1) > APART
        upto = np.concatenate([[0], np.cumsum(full)])
        bad = differ // (APART + 1)
        wanted = upto[:-1] - upto[offset[owner]] <= bad[owner]
        part = np.arange(total) - offset[owner]
        sums = mix64(sums + np.arange(1, SPLIT + 1, dtype=np.uint64))
        for k, subset in enumerate(combinations(range(SPLIT), SPLIT - APART)):
            at = np.flatnonzero(wanted & filled[:, subset].any(axis=1))
            tag = ((band[owner[at]] * 4 + way) * 64 + k).astype(np.uint64) << np.uint64(32) | part[at].astype(np.uint64)
            out.append((mix64(sums[at][:, subset].sum(axis=1, dtype=np.uint64) + mix64(tag)), owner[at]))
        return live & (upto[offset + n] - upto[offset] > bad)

    def _finest(self, use: np.ndarray, live: np.ndarray, band: np.ndarray, differ: np.ndarray, way: int, out: list) -> np.ndarray:
        """The same with each feature a part of its own, in the order of their hashes: one more than may differ is enough."""
        use = np.flatnonzero(use & live[self.row])
        row = self.row[use]
        counts = np.bincount(row, minlength=len(live))
        rank = np.arange(len(row)) - (np.cumsum(counts) - counts)[row]
        wanted = rank <= differ[row]
        use, row = use[wanted], row[wanted]
        out.append((mix64(self.values[use] + mix64((band[row] * 4 + way).astype(np.uint64) << np.uint64(32))), row))
        return live & (counts > differ)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        for part in slices(pc.fill_null(pc.binary_length(batch["text"]), 0).to_pylist(), SLICE):
            piece = batch.slice(part.start, part.stop - part.start)
            yield piece, [x or b"" for x in piece["text"].to_pylist()]


SETS = "doc_id long, row_hash long, n_shingles long, node long, feature long, seen long"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document; and rows for features with many documents in this stretch, with their number."""

    def frequent(held: list[np.ndarray]) -> pa.RecordBatch:
        values = np.concatenate(held)
        values.sort()
        first = np.flatnonzero(np.diff(values, prepend=~values[:1]))
        counts = np.diff(first, append=len(values))
        often = counts >= OFTEN
        none = pa.nulls(int(often.sum()), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(values[first[often]].view(np.int64)), pa.array(counts[often])], names=[x.split()[0] for x in SETS.split(", ")])

    held: list[np.ndarray] = []
    for batch, texts in _texts(batches):
        s = Shingles(texts)
        none = pa.nulls(len(batch), pa.int64())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["row_hash"], pa.array(s.sizes), pa.array(s.nodes), none, none], names=[x.split()[0] for x in SETS.split(", ")])
        _, first = np.unique(s.nodes, return_index=True)  # copies count once here
        keep = np.zeros(len(s.nodes), dtype=bool)
        keep[first] = True
        held.append(s.values[keep[s.row]])
        if len(held) == COUNTED:
            yield frequent(held)
            held = []
    if held:
        yield frequent(held)


def measure(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """doc_id, row_hash, n_shingles, node (hash of the set) of each document; and the frequent features, sorted.

    One pass over all documents. A histogram of the counts tells from which count on there are TABLE features at most; the
    driver gets only those.
    """
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_hash"), F.col("text").cast("binary").alias("text"))
    found = staged(rows.mapInArrow(lean(_measure), SETS), "sets")
    sets = found.where("node is not null").select("doc_id", "row_hash", "n_shingles", "node")
    often = staged(found.where("feature is not null").groupBy("feature").agg(F.sum("seen").alias("n")).where(F.col("n") >= TOTAL), "frequent")
    # Counts to an eighth of a power of two, so the histogram has a few hundred rows however large they grow.
    level = F.floor(F.log2("n") * 8).cast("int")
    least, total = 0, 0
    for x in often.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        total += x["count"]
        if total > TABLE:
            least = x["level"] + 1
            break
    values = often.where(level >= least).select("feature").toArrow()["feature"].to_numpy()
    return sets, np.sort(values.view(np.uint64))


def signatures(docs: DataFrame, frequent: np.ndarray, repeats: bool = False) -> DataFrame:
    """signature, node, more: of the nodes of a stretch that share a signature only the least, and whether there are others.

    With repeats instead those others (more is true then). So a signature that very many nodes have comes to its group once
    from each stretch, and the others are joined to what is found there.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def settle(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        found, node = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((node, found))
        found, node = found[order], node[order]
        head = np.ones(len(found), dtype=bool)
        head[1:] = found[1:] != found[:-1]
        fresh = head.copy()
        fresh[1:] |= node[1:] != node[:-1]
        if repeats:
            chosen = np.flatnonzero(fresh & ~head)
            more = np.ones(len(found), dtype=bool)
        else:
            chosen = np.flatnonzero(head)
            more = np.repeat(np.add.reduceat(fresh.astype(np.int64), chosen) > 1, np.diff(np.append(chosen, len(found)))) if len(chosen) else head
        chosen = chosen[np.argsort(order[chosen], kind="stable")]  # rows of a node together take less room in the shuffle
        for k in range(0, len(chosen), 50_000):
            at = chosen[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(found[at].view(np.int64)), pa.array(node[at]), pa.array(more[at])], names=["signature", "node", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        held, n = [], 0
        for _, texts in _texts(batches):
            s = Shingles(texts)
            new = []
            for k, node in enumerate(s.nodes.tolist()):
                if node not in done:
                    done.add(node)
                    new.append(k)
            if len(done) > 500_000:
                done.clear()
            keep = np.zeros(len(texts), dtype=bool)
            keep[new] = True
            s.values, s.row, s.sizes = s.values[keep[s.row]], s.row[keep[s.row]], np.where(keep, s.sizes, 0)
            found, row = s.signatures(shared.value)
            held.append((found, s.nodes[row]))
            n += len(found)
            if n >= SETTLED:
                yield from settle(held)
                held, n = [], 0
        if held:
            yield from settle(held)

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(lean(run), "signature long, node long, more boolean")


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with their texts those that link."""
    for batch in batches:
        sizes = pc.add(pc.binary_length(batch["text_a"]), pc.binary_length(batch["text_b"])).to_pylist()
        for part in slices(sizes):
            piece = batch.slice(part.start, part.stop - part.start)
            n = len(piece)
            s = Shingles([*piece["text_a"].to_pylist(), *piece["text_b"].to_pylist()])
            pair = s.row % n
            order = np.lexsort((s.values, pair))
            same = (s.values[order][1:] == s.values[order][:-1]) & (pair[order][1:] == pair[order][:-1])
            common = np.bincount(pair[order][1:][same], minlength=n)
            union = s.sizes[:n] + s.sizes[n:] - common
            links = pa.array(100 * common >= PERCENT * union)
            yield pa.RecordBatch.from_arrays([piece["a"], piece["b"]], names=["a", "b"]).filter(links)


def fetch(nodes: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """node, text: the text of one document of each of the nodes."""
    rows = sets.groupBy("node").agg(F.min("row_hash").alias("row_hash")).join(nodes, "node", "left_semi")
    rows = maybe_broadcast(staged(rows, "wanted"))
    texts = docs.select(F.xxhash64("doc_id", "text").alias("row_hash"), F.col("text").cast("binary").alias("text")).join(rows, "row_hash")
    return staged(texts.groupBy("node").agg(F.first("text").alias("text")), "texts")


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs of nodes (a, b) that link, by their whole texts."""
    a, b = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    return staged(pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInArrow(lean(_similar), "a long, b long"), "links")


def common(s: Shingles) -> Iterator[np.ndarray]:
    """For each row the number of features that it has in common with each of the rows after it.

    Features of BIT rows and more are bits of a row, of which there are at most a BIT-th as many as features in all; of the
    others the few rows that have them are gone through.
    """
    n = len(s.sizes)
    _, place, counts = np.unique(s.values, return_inverse=True, return_counts=True)
    dense = counts >= BIT
    column, keep = (np.cumsum(dense) - 1)[place], dense[place]
    bits = np.zeros((n, int(dense.sum()) // 64 + 1), dtype=np.uint64)
    np.bitwise_or.at(bits, (s.row[keep], column[keep] >> 6), np.uint64(1) << (column[keep] & 63).astype(np.uint64))
    few = np.flatnonzero((counts > 1)[place] & ~keep)
    order = few[np.argsort(place[few], kind="stable")]
    rows, feature = s.row[order], place[order]  # rows of one feature stand together, ascending
    stop = np.searchsorted(feature, feature, side="right")
    by_row = np.argsort(rows, kind="stable")
    edges = np.searchsorted(rows[by_row], np.arange(n + 1))
    for k in range(n - 1):
        found = np.bitwise_count(bits[k + 1 :] & bits[k]).sum(axis=1, dtype=np.int64)
        own = by_row[edges[k] : edges[k + 1]]
        size = stop[own] - own - 1
        at = np.repeat(own + 1, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        if len(at):
            found += np.bincount(rows[at] - k - 1, minlength=n - k - 1)
        yield found


def _block_links(table: pa.Table) -> pa.Table:
    """Links between nodes of different components in two blocks of a group (or within one), as many as connect these components."""
    nodes, block, component = (table[c].to_numpy() for c in ("node", "block", "component"))
    s = Shingles(table["text"].to_pylist())
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    across, out = block.min(initial=0) != block.max(initial=0), []
    for k, found in enumerate(common(s)):
        links = (100 * found >= PERCENT * (s.sizes[k] + s.sizes[k + 1 :] - found)) & (component[k + 1 :] != component[k])
        if across:
            links &= block[k + 1 :] != block[k]
        for other in (np.flatnonzero(links) + k + 1).tolist():
            x, y = find(int(component[k])), find(int(component[other]))
            if x != y:
                up[x] = y
                out.append((int(nodes[k]), int(nodes[other])))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def verify_groups(stars: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame:
    """Links across components among the nodes b of each group a.

    Of a group only what the links so far leave in several components is compared. A group is cut into blocks of bounded
    size by a hash, and each two blocks meet in a task, so nothing is joined pair by pair.
    """
    placed = stars.join(maybe_broadcast(staged(roots, "roots")), F.col("b") == F.col("node"), "left").select("a", "b", F.coalesce("component", "b").alias("component"))
    placed = placed.join(texts.select("node", F.octet_length("text").alias("bytes")), F.col("b") == F.col("node")).drop("node")
    placed = staged(placed, "placed")
    sums = placed.groupBy("a").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"), F.sum("bytes").alias("bytes")).where("low < high")
    blocks = F.greatest(F.floor(F.col("bytes") / BLOCK_BYTES), F.floor(F.col("n") / BLOCK_NODES)) + 1
    sums = maybe_broadcast(staged(sums.select("a", blocks.cast("int").alias("blocks")), "groups"))
    member = placed.drop("bytes").join(sums, "a").withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    member = member.join(texts.withColumnRenamed("node", "b"), "b").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    member = member.select("a", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), F.col("b").alias("node"), "component", "block", "text")
    return staged(member.groupBy("a", "low", "high").applyInArrow(_block_links, "a long, b long"), "links")


def link(docs: DataFrame) -> DataFrame:
    """doc_id, row_hash, n_shingles, component_id and component (the least node of it), one row for each row of docs.

    Sets of 5-word shingles of the lower-cased (A-Z) text; fewer words are one shingle; documents without words are empty
    and link with nothing. Equal sets are one node from the start. Nodes that share a signature are candidates. First each
    is compared with the least node of its signature, which it then belongs to; after that only what the links found so
    far leave in different components, in blocks. component_id is the smallest doc_id of the component; null only where no
    document of it has one. Nodes and signatures are 64-bit hashes.
    """
    sets, frequent = measure(docs)
    group = Window.partitionBy("signature")
    found = signatures(docs, frequent).withColumn("least", F.min("node").over(group)).withColumn("most", F.max("node").over(group))
    found = staged(found.where("least < most or more"), "candidates")
    whole = maybe_broadcast(staged(found.where("more").select("signature", "least").distinct(), "repeated"))
    repeats = signatures(docs, frequent, repeats=True).drop("more").join(whole, "signature")
    stars = found.select("node", "least").union(repeats.select("node", "least")).where("least < node")
    stars = staged(stars.select(F.col("least").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    nodes = stars.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = fetch(nodes, docs, sets)
    roots = staged(components(verify(stars, texts)), "roots")
    more = verify_groups(stars, roots, texts)
    roots = staged(components(roots.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)), "roots")
    least = sets.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first"))
    least = least.join(maybe_broadcast(roots), "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = least.groupBy("component").agg(F.min("first").alias("component_id"))
    named = least.join(smallest, "component").select("node", "component_id", "component")
    columns = ["doc_id", "row_hash", "n_shingles", "component_id", "component"]
    out = sets.where("n_shingles > 0").join(named, "node").select(*columns)
    return out.unionByName(sets.where("n_shingles = 0").select("doc_id", "row_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component")))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, that with the smallest doc_id (null last); documents without words all stay.

    Of rows that agree in doc_id and text one stays. Only what goes is looked up.
    """
    linked = staged(link(docs).where("component is not null"), "linked")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_hash")
    kept = linked.groupBy("component").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    first = kept.select(F.col("first.row_hash").alias("row_hash"), "component")
    gone = linked.join(first, ["component", "row_hash"], "left_anti").select(F.col("row_hash").alias("gone_row")).distinct()
    again = linked.join(first, ["component", "row_hash"], "left_semi").groupBy("row_hash").count().where("count > 1").select(F.col("row_hash").alias("again_row"))
    row = F.xxhash64(docs["doc_id"], docs["text"])
    gone, again = (maybe_broadcast(staged(x, "gone")) for x in (gone, again))
    left = docs.join(gone, row == gone["gone_row"], "left_anti")
    once = left.join(again, row == again["again_row"], "left_anti")
    return once.unionByName(left.join(again, row == again["again_row"], "left_semi").dropDuplicates(["doc_id", "text"]))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_hash", "component")
