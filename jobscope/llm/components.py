"""Connected components of a large edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobscope.llm.common import maybe_broadcast, staged

#: Edges of a partition that are contracted at once.
EDGES = 500_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each stretch of edges as stars: every node with the least node that the stretch connects it to."""

    def stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = at[: len(a)], at[len(a) :]
        label = np.arange(len(nodes))
        while True:
            least = np.minimum(label[x], label[y])
            new = label.copy()
            for end in (label[x], label[y], x, y):
                np.minimum.at(new, end, least)
            while not np.array_equal(hop := new[new], new):
                new = hop
            if np.array_equal(new, label):
                break
            label = new
        own = label != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[label[own]])], names=["a", "b"])

    held, n = [], 0
    for batch in batches:
        held.append((batch["a"].to_numpy(), batch["b"].to_numpy()))
        n += len(batch)
        if n >= EDGES:
            yield stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held, n = [], 0
    if n:
        yield stars(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: hangs the neighbours of each u (the larger ones, or the smaller ones and u itself) under the least of u and its neighbours.

    The least ones are summed up before the shuffle and written, so the join has a plain shuffle on either side (or a
    broadcast) and Spark can split the edges of a hub.
    """
    if large:
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")
    else:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = staged(both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least")), "least")
    out = both.join(maybe_broadcast(least), "u")
    out = out.where("v > u") if large else out
    out = out.select(F.col("v").alias("a"), F.col("least").alias("b"))
    if not large:
        out = out.union(least.select(F.col("u").alias("a"), F.col("least").alias("b")))
    return staged(out.where("a <> b").distinct(), "stars")


def components(edges: DataFrame) -> DataFrame:
    """node, component: the least node that the edges (a, b) connect it to, itself included; only nodes with edges.

    Each task first contracts its own edges; then alternating large and small stars, each written to the shared folder.
    Rounds grow with the logarithm of the longest path. Repeated edges and loops change nothing; no edges give no rows.
    """
    edges = staged(edges.where("a <> b").select("a", "b").mapInArrow(_contract, "a long, b long").distinct(), "edges")

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()

    before = mark(edges)
    while before[0]:
        edges = _star(_star(edges, True), False)
        now = mark(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
