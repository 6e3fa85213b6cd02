"""Centroid clustering: exact Lloyd rounds in which heaps of bounds tell which vectors have to be looked at again.

The nearest centroid of a vector stays nearest while the gap between its distances to the nearest and the second nearest is
more than what the centroids have moved since it was measured. Each cluster has a heap of these gaps, offset by the drift
accumulated when they were measured, so that nothing in it changes when centroids move. Popping is a range of keys: at a round
those between the drift before and after it. A heap is therefore a set of tables sorted by cluster and key and never
rewritten: what a round pops is read by predicates that Parquet prunes by, scanned exactly and written as a new table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.llm.common import staged

#: Components are kept within this, so that a squared distance of some dimensions fits into a long.
MOST = 1 << 27
#: Added to each drift: more than the error of the distances' roots, so that what stays in a heap has no tie.
MARGIN = 1e-5
ENTRY = "vec_id long, v array<int>, was int, cluster int, key double"


def quantised(vectors: DataFrame, dims: int = 64, scale: int = 256) -> DataFrame:
    """vec_id, v: floor(scale * x) of the components, for rows with exactly dims components, none null or non-finite.

    Values beyond 2**27 either way are set to that. Other columns don't matter; rows with the same or no vec_id are rows of their own.
    """
    good = F.size("embedding") == dims
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    whole = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("int"))
    return vectors.where(good & F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, vectors x centroids, as integers."""
    most = max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0))
    if most < 1 << 20:  # every sum is a whole number under 2**53
        a, b = v.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((v - c) ** 2).sum(1) for c in centroids], axis=1)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(len(column), dims)


@dataclass
class Clusters:
    """The entries of the heaps that hold (vec_id, v, cluster), and the centroids; scanned: vectors scanned in each round."""

    assigned: DataFrame
    centroids: np.ndarray
    scanned: list[int]


def _pushed(low: np.ndarray, high: np.ndarray | None) -> Column:
    """Entries with a key of at least low and, if given, under high, of their cluster: an OR of ranges."""

    def of(c: int) -> Column:
        inside = (F.col("cluster") == c) & (F.col("key") >= float(low[c]))
        return inside if high is None else inside & (F.col("key") < float(high[c]))

    chosen = [of(c) for c in range(len(low)) if high is None or high[c] > low[c]]
    return reduce(lambda x, y: x | y, chosen, F.lit(False))


def _scan(popped: DataFrame, centroids: np.ndarray, drift: np.ndarray) -> DataFrame:
    """Nearest centroid (of equally near ones the first) and key of popped vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.arange(len(batch))
            far = distances(_matrix(batch["v"], centroids.shape[1]), centroids)
            nearest = far.argmin(axis=1)
            upper = np.sqrt(far[at, nearest].astype(np.float64))
            far[at, nearest] = np.iinfo(np.int64).max
            lower = np.sqrt(far.min(axis=1).astype(np.float64)) if len(centroids) > 1 else np.full(len(at), np.inf)
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], batch["v"], batch["was"], pa.array(nearest, pa.int32()), pa.array(lower - upper + drift[nearest])], names=["vec_id", "v", "was", "cluster", "key"]
            )

    return popped.mapInArrow(run, ENTRY).sortWithinPartitions("cluster", "key")


def _changes(level: DataFrame, k: int, dims: int) -> np.ndarray:
    """What moved vectors add to counts (first column) and sums of the clusters; the driver gets k * (dims + 1) numbers at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), dtype=np.int64)
        for batch in batches:
            ones = np.concatenate([np.ones((len(batch), 1), dtype=np.int64), _matrix(batch["v"], dims)], axis=1)
            was, now = batch["was"].to_numpy(), batch["cluster"].to_numpy()
            np.add.at(total, now, ones)
            np.subtract.at(total, was[was >= 0], ones[was >= 0])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["cell", "n"])

    cells = level.where("was <> cluster").select("v", "was", "cluster").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(k * (dims + 1), dtype=np.int64)
    out[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    return out.reshape(k, dims + 1)


def lloyd(vectors: DataFrame, start: np.ndarray, rounds: int) -> Clusters:
    """rounds times: every vector of vectors (vec_id, v) to its nearest centroid, every centroid with vectors to their floor(mean); then once more to the nearest."""
    k, dims = start.shape
    centroids, drift = start.astype(np.int64), np.zeros(k)
    total = np.zeros((k, dims + 1), dtype=np.int64)
    levels: list[DataFrame] = []
    scanned: list[int] = []
    popped = vectors.select("vec_id", "v", F.lit(-1).alias("was"))
    for t in range(rounds + 1):
        levels.append(staged(_scan(popped, centroids, drift), "heap"))
        scanned.append(levels[-1].count())
        if t == rounds:
            break
        total += _changes(levels[-1], k, dims)
        moved = centroids.copy()
        full = total[:, 0] > 0
        moved[full] = total[full, 1:] // total[full, :1]
        step = np.sqrt(((moved - centroids).astype(np.float64) ** 2).sum(axis=1))
        others = np.array([np.delete(step, c).max(initial=0) for c in range(k)])
        before, centroids = drift, moved
        drift = before + np.where(step + others > 0, step + others + MARGIN, 0)
        expired = _pushed(before, drift)
        popped = reduce(DataFrame.union, (x.where(expired).select("vec_id", "v", F.col("cluster").alias("was")) for x in levels))
    held = _pushed(drift, None)
    return Clusters(reduce(DataFrame.union, (x.where(held).select("vec_id", "v", "cluster") for x in levels)), centroids, scanned)


def first_by_hash(vectors: DataFrame, k: int, salt: str = "2:") -> np.ndarray:
    """The k vectors whose vec_id has the least hash; the vector itself settles ties, a null vec_id comes last."""
    key = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(key.asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([r[0] for r in rows], dtype=np.int64)


def op12_centroid_clusters(spark: SparkSession, sf_dir: str, k: int = 40, rounds: int = 5) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector; without vectors no rows."""
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    start = first_by_hash(vectors, k)
    if not len(start):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    found = lloyd(vectors, start, rounds)
    places = spark.createDataFrame([(c, x.tolist()) for c, x in enumerate(found.centroids)], "cluster int, centre array<long>")  # k rows
    far = F.aggregate(F.zip_with("v", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda n, x: n + x)
    near = staged(found.assigned.join(F.broadcast(places), "cluster").select("vec_id", "cluster", far.alias("distance")), "clusters")
    sums = dict(map(tuple, near.groupBy("cluster").agg(F.sum("distance")).collect()))
    rows = [(c, sums.get(c, 0), sum(sums.values())) for c in range(len(found.centroids))]
    sums = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long")
    named = places.join(sums, "cluster").select("cluster", "cluster_inertia", "inertia", F.sha2(F.array_join(F.col("centre").cast("array<string>"), ","), 256).alias("centroid_sha256"))
    return near.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _op12_sql(k: int = 40, rounds: int = 5) -> str:
    """The rounds one after another, every vector against every centroid."""
    far = "list_sum(list_transform(list_zip(x.v, c.p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
    steps = [
        "x as materialized (select row_number() over () n, vec_id, list_transform(embedding, lambda z: floor(256 * z::double)::bigint) v from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda z: z is null or not isfinite(z))) = 0)",
        f"c0 as materialized (select (row_number() over (order by sha256('2:' || vec_id::varchar), v) - 1)::int c, v p from x order by sha256('2:' || vec_id::varchar), v limit {k})",
    ]
    for t in range(rounds + 1):
        steps.append(f"a{t} as materialized (select n, any_value(vec_id) vec_id, any_value(v) v, arg_min(c, (d, c)) c, min(d) d from (select x.n, x.vec_id, x.v, c.c, {far} d from x cross join c{t} c) group by n)")
        if t < rounds:
            steps.append(f"s{t} as materialized (select c, i, sum(z)::bigint s, count(*) m from (select c, unnest(v) z, generate_subscripts(v, 1) i from a{t}) group by c, i)")
            steps.append(f"c{t + 1} as materialized (select c.c, coalesce(m.p, c.p) p from c{t} c left join (select c, list((s - ((s % m) + m) % m) // m order by i) p from s{t} group by c) m on m.c = c.c)")
    return f"""with {", ".join(steps)}
select a.vec_id, a.c::int as cluster, a.d distance, (sum(a.d) over (partition by a.c))::bigint cluster_inertia, (sum(a.d) over ())::bigint inertia, sha256(array_to_string(c.p, ',')) centroid_sha256
from a{rounds} a join c{rounds} c on a.c = c.c"""


OP12_SQL = _op12_sql()
