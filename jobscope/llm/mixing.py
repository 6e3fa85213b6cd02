"""Mixing sources to target weights with nested hash-threshold histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobscope.llm.common import maybe_broadcast, staged, word_count

#: Bits of a document's hash, and of one level of buckets.
HASH_BITS, LEVEL_BITS = 60, 12
#: Rows that tie at a threshold are numbered in so many buckets.
BUCKETS = 1024


def _before(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with the sum of each column of sums over the rows before, in an order without ties: by ranges, then within each range."""
    parts = staged(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "mix-ranges")
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = parts.groupBy("range").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    offsets = offsets.select("range", *[F.coalesce(F.sum(n).over(upto), F.lit(0)).alias(f"{n}_offset") for n in sums])
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.join(F.broadcast(offsets), "range").withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"{n}_offset") for n, c in sums.items()})
    return out.drop("range", *[f"{n}_offset" for n in sums])


def plan_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """source, source_size, target for a table of one row per source.

    Sources in code point order, null last, take the weights in turn. A target stops at most times its source's size and
    the excess goes to the others by weight. Going through the sources by size per weight, each is full as long as its
    share of what is left exceeds its limit; from the first that isn't, all share alike. Places and running sums are
    found by ranges of sources, so there may be very many.
    """
    t = _before(sizes, [F.col("source").asc_nulls_last()], {"place": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    t = t.withColumn("weight", weight).withColumn("most", F.col("source_size") * most)
    ratio = F.col("most") / F.col("weight")
    t = staged(_before(t, [ratio, F.col("place")], {"full": F.col("most"), "passed": F.col("weight")}), "mix-sources")
    size, weight = t.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    t = t.withColumn("left", F.lit(size) - F.col("full")).withColumn("others", F.lit(weight) - F.col("passed"))
    t = t.withColumn("free", F.col("weight") * F.col("left") <= F.col("most") * F.col("others"))
    first = t.where("free").agg(F.min(F.struct(ratio, "place", "left", "others")).alias("x")).first()["x"]
    left, others = (first["left"], first["others"]) if first else (0, 1)
    share = (F.col("weight") * F.lit(left)).cast("double") / F.lit(others).cast("double")
    return t.select("source", "source_size", F.when(F.col("free"), share).otherwise(F.col("most").cast("double")).alias("target"))


def find_thresholds(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """plan with repeats (whole passes over the source), threshold (hash) and, for the rows at the threshold, tied (their words) and wanted (words to take of them).

    Level by level: sum words by source and hash bucket, find the bucket in which the running sum passes the budget, and
    split only that bucket further. A level ends a source once its bucket holds a single hash.
    """
    plan = plan.withColumn("quota", F.floor("target").cast("long"))
    plan = plan.withColumn("repeats", F.when(F.col("source_size") > 0, F.expr("quota div source_size")).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("budget", F.col("quota") - F.col("repeats") * F.col("source_size")).drop("quota")
    plan = staged(plan, "mix-plan")
    open_, found, shift = plan.select("source", "budget", F.lit(0).cast("long").alias("prefix")), [], HASH_BITS
    while shift > 0:
        before, shift = shift, shift - LEVEL_BITS
        inside = sized.alias("d").join(maybe_broadcast(open_).alias("o"), F.col("d.source").eqNullSafe(F.col("o.source")) & (F.shiftright("d.hash", before) == F.col("o.prefix")))
        sums = inside.groupBy("d.source", F.shiftright("d.hash", shift).alias("prefix"))
        sums = sums.agg(F.sum("size").alias("words"), F.min("hash").alias("low"), F.max("hash").alias("high"), F.max("budget").alias("budget"))
        upto = Window.partitionBy("source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("end", F.sum("words").over(upto)).where("end > budget and end - words <= budget")
        at = staged(sums.withColumn("wanted", F.expr("budget - (end - words)")), "mix-level")
        found.append(at.where("low = high").select("source", F.col("low").alias("threshold"), F.col("words").alias("tied"), "wanted"))
        open_ = at.where("low < high").select("source", F.col("wanted").alias("budget"), "prefix")
        if open_.isEmpty():
            break
    found = reduce(DataFrame.unionByName, found)
    return plan.alias("p").join(maybe_broadcast(found).alias("f"), F.col("p.source").eqNullSafe(F.col("f.source")), "left").select("p.*", "threshold", "tied", "wanted")


def _sized(docs: DataFrame) -> DataFrame:
    digest = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("text")).cast("binary"))
    return docs.withColumn("size", word_count()).withColumn("hash", F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long"))


def _part() -> Column:
    """What a row at the threshold (d) takes of its source's plan (p), in proportion to its size and rounded down."""
    return F.floor(F.col("d.size").cast("decimal(19,0)") * F.col("p.wanted").cast("decimal(19,0)") / F.col("p.tied")).cast("long")


def _with(sized: DataFrame, plan: DataFrame) -> DataFrame:
    return sized.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))


def _take(sized: DataFrame, plan: DataFrame, columns: list[str]) -> DataFrame:
    """columns, size, source_size, target and taken of each row of sized.

    Where rounding down leaves words, rows at the threshold get one more each. They are numbered for that in BUCKETS of
    each source: rows within a bucket, after those of the buckets before.
    """
    at = F.coalesce(F.col("d.hash") == F.col("p.threshold"), F.lit(False)) & (F.col("d.size") > 0)
    whole = F.col("d.size") * F.col("p.repeats")
    given = [*[F.col(f"d.`{c}`") for c in columns], F.col("d.size").alias("size"), F.col("p.source_size").alias("source_size"), F.col("p.target").alias("target")]
    rows = _with(sized, plan)
    extra = F.when(F.col("d.hash") < F.col("p.threshold"), F.col("d.size")).when(at, _part()).otherwise(0)
    if plan.where("rest > 0").isEmpty():
        return rows.select(*given, (whole + extra).alias("taken"))
    shared = at & (F.col("p.rest") > 0)
    bucket = F.pmod(F.monotonically_increasing_id(), F.lit(BUCKETS)).cast("int")
    tied = rows.where(shared).select(F.struct(*given).alias("row"), F.col("p.source").alias("source"), (whole + _part()).alias("taken"), F.col("p.rest").alias("rest"), bucket.alias("bucket"))
    tied = staged(tied, "mix-tied")
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = tied.groupBy("source", "bucket").count().select(F.col("source").alias("of"), F.col("bucket").alias("in"), F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("offset"))
    number = F.row_number().over(Window.partitionBy("source", "bucket").orderBy(F.lit(1)))
    tied = tied.withColumn("number", number).join(maybe_broadcast(staged(counts, "mix-buckets")), F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("in")))
    one = F.when(F.col("number") + F.col("offset") <= F.col("rest"), 1).otherwise(0)
    return rows.where(~shared).select(*given, (whole + extra).alias("taken")).union(tied.select("row.*", (F.col("taken") + one).alias("taken")))


def _plan(sized: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """find_thresholds with rest: what the rows at the threshold leave of wanted when each takes its part rounded down."""
    plan = plan_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    plan = staged(find_thresholds(sized, plan), "mix-thresholds")
    cut = maybe_broadcast(plan.where("wanted > 0"))
    parts = _with(sized, cut).where(F.col("d.hash") == F.col("p.threshold")).select(F.col("p.source").alias("of"), _part().alias("part"))
    parts = parts.groupBy("of").agg(F.sum("part").alias("parts"))
    plan = plan.join(parts, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("rest", F.coalesce(F.col("wanted") - F.col("parts"), F.lit(0))).drop("of", "parts")
    return maybe_broadcast(staged(plan, "mix-rests"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: how many words the mix takes of each row, repeats counted.

    A row's hash is of its doc_id and text, so only repeats of the same row tie. Rows below the source's threshold are
    taken once more than the source's whole passes; at the threshold, what is left of the budget is shared over the rows
    that tie there (mostly one document, which is cut short), in proportion, and rows that are all alike differ by one word at
    most. A source's words taken are its target, rounded down. No row exceeds most passes.
    A null text is a document of size 0, a null source a source of its own; empty documents give no rows.
    """
    sized = staged(_sized(docs.select("doc_id", "source", "text")).drop("text"), "mix-sizes")
    return _take(sized, _plan(sized, weights, most), ["doc_id", "source"])


def take_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The rows of docs of which the mix takes words, with size, source_size, target and taken (columns of docs with these names give way)."""
    columns = [c for c in docs.columns if c not in ("size", "hash", "source_size", "target", "taken")]
    plan = _plan(staged(_sized(docs.select("doc_id", "source", "text")).drop("text"), "mix-sizes"), weights, most)
    return _take(_sized(docs.select(*columns)), plan, columns).where("taken > 0")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
with d as (
  select doc_id, source, coalesce(length(regexp_replace(regexp_replace(text, '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]+', '', 'g')), 0) size,
    ('0x' || substr(md5(concat_ws(':', cast(doc_id as varchar), text)), 1, 15))::bigint hash
  from documents),
s as (select source, sum(size)::bigint source_size, row_number() over (order by source nulls last) - 1 place from d group by source),
w as (select *, place % 3 + 1 weight, source_size * 3 most from s),
l as (
  select *, (sum(source_size) over ())::bigint - coalesce(sum(most) over (order by most / weight, place rows between unbounded preceding and 1 preceding), 0)::bigint l,
    (sum(weight) over (order by most / weight, place rows between current row and unbounded following))::bigint o
  from w),
f as (select *, weight * l <= most * o free from l),
t as (
  select *, case when free then cast(weight * first_value(l) over (partition by free order by most / weight, place) as double)
    / cast(first_value(o) over (partition by free order by most / weight, place) as double) else cast(most as double) end target
  from f),
p as (select *, case when source_size > 0 then floor(target)::bigint // source_size else 0 end repeats from t),
b as (select *, floor(target)::bigint - repeats * source_size budget from p),
h as (select source, hash, sum(size)::bigint tied from d group by source, hash),
c as (select *, sum(tied) over (partition by source order by hash)::bigint upto from h),
a as (
  select d.doc_id, d.size, b.source_size, b.target, b.repeats, c.tied, c.upto, b.budget, d.source, d.hash
  from d join b on d.source is not distinct from b.source
  join c on c.source is not distinct from d.source and c.hash = d.hash),
e as (
  select *, case when upto <= budget then size when upto - tied > budget or tied = 0 then 0 else (size::hugeint * (budget - (upto - tied)) // tied)::bigint end part,
    upto > budget and upto - tied <= budget and size > 0 cut
  from a),
n as (select *, (budget - (upto - tied) - sum(part) over (partition by source, hash))::bigint rest, row_number() over (partition by source, hash, cut order by doc_id) k from e)
select doc_id, size, source_size, target, size * repeats + part + case when cut and k <= rest then 1 else 0 end taken
from n
"""
