"""Documents as tables of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobscope.functions.scalars import page_ranges


def text_layer(pages: DataFrame) -> DataFrame:
    """doc_id, n_pages, chars, pages_with_text, has_text: 50 characters in all, and 20 on at least half of the pages."""
    n = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", ""))
    out = pages.select("doc_id", n.alias("n")).groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.sum("n").alias("chars"), F.count_if(F.col("n") >= 20).alias("pages_with_text"))
    enough = F.col("pages_with_text") >= F.greatest(F.lit(1), F.expr("(n_pages + 1) div 2"))
    return out.withColumn("has_text", (F.col("chars") >= 50) & enough)


def merge(pages: DataFrame, members: DataFrame) -> DataFrame:
    """Pages of the documents of each job (members: job_id, file_idx, doc_id) under new numbers, files and pages in order."""
    order = Window.partitionBy("job_id").orderBy("file_idx", "page_no")
    return members.join(pages, "doc_id").select("job_id", "doc_id", "page_no", F.row_number().over(order).alias("new_page"))


def split(pages: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages of each range asked for (doc_id, ranges, page_count) with the range's ordinal, and the documents with bad ranges."""
    parsed = asked.withColumn("pairs", page_ranges(F.col("ranges"), F.col("page_count")))
    ranges = parsed.where("pairs is not null").select("doc_id", F.posexplode("pairs").alias("k", "r")).select("doc_id", (F.col("k") + 1).alias("part"), "r.first", "r.last")
    p, r = pages.alias("p"), ranges.alias("r")
    out = p.join(r, (F.col("p.doc_id") == F.col("r.doc_id")) & F.col("p.page_no").between(F.col("r.first") + 1, F.col("r.last") + 1))
    bad = parsed.where("pairs is null").select("doc_id", F.lit("INVALID_FILE").alias("error_code"))
    return out.select("p.doc_id", "part", "first", "last", "page_no"), bad


def register_page_ranges(spark) -> None:
    """SQL table function page_ranges(table(...)): of rows (doc_id, ranges, page_count) the pairs doc_id, first, last, counted from 0; no rows for a bad request.

    It takes Arrow batches whole: a request's text becomes a list column, and everything else is arithmetic on flat arrays.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql.functions import arrow_udtf

    @arrow_udtf(returnType="doc_id bigint, first bigint, last bigint")
    class PageRanges:
        def eval(self, batch: pa.RecordBatch):
            asked = pc.split_pattern(pc.fill_null(batch["ranges"], ""), ",")
            owner, part = pc.list_parent_indices(asked), pc.utf8_trim_whitespace(pc.list_flatten(asked))
            given = pc.not_equal(part, "")
            owner, part = owner.filter(given), part.filter(given)
            ends = pc.extract_regex(part, r"^(?P<first>[0-9]{1,18})(?:-(?P<last>[0-9]{1,18}))?$")
            first, last = (pc.struct_field(ends, x) for x in ("first", "last"))
            last = pc.if_else(pc.equal(last, ""), first, last)
            first, last = first.cast(pa.int64()), last.cast(pa.int64())
            most = pc.take(batch["page_count"], owner).cast(pa.int64())
            fine = pc.and_(pc.and_(pc.greater_equal(first, 1), pc.less_equal(first, last)), pc.less_equal(last, most))
            spoilt = pc.unique(owner.filter(pc.invert(pc.fill_null(fine, False))))
            keep = pc.invert(pc.is_in(owner, value_set=spoilt))
            yield pa.table({"doc_id": pc.take(batch["doc_id"], owner.filter(keep)).cast(pa.int64()), "first": pc.subtract(first.filter(keep), 1), "last": pc.subtract(last.filter(keep), 1)})

    spark.udtf.register("page_ranges", PageRanges)
