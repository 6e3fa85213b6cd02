"""Chat formatting: collapse cumulative snapshots of logged conversations, then render what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = ["n_turns", "hash_a", "hash_b"]


def _part(name: str) -> Column:
    """A value with its length before it, so that no two rows of values read alike; null differs from empty."""
    c = F.col(name)
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.length(c).cast("string"), F.lit(":"), c))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, role, text, n_turns (place of the turn) and the hash of all turns up to it, in two 60-bit halves.

    Turns are in the order of (turn, role, text), nulls first. A row that repeats another in all four columns counts once.
    Rows without conv_id belong to no conversation and are left out. The hash of a prefix is the XOR of one digest for each
    turn and place, so a running aggregate over the conversation's own partition gives all of them in one pass.
    """
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    row = F.struct("turn", "role", "text")
    t = turns.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", "role", "text")
    t = t.withColumn("new", F.row_number().over(by).eqNullSafe(1) | ~F.lag(row).over(by).eqNullSafe(row))
    t = t.withColumn("n_turns", F.sum(F.col("new").cast("long")).over(upto))
    digest = F.sha2(F.concat_ws("|", F.col("n_turns").cast("string"), _part("role"), _part("text")), 256)
    for name, at in (("hash_a", 1), ("hash_b", 16)):
        half = F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
        t = t.withColumn(name, F.bit_xor(F.when(F.col("new"), half).otherwise(F.lit(0).cast("long"))).over(upto))
    return t.where("new").drop("new", "turn")


def maximal(prefixes: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies: one of each set of equal conversations (the smallest conv_id) that starts no longer one.

    Both sides of the anti-join are aggregated to one row for each hash before it, so a first turn that very many
    conversations share is one row there.
    """
    last = Window.partitionBy("conv_id")
    marked = prefixes.withColumn("last", F.max("n_turns").over(last) == F.col("n_turns"))
    whole = marked.where("last").groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    proper = marked.where(~F.col("last")).select(*KEY).distinct()
    return whole.join(proper, KEY, "left_anti").select("conv_id", "n_turns", "n_copies")


def format_chats(turns: DataFrame, before: str = "<|im_start|>", after: str = "<|im_end|>") -> DataFrame:
    """conv_id, n_turns, n_copies, rendered: the maximal conversations, in a template of role line, text and end mark.

    A turn without role is rendered as role unknown, one without text as empty text. No turns give no rows. A rendered
    conversation is one value, so it has to fit into a row.
    """
    prefixes = prefix_hashes(turns)
    turn = F.concat(F.lit(before), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(after + "\n"))
    kept = maximal(prefixes)
    # Turns of what isn't kept go before anything is rendered.
    left = prefixes.drop(*KEY[1:]).withColumnRenamed("n_turns", "at").join(kept, "conv_id")
    rendered = left.groupBy("conv_id", "n_turns", "n_copies").agg(F.collect_list(F.struct("at", turn.alias("turn"))).alias("t"))
    return rendered.select("conv_id", "n_turns", "n_copies", F.array_join(F.transform(F.array_sort("t"), lambda x: x["turn"]), "").alias("rendered"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP1_SQL = """
with t as (select distinct conv_id, turn, role, text from conversations where conv_id is not null),
c as (
  select conv_id, count(*) n, list({'r': role, 't': text} order by turn nulls first, role nulls first, text nulls first) l,
    string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), ''
      order by turn nulls first, role nulls first, text nulls first) rendered
  from t group by conv_id),
u as (select l, n, min(conv_id) conv_id, count(*) n_copies, min(rendered) rendered from c group by l, n),
p as (select distinct l[1:k] l from (select l, unnest(range(1, n)) k from u))
select conv_id, n n_turns, n_copies, rendered from u anti join p on u.l = p.l
"""
