"""Chat formatting: logs that snapshot a growing conversation are collapsed to its longest state and rendered.

A conversation is the rows of one conv_id, ordered by (turn, role, text), nulls first; a row repeated exactly is one turn. All
turns are put in that order once, by ranges of conversation, turn, role and beginning of the text, so that neither a conversation that holds a third of all rows nor
turns that share one number meet in one task. A turn's place in its conversation gives its block. Prefix hashes are running
XORs of place-salted 64-bit turn hashes under two seeds: within blocks, then over the blocks of a group, then over groups.
A conversation that is a proper prefix of another one is dropped by an anti-join; of equal ones the smallest conv_id stays.
Null roles and texts differ from empty ones when compared, and are rendered as `unknown` and as nothing. Rows without a conv_id
form one conversation, rendered in segments like any other. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from basketlens.llm.common import numbered, table, written

#: Turns of one block, which is also one rendered segment; blocks of one group.
BLOCK, GROUP = 256, 65_536
#: Characters of a text by which turns are dealt to tasks (within a task whole texts order them): what the driver sees of a sampled row.
HEAD = 64


def _turn_hash(seed: int, *more):
    return F.xxhash64(F.lit(seed), *more, F.col("role").isNull(), F.col("text").isNull(), F.col("role"), F.col("text"))


def ordered(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, turn, role, text, pos, block, n): the distinct turns with their places from 1 and the sizes of their conversations."""
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    ranges = [*keys[:3], F.left("text", F.lit(HEAD)).asc_nulls_first()]
    placed = numbered(turns.select("conv_id", "turn", "role", "text").distinct(), "i", *keys, ranges=ranges)
    sizes = placed.groupBy("conv_id").agg(F.min("i").alias("first"), F.count("*").alias("n")).withColumnRenamed("conv_id", "c")
    placed = placed.join(sizes, F.col("conv_id").eqNullSafe(F.col("c"))).withColumn("pos", F.col("i") - F.col("first") + 1)
    return written(placed.select("conv_id", "turn", "role", "text", "pos", F.floor((F.col("pos") - 1) / block).alias("block"), "n"))


def _before(ends: DataFrame, within: list[str], order: str) -> DataFrame:
    """`ends` with the XORs xa and xb of the rows before each within its group."""
    w = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return ends.withColumns({f"x{c}": F.coalesce(F.bit_xor(c).over(w), F.lit(0)) for c in "ab"})


def prefix_hashes(placed: DataFrame, group: int = GROUP) -> DataFrame:
    """(conv_id, block, pos, n, h1, h2): of each ordered conversation's first pos turns of n, from 1."""
    hashed = placed.select("conv_id", "block", "pos", "n", _turn_hash(1, "pos").alias("a"), _turn_hash(2, "pos").alias("b"))
    run = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    local = written(hashed.withColumns({"a": F.bit_xor("a").over(run), "b": F.bit_xor("b").over(run)}))
    # what precedes a block: that of its group, and the blocks before it in the group
    ends = local.groupBy("conv_id", "block").agg(F.max_by("a", "pos").alias("a"), F.max_by("b", "pos").alias("b"))
    ends = ends.withColumn("g", F.floor(F.col("block") / group))
    groups = _before(ends.groupBy("conv_id", "g").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b")), ["conv_id"], "g")
    blocks = _before(ends, ["conv_id", "g"], "block")
    both = F.col("l.conv_id").eqNullSafe(F.col("r.conv_id"))
    carry = blocks.alias("l").join(groups.alias("r"), both & (F.col("l.g") == F.col("r.g"))).select(
        "l.conv_id", "l.block", *[F.col(f"l.x{c}").bitwiseXOR(F.col(f"r.x{c}")).alias(f"x{c}") for c in "ab"])
    found = local.alias("l").join(carry.alias("r"), both & (F.col("l.block") == F.col("r.block")))
    return written(found.select(
        "l.conv_id", "l.block", "pos", "n", F.col("a").bitwiseXOR(F.col("xa")).alias("h1"), F.col("b").bitwiseXOR(F.col("xb")).alias("h2")))


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv_id, copies): the conversations that stay, with the number of equal ones."""
    full = prefixes.where("pos = n").groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    proper = prefixes.where("pos < n").select("pos", "h1", "h2").distinct()
    return full.join(proper, ["pos", "h1", "h2"], "left_anti").select("conv_id", "copies")


def collapse(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each block of turns of each conversation that stays: conv_id, segment (from 0), n_turns, copies, rendered."""
    placed = ordered(turns, block)
    kept = written(maximal(prefix_hashes(placed))).withColumnRenamed("conv_id", "c")
    rows = placed.join(kept, F.col("conv_id").eqNullSafe(F.col("c")))
    parts = rows.groupBy("conv_id", F.col("block").alias("segment"), "copies").agg(
        F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("x"))
    piece = lambda x: F.concat(F.lit("<|im_start|>"), F.coalesce(x["role"], F.lit("unknown")), F.lit("\n"), F.coalesce(x["text"], F.lit("")), F.lit("<|im_end|>\n"))
    return parts.select(
        "conv_id", F.col("segment").cast("long").alias("segment"), F.size("x").cast("long").alias("n_turns"), "copies",
        F.array_join(F.transform("x", piece), "").alias("rendered"),
    )


def op1_chat(spark: SparkSession, folder: str) -> DataFrame:
    return collapse(table(spark, folder, "conversations"))


SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
p AS (
  SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER w AS pos,
         md5(string_agg(md5(coalesce(role, '-') || chr(1) || coalesce(text, '-')), '') OVER w) AS h
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
f AS (SELECT h, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE pos = n GROUP BY h),
k AS (SELECT * FROM f WHERE h NOT IN (SELECT h FROM p WHERE pos < n)),
b AS (SELECT p.*, k.copies, (pos - 1) // 256 AS segment FROM p JOIN k ON p.conv_id IS NOT DISTINCT FROM k.conv_id)
SELECT conv_id, segment::BIGINT AS segment, count(*)::BIGINT AS n_turns, copies::BIGINT AS copies,
       string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS rendered
FROM b GROUP BY conv_id, segment, copies
"""
