"""Mixing sources to target weights: tokens per source, repetition rates, and each document floor(rate) times plus one seeded
Bernoulli copy.

Every column may be null. A null text has size 0; documents of null source form a source of their own, last in order; a
document without an id draws its copy by its text. Rows that repeat an id draw alike. A source without words gets the target 0
and no copies. Columns of the input that clash with the names used here are untouched: what is added is one struct column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from basketlens.llm.common import WORD, numbered, table, written

WEIGHTS, SHARE, CAP, SEED = (5, 2, 1), 1.5, 2.0, "mix-1"


def measured(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """docs with `__mix`: size in words and the document's draw, uniform in [0, 1)."""
    key = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))))
    draw = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumn("__mix", F.struct(size.alias("size"), draw.alias("draw")))


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target). Sources in code point order, null last, take the weights in turn and share `share` of all
    words; a target stops at `cap` times its source, and what is over is shared again by weight until none is above."""
    sizes = sized.groupBy("source").agg(F.sum("__mix.size").alias("source_size"))
    ranked = written(numbered(sizes, "__rank", F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("__rank") % len(weights) + 1).cast("int"))
    plan = ranked.select("source", "source_size", weight.cast("double").alias("w"), (F.col("source_size") * cap).alias("most"))
    total = plan.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while total:  # each round shares what the capped sources leave; the level only rises, so it ends
        full = F.col("most") <= F.col("w") * F.lit(level)
        n, taken, rest = plan.agg(
            F.count_if(full), F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("w")))
        ).first()
        if n == capped or not rest:
            break
        capped, level = n, (share * total - (taken or 0.0)) / rest
    return plan.select("source", "source_size", F.least("most", F.col("w") * F.lit(level)).alias("target"))


def with_copies(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """sized with `__mix` widened by source_size, target and copies."""
    t = targets.select(F.col("source").alias("__source"), F.struct("source_size", "target").alias("__target"))
    rate = F.when(F.col("__target.source_size") > 0, F.col("__target.target") / F.col("__target.source_size")).otherwise(0.0)
    copies = (F.floor(rate) + F.when(F.col("__mix.draw") < rate - F.floor(rate), 1).otherwise(0)).cast("long")
    return (
        sized.join(t, F.col("source").eqNullSafe(F.col("__source")))
        .withColumn("__mix", F.struct("__mix.size", "__target.source_size", "__target.target", copies.alias("copies")))
        .drop("__source", "__target")
    )


def mixture(docs: DataFrame) -> DataFrame:
    """The mixed corpus: every column of docs, each row as often as the mix takes it."""
    sized = measured(docs)
    mixed = with_copies(sized, source_targets(sized))
    return (
        mixed.where("__mix.copies > 0")
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__mix.copies").cast("int"))))
        .select(*docs.columns)
    )


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    sized = written(measured(table(spark, folder, "documents").select("doc_id", "text", "source")).drop("text"))
    return with_copies(sized, source_targets(sized)).select(
        "doc_id", "__mix.size", "__mix.source_size", "__mix.target",
        (F.col("__mix.size") * F.col("__mix.copies")).alias("taken"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 13) AS BIGINT)
           / 4503599627370496.0::DOUBLE AS draw
  FROM documents),
s AS (
  SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
c AS (
  SELECT *, 2.0::DOUBLE * source_size AS most, row_number() OVER o AS k, sum(2 * source_size) OVER o AS caps, sum(w) OVER o AS ws,
         lead(2.0::DOUBLE * source_size / w) OVER o AS next_cap
  FROM s WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / w, source)),
t AS (SELECT 1.5::DOUBLE * sum(source_size) AS total, sum(w) AS weight FROM s),
l AS (
  SELECT 0 AS k, (total - 0) / weight AS level, (SELECT min(most / w) FROM c) AS next_cap FROM t
  UNION ALL
  SELECT k, (total - caps::DOUBLE) / (weight - ws), next_cap FROM c, t WHERE weight > ws),
f AS (SELECT level FROM l WHERE next_cap > level ORDER BY k LIMIT 1),
m AS (SELECT source, source_size, least(most, w * level) AS target FROM c, f)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (CASE WHEN source_size > 0 THEN size * (floor(target / source_size)::BIGINT
          + (draw < target / source_size - floor(target / source_size))::BIGINT) ELSE 0 END)::BIGINT AS taken
FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source
"""
