"""One-way analysis of variance for many variables in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..functions.tails import f_upper_column


def anova_oneway(df: DataFrame, group: str, variables: Sequence[str]) -> DataFrame:
    """F, p, eta squared and significance flags per variable, smallest p first.

    One aggregate keeps count, mean and variance per group and variable; all later steps
    work on groups x variables rows.
    """
    x = {v: F.nanvl(F.col(v).cast("double"), F.lit(None).cast("double")) for v in variables}
    known = df.where(F.col(group).isNotNull()).select(group, *[c.alias(v) for v, c in x.items()])
    stats = known.groupBy(group).agg(*[
        F.struct(
            F.count(v).cast("double").alias("n"), F.avg(v).alias("mean"),
            F.coalesce(F.var_samp(v), F.lit(0.0)).alias("var"),
        ).alias(v) for v in variables
    ])
    cells = [F.struct(F.lit(v).alias("Variable"), F.col(v)["n"].alias("n"), F.col(v)["mean"].alias("mean"),
                      F.col(v)["var"].alias("var")) for v in variables]
    long = stats.select(F.inline(F.array(*cells))).where("n > 0")
    whole = W.partitionBy("Variable")
    grand = F.sum(F.col("n") * F.col("mean")).over(whole) / F.sum("n").over(whole)
    sums = (
        long.withColumn("grand", grand)
        .groupBy("Variable")
        .agg(
            F.sum(F.col("n") * (F.col("mean") - F.col("grand")) * (F.col("mean") - F.col("grand"))).alias("ssb"),
            F.sum((F.col("n") - 1) * F.col("var")).alias("ssw"),
            (F.count(F.lit(1)) - 1).cast("double").alias("df1"),
            (F.sum("n") - F.count(F.lit(1))).alias("df2"),
        )
        .withColumn("F_Value", ratio(ratio(F.col("ssb"), F.col("df1")), ratio(F.col("ssw"), F.col("df2"))))
        .withColumn("P_Value", f_upper_column("F_Value", "df1", "df2"))
        .withColumn("Eta_Squared", ratio(F.col("ssb"), F.col("ssb") + F.col("ssw")))
    )
    flag = lambda level: F.when(F.col("P_Value") < level, "Yes").otherwise("No")
    return sums.select(
        "Variable", "F_Value", "P_Value", "Eta_Squared",
        flag(0.05).alias("Significant_5pct"), flag(0.01).alias("Significant_1pct"),
    ).orderBy("P_Value", F.desc("F_Value"), "Variable")


def anova_report(results: DataFrame) -> DataFrame:
    """Rounded table; p-values below 0.001 as text."""
    p = F.when(F.col("P_Value") < 0.001, "<0.001").otherwise(F.format_string("%s", F.round("P_Value", 4)))
    return results.select(
        "Variable",
        F.round("F_Value", 2).alias("F value"),
        p.alias("p-value"),
        F.round("Eta_Squared", 3).alias("Eta squared"),
        F.col("Significant_5pct").alias("Significant at 5%"),
    )
