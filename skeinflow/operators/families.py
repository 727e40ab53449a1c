"""Deduplication families: units with one key share a representative or a result.

With no current translation the first unresolved member represents the family
and the others are its destinations; one distinct current translation is
propagated to the unresolved members; several are all kept, and the first
unresolved member represents the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def family_summary(units: DataFrame, keys: list[str], order: Column, current: str, needs: str) -> DataFrame:
    """One row for each family: members, unresolved, distinct_current (at most 2 are told apart), seed, representative.

    Only minima and counts are kept for a family, whatever its size.
    """
    return units.groupBy(*keys).agg(
        F.count("*").alias("members"),
        F.count_if(F.col(needs)).alias("unresolved"),
        F.when(F.min(current).isNull(), 0).when(F.min(current) == F.max(current), 1).otherwise(2).alias("distinct_current"),
        F.min_by(current, F.when(F.col(current).isNotNull(), order)).alias("seed"),
        F.min(F.when(F.col(needs), order)).alias("representative"),
    )


def family_outcomes(units: DataFrame, keys: list[str], order: str, current: str, needs: str) -> DataFrame:
    """The units with ``outcome``: current, reuse, representative, destination or context; and ``reused``, what is propagated."""
    families = family_summary(units, keys, F.col(order), current, needs)
    renamed = families.select(*[F.col(k).alias(f"f_{k}") for k in keys], "distinct_current", "seed", "representative")
    same = None
    for k in keys:
        equal = F.col(k).eqNullSafe(F.col(f"f_{k}"))
        same = equal if same is None else same & equal
    joined = units.join(renamed, same)
    outcome = (
        F.when(F.col(current).isNotNull(), "current")
        .when(~F.col(needs), "context")
        .when(F.col("distinct_current") == 1, "reuse")
        .when(F.col(order) == F.col("representative"), "representative")
        .otherwise("destination")
    )
    return joined.select(*units.columns, outcome.alias("outcome"), F.when(outcome == "reuse", F.col("seed")).alias("reused"))


def block_ids(units: DataFrame, block: list[str], order: str, representative: Column) -> DataFrame:
    """The units of blocks that ask for anything, with ``task_id`` from 0 for representatives; a block's size is bounded."""
    from pyspark.sql import Window as W

    marked = units.withColumn("asks", representative.cast("int"))
    w = W.partitionBy(*block)
    numbered = marked.withColumn("task_id", F.when(F.col("asks") == 1, F.sum("asks").over(w.orderBy(order)) - 1)).withColumn("any", F.max("asks").over(w))
    return numbered.filter("any = 1").drop("any", "asks")
