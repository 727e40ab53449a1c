"""Mutation claims: who locks which resource, and where two owners collide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resource_conflicts(claims: DataFrame) -> DataFrame:
    """resource, left_owner, right_owner, pairs: owners that meet on a resource where one of them claims it exclusively.

    claims: owner, group_id, resource, access.  Each owner's claims on a
    resource are summed up first, so that a hot resource has a row for each owner
    and never its pairs of claims.
    """
    by_owner = claims.groupBy("resource", "owner").agg(F.count("*").alias("n"), F.count_if(F.col("access") == "exclusive").alias("x"))
    a = by_owner.select("resource", F.col("owner").alias("left_owner"), F.col("n").alias("n1"), F.col("x").alias("x1"))
    b = by_owner.select("resource", F.col("owner").alias("right_owner"), F.col("n").alias("n2"), F.col("x").alias("x2"))
    pairs = F.col("n1") * F.col("n2") - (F.col("n1") - F.col("x1")) * (F.col("n2") - F.col("x2"))
    return a.join(b, "resource").filter((F.col("left_owner") < F.col("right_owner")) & (F.col("x1") + F.col("x2") > 0)).select("resource", "left_owner", "right_owner", pairs.alias("pairs"))


def first_conflict(claims: DataFrame) -> DataFrame:
    """The first colliding pair in the order of resource, owners and groups (a top-k report of one row)."""
    by_owner = claims.groupBy("resource", "owner").agg(F.min("group_id").alias("any_group"), F.min(F.when(F.col("access") == "exclusive", F.col("group_id"))).alias("x_group"))
    a = by_owner.select("resource", F.col("owner").alias("left_owner"), F.col("any_group").alias("a1"), F.col("x_group").alias("x1"))
    b = by_owner.select("resource", F.col("owner").alias("right_owner"), F.col("any_group").alias("a2"), F.col("x_group").alias("x2"))
    met = a.join(b, "resource").filter((F.col("left_owner") < F.col("right_owner")) & (F.col("x1").isNotNull() | F.col("x2").isNotNull()))
    pair = F.array_min(F.filter(F.array(F.when(F.col("x1").isNotNull(), F.struct(F.col("x1").alias("l"), F.col("a2").alias("r"))), F.when(F.col("x2").isNotNull(), F.struct(F.col("a1").alias("l"), F.col("x2").alias("r")))), lambda p: p.isNotNull()))
    found = met.select("resource", "left_owner", "right_owner", pair.alias("p"))
    return found.select("resource", "left_owner", "right_owner", F.col("p.l").alias("left_group"), F.col("p.r").alias("right_group")).orderBy("resource", "left_owner", "right_owner", "left_group", "right_group").limit(1)


def claim_summary(claims: DataFrame, order: str) -> DataFrame:
    """resource, claims, problem (mixed access, or several exclusive claims), and the group that represents it: the least by ``order``."""
    found = claims.groupBy("resource").agg(
        F.count("*").alias("claims"), F.count_if(F.col("access") == "exclusive").alias("exclusive"), F.count_if(F.col("access") == "intent").alias("intent"), F.min_by("group_id", F.struct(order, "group_id")).alias("representative")
    )
    problem = F.when((F.col("exclusive") > 0) & (F.col("intent") > 0), "mixed").when(F.col("exclusive") > 1, "exclusive twice")
    return found.select("resource", "claims", F.coalesce(problem, F.lit("")).alias("problem"), "representative")


def lock_sets(claims: DataFrame) -> DataFrame:
    """group_id, resource, access, conflict: exclusive dominates inside a claim; two claims of a group clash if one is exclusive."""
    per_claim = claims.groupBy("group_id", "claim", "resource").agg(F.max((F.col("access") == "exclusive").cast("int")).alias("x"))
    return per_claim.groupBy("group_id", "resource").agg(F.when(F.max("x") == 1, "exclusive").otherwise("intent").alias("access"), ((F.count("*") > 1) & (F.max("x") == 1)).alias("conflict"))
