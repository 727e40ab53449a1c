"""Relations between identified rows: coverage, audits, consistency, shared values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key, problem (missing, unexpected) of two id lists."""
    e = expected.select(F.col(key).alias("e")).distinct()
    f = found.select(F.col(key).alias("f")).distinct()
    both = e.join(f, F.col("e") == F.col("f"), "full")
    return both.select(F.coalesce("e", "f").alias(key), F.when(F.col("f").isNull(), "missing").when(F.col("e").isNull(), "unexpected").alias("problem")).filter("problem is not null")


def audit(expected: DataFrame, actual: DataFrame, key: str, values: list[str]) -> DataFrame:
    """kind (missing, unexpected, mismatched), n and the smallest key of each, comparing values null-safely."""
    a = actual.select(F.col(key).alias("a_key"), *[F.col(v).alias(f"a_{v}") for v in values])
    same: Column = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"a_{v}"))
    kind = F.when(F.col("a_key").isNull(), "missing").when(F.col(key).isNull(), "unexpected").when(~same, "mismatched")
    joined = expected.join(a, F.col(key) == F.col("a_key"), "full").select(F.coalesce(key, "a_key").alias("k"), kind.alias("kind")).filter("kind is not null")
    return joined.groupBy("kind").agg(F.count("*").alias("n"), F.min("k").alias("first"))


def member_consistency(summaries: DataFrame, rows: DataFrame, group: str, member: str) -> DataFrame:
    """group, missing, extra: members that a group's summary (array ``members``, ``complete``) names and the rows don't have, and the other way round where it claims to be complete.

    Members are compared as rows, so that no group is gathered.
    """
    said = summaries.select(group, F.explode("members").alias(member)).distinct().withColumn("said", F.lit(1))
    there = rows.select(group, member).distinct().withColumn("there", F.lit(1))
    both = said.join(there, [group, member], "full").groupBy(group).agg(F.count_if(F.col("there").isNull()).alias("missing"), F.count_if(F.col("said").isNull()).alias("extra"))
    return summaries.select(group, "complete").join(both, group).select(group, "missing", F.when(F.col("complete"), F.col("extra")).otherwise(0).alias("extra")).filter("missing > 0 or extra > 0")


def decisions(targets: DataFrame, rows: DataFrame) -> DataFrame:
    """row_id, decision, problem: decisions on 'group:<id>' or 'member:<id>' spread over rows (row_id, group_id); a row decided both ways is a problem."""
    t = targets.select(F.split_part("target", F.lit(":"), F.lit(1)).alias("kind"), F.regexp_replace("target", "^[^:]*:", "").alias("id"), "decision")
    by_group = rows.join(t.filter("kind = 'group'"), F.col("group_id").cast("string") == F.col("id")).select("row_id", "decision", F.lit("group").alias("via"))
    by_member = rows.join(t.filter("kind = 'member'"), F.col("row_id").cast("string") == F.col("id")).select("row_id", "decision", F.lit("member").alias("via"))
    both = by_group.unionByName(by_member).groupBy("row_id").agg(F.min("decision").alias("decision"), F.count_distinct("via").alias("ways"))
    return both.select("row_id", "decision", F.when(F.col("ways") > 1, "both").otherwise("").alias("problem"))


def context(requested: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all units of each requested unit's group in request order, unknown requests); requested: ordinal, unit_key; index: unit_key, group_id, unit_ordinal."""
    groups = requested.join(index.select("unit_key", "group_id"), "unit_key").select("ordinal", "group_id").distinct()
    found = groups.join(index.select(F.col("group_id"), F.col("unit_key").alias("member"), "unit_ordinal"), "group_id").select("ordinal", "group_id", "member", "unit_ordinal")
    return found, requested.join(index, "unit_key", "left_anti")


def related(tokens: DataFrame, key: str, token: str, at_least: int = 2) -> DataFrame:
    """u, v, shared: all pairs of keys with at least so many tokens in common; a token of n keys makes n (n - 1) / 2 pairs (related_links makes n links)."""
    rows = tokens.select(F.col(key).alias("k"), F.col(token).alias("t")).distinct()
    telling = rows.groupBy("t").agg(F.count("*").alias("n")).filter("n > 1").select("t")
    kept = rows.join(telling, "t", "left_semi")
    return kept.select("t", F.col("k").alias("u")).join(kept.select("t", F.col("k").alias("v")), "t").filter("u < v").groupBy("u", "v").agg(F.count("*").alias("shared")).filter(F.col("shared") >= at_least)


def related_links(tokens: DataFrame, key: str, token: str, at_least: int = 2) -> DataFrame:
    """u, v: links with the same components as related()'s, without its pairs.

    Keys that share a set of ``at_least`` tokens are linked to the smallest of them.  A key with m tokens has
    m over ``at_least`` such sets, however many keys share them.
    """
    rows = tokens.select(F.col(key).alias("k"), F.col(token).alias("t")).filter("t is not null").distinct()
    sets = rows.select("k", F.col("t").alias("last"), F.array("t").alias("set"))
    for _ in range(at_least - 1):
        sets = sets.join(rows, "k").filter("t > last").select("k", F.col("t").alias("last"), F.concat("set", F.array("t")).alias("set"))
    least = sets.groupBy("set").agg(F.min("k").alias("u"), F.count("*").alias("n")).filter("n > 1").select("set", "u")
    return sets.join(least, "set").select("u", F.col("k").alias("v")).filter("u < v").distinct()
