"""Operators on ordered rows: runs, pairing, packing of neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def scope_runs(rows: DataFrame, partition: list[str], order: str, scope: str) -> DataFrame:
    """The rows with ``run``: how many times the scope has changed before, in each partition."""
    w = W.partitionBy(*partition).orderBy(order)
    changed = (~F.col(scope).eqNullSafe(F.lag(scope).over(w)) & F.lag(F.lit(1)).over(w).isNotNull()).cast("int")
    return rows.withColumn("changed", changed).withColumn("run", F.sum("changed").over(w)).drop("changed")


def split_scopes(runs: DataFrame, partition: list[str], scope: str) -> DataFrame:
    """Scopes whose rows don't stand together: partition, scope, runs."""
    return runs.groupBy(*partition, scope).agg(F.count_distinct("run").alias("runs")).filter("runs > 1")


def paired_durations(events: DataFrame, key: str, order: list[str], event: str, ts: str, start: str, stop: str) -> DataFrame:
    """key, start_ts, micros: each stop with the start before it where nothing of either kind lies between (phases that aren't nested)."""
    w = W.partitionBy(key).orderBy(*order)
    both = events.filter(F.col(event).isin(start, stop))
    before = both.withColumns({"was": F.lag(event).over(w), "since": F.lag(ts).over(w)})
    return before.filter((F.col(event) == stop) & (F.col("was") == start)).select(key, F.col("since").alias("start_ts"), F.timestamp_diff("MICROSECOND", F.col("since"), F.col(ts)).alias("micros"))


def nested_durations(events: DataFrame, key: str, order: list[str], event: str, ts: str, start: str, stop: str) -> DataFrame:
    """key, start_ts, micros with phases as a stack: a stop ends the nearest open start of its depth."""
    w = W.partitionBy(key).orderBy(*order)
    both = events.filter(F.col(event).isin(start, stop))
    depth = both.withColumn("step", F.when(F.col(event) == start, 1).otherwise(-1)).withColumn("after", F.sum("step").over(w)).withColumn("depth", F.when(F.col("step") == 1, F.col("after")).otherwise(F.col("after") + 1))
    level = W.partitionBy(key, "depth").orderBy(*order)
    paired = depth.withColumns({"was": F.lag(event).over(level), "since": F.lag(ts).over(level)})
    return paired.filter((F.col(event) == stop) & (F.col("was") == start)).select(key, F.col("since").alias("start_ts"), F.timestamp_diff("MICROSECOND", F.col("since"), F.col(ts)).alias("micros"))


def islands(rows: DataFrame, partition: list[str], order: str, starts: str) -> DataFrame:
    """The rows with ``island``: each row where ``starts`` holds begins a new one."""
    return rows.withColumn("island", F.sum(F.col(starts).cast("int")).over(W.partitionBy(*partition).orderBy(order)))


def nearby(rows: DataFrame, other: DataFrame, key: str, line: str, reach: int, name: str) -> DataFrame:
    """The rows with ``name``: how many rows of ``other`` with the same key lie within ``reach`` lines.

    The line axis is cut into bands of ``reach`` lines, so that the join is one of equal (key, band).
    """
    width = max(reach, 1)
    a = rows.withColumn("band", F.explode(F.array(*[F.floor(F.col(line) / width) + i for i in (-1, 0, 1)])))
    b = other.select(F.col(key).alias("k2"), F.col(line).alias("l2"), F.floor(F.col(line) / width).alias("b2"))
    near = (F.col(key) == F.col("k2")) & (F.col("band") == F.col("b2")) & (F.abs(F.col(line) - F.col("l2")) <= reach)
    return a.join(b, near, "left").groupBy(*[F.col(c) for c in rows.columns]).agg(F.count("l2").alias(name))


def first_examples(rows: DataFrame, key: list[str], order: list[str], n: int = 5) -> DataFrame:
    """The first n rows of each key (a top-k report)."""
    return rows.withColumn("example", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter(F.col("example") <= n)
