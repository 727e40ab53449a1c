"""Run logs: closed records, contiguous sequences, outcomes, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "timestamp string, sequence long, run_id string, level string, event string, context string, payload string, message string"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON-lines logs with ``bad``: a reason where a line isn't one of the eight closed fields."""
    from ..functions.json import closed_object

    names = [f.split()[0] for f in SCHEMA.split(", ")]
    lines = spark.read.text(path)
    record = F.from_json("value", SCHEMA)
    bad = F.when(~F.coalesce(closed_object(F.col("value"), names), F.lit(False)), "not the closed fields").when(F.try_to_timestamp(record["timestamp"]).isNull(), "bad timestamp").when(record["sequence"].isNull(), "bad sequence")
    return lines.select(record.alias("r"), F.coalesce(bad, F.lit("")).alias("bad")).select("r.*", "bad").withColumn("ts", F.try_to_timestamp("timestamp"))


def check_runs(log: DataFrame, run: str, sequence: str, event: str, ts: str, finish: str | None = None) -> DataFrame:
    """run, problem: sequences go from 1 without gaps or repeats; with ``finish``, that event is the last and only one of its kind."""
    found = log.groupBy(run).agg(
        F.count("*").alias("n"), F.min(sequence).alias("lo"), F.max(sequence).alias("hi"), F.count_distinct(sequence).alias("d"), F.count_if(F.col(event) == F.lit(finish)).alias("ends"), F.max_by(event, sequence).alias("last"), F.count_if(F.col(ts).isNull()).alias("undated")
    )
    problem = F.when(F.col("d") < F.col("n"), "repeated sequence").when((F.col("lo") != 1) | (F.col("hi") != F.col("n")), "gap in sequence").when(F.col("undated") > 0, "undated")
    if finish is not None:
        problem = problem.when(F.col("ends") == 0, "not finished").when(F.col("ends") > 1, "finished twice").when(F.col("last") != finish, "goes on after the end")
    return found.select(run, F.coalesce(problem, F.lit("")).alias("problem"))


def outcomes(log: DataFrame, event: str, value: str, large: float = 50) -> DataFrame:
    return log.groupBy(F.col(event).alias("outcome")).agg(F.count("*").alias("n"), F.count_if(F.col(value) > large).alias("large"))


def merge_summaries(summaries: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    return summaries.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters])
