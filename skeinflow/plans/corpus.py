"""The corpus model over the relational test tables.

files / scopes  documents.source, ordered by name
groups          one document each, kind = lang, ordered by doc_id in its scope
units           the lines of a text
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scope, group_id, kind, lines array<string>."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.coalesce("source", F.lit("")).alias("scope"), F.col("doc_id").alias("group_id"), F.coalesce("lang", F.lit("")).alias("kind"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scope, group_id, kind, ordinal (from 0), unit_id, source_text."""
    return groups(spark, sf_dir).select("scope", "group_id", "kind", F.posexplode("lines").alias("ordinal", "source_text")).withColumn("unit_id", F.format_string("u%d", "ordinal"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, manual (quality 1), rejected (toxic 1) of the documents with labels."""
    labels = table(spark, sf_dir, "labels")
    return labels.groupBy("doc_id").agg((F.max("quality") == 1).alias("manual"), (F.max("toxic") == 1).alias("rejected"))
