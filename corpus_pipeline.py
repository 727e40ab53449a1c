"""A corpus pipeline: quality, near duplicates, repeated passages, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each result as Parquet to the shared folder and gives it to the next stage.
All but the last return the columns of ``documents``; n_chars follows the text
where a stage changes it.  Empty inputs give empty results at every stage.

Nulls, ties and repeated rows: a null text is an empty one to the classifier
and the packer and stays null; it is near nothing, repeats nothing and holds no
benchmark passage.  Null ids, sources and languages are values of their own.
Repeated rows (equal id and text) are judged alike: all go or all stay, the near
duplicates' stage included, which drops rows whose group has a smaller id.  Of
rows that share an id with other texts none counts as earlier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow import scratch
from skeinflow.llm import decontaminate, jaccard, packing, quality, repeats
from skeinflow.llm.queries import small_batches, tokenizer_file

#: Near duplicates: five-word shingles and a similarity of 0.8.
SHINGLE, PERCENT = 5, 80


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds neither of low quality nor toxic."""
    small_batches(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).filter(quality.accepted()).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    small_batches(spark)
    return jaccard.keep_first(docs, SHINGLE, PERCENT)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one has; those of which nothing is left go."""
    small_batches(spark)
    cut = repeats.remove(docs)
    was_blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    kept = cut.filter(~was_blank | (F.coalesce("n_chars", F.lit(0)) == F.length("text")) | F.col("text").isNull())
    return kept.withColumn("n_chars", F.length("text").cast("long"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids, one row for each piece."""
    small_batches(spark)
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("quality", reject_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("decontaminate", drop_contaminated),
    ("pack", pack),
]

#: Classifier, tokenizer and automata can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
