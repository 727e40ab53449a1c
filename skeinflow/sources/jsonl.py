"""Corpus files: one group as a JSON object on each line, read strictly and written back.

A file is read whole (its bytes give line numbers and digests), so a file must
fit a task; the number of files has no bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json import closed_object
from ..functions.text import frame

GROUP = "struct<id: string, kind: string, units: array<struct<id: string, text: string>>>"


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """path (below the root), raw of every .jsonl file with content; lower-case endings only."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").load(root)
    # Spark's listing gives absolute URIs; the part below the root is the file's name in the project.
    tail = root.rstrip("/").rsplit("/", 1)[-1]
    return files.select(F.regexp_replace("path", f"^.*?/{_quote(tail)}/", "").alias("path"), F.col("content").alias("raw"))


def _quote(text: str) -> str:
    import re

    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def read_groups(files: DataFrame) -> DataFrame:
    """path, line (from 1), group, problem of every line; a final line feed ends the last line, an empty file has none."""
    text = F.try_validate_utf8("raw")
    body = F.regexp_replace(text, "\r?\n\\z", "")
    lines = files.filter(F.length("raw") > 0).select("path", F.posexplode_outer(F.when(text.isNotNull(), F.split(body, "\r?\n"))).alias("n", "json"))
    group = F.from_json("json", GROUP)
    units = F.get_json_object("json", "$.units")
    closed_units = F.forall(F.coalesce(F.from_json(units, "array<string>"), F.array().cast("array<string>")), lambda u: F.coalesce(closed_object(u, ["id", "text"]), F.lit(False)))
    problem = (
        F.when(F.col("json").isNull(), "not UTF-8")
        .when(F.trim("json") == "", "blank line")
        .when(~F.coalesce(closed_object(F.col("json"), ["id", "kind", "units"]), F.lit(False)), "not the closed fields")
        .when(~closed_units, "not the closed unit fields")
        .when(group["id"].isNull() | group["kind"].isNull() | group["units"].isNull() | F.exists(group["units"], lambda u: u["id"].isNull() | u["text"].isNull()), "wrong type")
    )
    return lines.select("path", (F.coalesce("n", F.lit(0)) + 1).alias("line"), group.alias("group"), problem.alias("problem"))


def units_of(groups: DataFrame) -> DataFrame:
    """path, line, group_id, kind, ordinal, unit_id, text in the files' order (carried as columns)."""
    fine = groups.filter("problem is null")
    return fine.select("path", "line", F.col("group.id").alias("group_id"), F.col("group.kind").alias("kind"), F.posexplode("group.units").alias("ordinal", "u")).select("path", "line", "group_id", "kind", "ordinal", F.col("u.id").alias("unit_id"), F.col("u.text").alias("text"))


def raw_digests(files: DataFrame) -> DataFrame:
    """path, digest of every file's bytes."""
    return files.select("path", F.sha2(F.concat(frame(1, F.col("path")), F.col("raw")), 256).alias("digest"))


def asset_digests(groups: DataFrame) -> DataFrame:
    """path, digest of every file's parsed content, which spacing and key order don't change."""
    each = groups.filter("problem is null").select("path", "line", F.sha2(F.concat(frame(1, F.col("group.id")), frame(2, F.col("group.kind")), F.aggregate("group.units", F.lit("").cast("binary"), lambda acc, u: F.concat(acc, frame(3, u["id"]), frame(4, u["text"])))), 256).alias("h"))
    ordered = F.array_sort(F.collect_list(F.struct("line", "h")))
    return each.groupBy("path").agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["h"]), ","), 256).alias("digest"))


def tree_digest(digests: DataFrame) -> DataFrame:
    """One digest of a list of (path, digest): the sorted list's; its size is the number of files."""
    return digests.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "digest"))), lambda x: F.concat(x["path"], F.lit("\n"), x["digest"])), "\n"), 256).alias("digest"))


def to_lines(groups: DataFrame) -> DataFrame:
    """path, line, json: groups (path, line, id, kind, units) as compact objects."""
    return groups.select("path", "line", F.to_json(F.struct("id", "kind", "units")).alias("json"))


def write_lines(lines: DataFrame, out: str) -> None:
    """One folder for each path, its lines in order."""
    lines.repartition("path").sortWithinPartitions("path", "line").select(F.regexp_replace("path", "/", "%2F").alias("path"), F.col("json").alias("value")).write.partitionBy("path").text(out)


def round_trip_differences(before: DataFrame, after: DataFrame, free: str = "text") -> DataFrame:
    """Rows that differ apart from the column that may: both ways, as multisets."""
    a, b = before.drop(free), after.drop(free)
    return a.exceptAll(b).withColumn("side", F.lit("lost")).unionByName(b.exceptAll(a).withColumn("side", F.lit("new")))
