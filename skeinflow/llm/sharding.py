"""Sharding by extendible hashing, in DataFrame operations.

A row's place is a 60-bit hash of its key.  The directory is indexed by the
leading bits; a bucket over the byte limit is split on one more bit, and only
such buckets are.  Byte totals of the finest cells are aggregated first (one
partial row per cell and task), the coarser levels come from those totals,
and only rows of cells that are still too large are aggregated again with
more bits.  What is joined back to the rows is one row per shard.

Defined results: a null key hashes as an empty string and a null text has no
bytes; rows with one and the same hash can't be told apart and stay in one
shard, marked ``oversized`` if they exceed the limit, as is a single row above
it; an empty table has no shards; columns of the rows that have the name of an
added one get ``_own`` after it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 60
MAX_BYTES = 32 << 20
#: Directory levels below the expected depth that the first aggregation covers, and levels added each time.
SPARE_LEVELS, MORE_LEVELS = 5, 10
BROADCAST_SHARDS = 200_000


def place(key: Column) -> Column:
    """60 bits of the key's MD5, as a non-negative long."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def _prefix(h: Column, depth: Column) -> Column:
    return F.call_function("shiftright", h, (F.lit(BITS) - depth).cast("int"))


def directory(docs: DataFrame, max_bytes: int = MAX_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """depth, prefix, shard_bytes, shard_rows, oversized: one row for each shard."""
    rows = docs.select(place(F.col(key)).alias("h"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("b"))
    total = rows.agg(F.sum("b")).first()[0] or 0
    deep = min(BITS, max(0, math.ceil(math.log2(max(1, total / max_bytes)))) + SPARE_LEVELS)
    low, leaves = 0, None
    while True:
        sums = [F.sum("b").alias("b"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")]
        cells = rows.withColumn("prefix", _prefix(F.col("h"), F.lit(deep))).groupBy("prefix").agg(F.sum("b").alias("b"), F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        levels = (
            cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(deep))))
            .withColumn("prefix", F.call_function("shiftright", "prefix", (F.lit(deep) - F.col("depth")).cast("int")))
            .groupBy("depth", "prefix")
            .agg(*sums)
        )
        too_large = (F.col("b") > max_bytes) & (F.col("lo") != F.col("hi"))
        parents = levels.filter(too_large).select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
        fit = levels.filter(~too_large)
        # What fits at the first level of a pass has its parent, an oversized cell, in the pass before.
        found = fit.join(parents, ["depth", "prefix"], "left_semi").unionByName(fit.filter(F.col("depth") == low))
        leaves = found if leaves is None else leaves.unionByName(found)
        over = cells.filter(too_large).select(F.col("prefix").alias("p"))
        if deep == BITS or over.isEmpty():
            break
        rows = rows.join(over, _prefix(rows["h"], F.lit(deep)) == over["p"], "left_semi")
        low, deep = deep + 1, min(BITS, deep + MORE_LEVELS)
    return leaves.select("depth", "prefix", F.col("b").alias("shard_bytes"), F.col("n").alias("shard_rows"), (F.col("b") > max_bytes).alias("oversized"))


def assign(docs: DataFrame, shards: DataFrame, key: str = "doc_id", broadcast_limit: int = BROADCAST_SHARDS) -> DataFrame:
    """The rows with ``shard`` (bits of the directory entry, empty for a single shard) and what directory() says of it."""
    depths = shards.groupBy("depth").agg(F.count("*").alias("n")).collect()  # at most 61 rows
    named = shards.select(
        F.col("depth").alias("__depth"),
        F.col("prefix").alias("__prefix"),
        F.when(F.col("depth") == 0, "").otherwise(F.expr("right(lpad(bin(prefix), 64, '0'), depth)")).alias("__shard"),
        F.col("shard_bytes").alias("__bytes"),
        F.col("shard_rows").alias("__rows"),
        F.col("oversized").alias("__over"),
    )
    if sum(d["n"] for d in depths) <= broadcast_limit:
        named = F.broadcast(named)
    tried = F.array(*[F.lit(d) for d in sorted(d["depth"] for d in depths)]).cast("array<int>")
    probes = docs.withColumn("__h", place(F.col(key))).withColumn("__d", F.explode(tried))
    names = {"shard": "__shard", "depth": "__depth", "shard_bytes": "__bytes", "shard_rows": "__rows", "oversized": "__over"}
    joined = probes.join(named, (F.col("__d") == F.col("__depth")) & (_prefix(F.col("__h"), F.col("__d")) == F.col("__prefix")))
    return joined.select(*[probes[c].alias(f"{c}_own" if c in names else c) for c in docs.columns], *[F.col(c).alias(n) for n, c in names.items()])


def write_shards(docs: DataFrame, path: str, max_bytes: int = MAX_BYTES, key: str = "doc_id", text: str = "text") -> None:
    """One Parquet folder ``shard=<bits>`` for each shard."""
    placed = assign(docs, directory(docs, max_bytes, key, text), key)
    placed.drop("depth", "shard_bytes", "shard_rows", "oversized").withColumn("shard", F.concat(F.lit("b"), F.col("shard"))).repartition("shard").write.partitionBy("shard").parquet(path)
