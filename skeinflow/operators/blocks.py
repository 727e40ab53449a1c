"""Next-fit packing of ordered groups into blocks inside a scope.

A group is never split and a block never crosses a scope.  A group joins the
open block while the block isn't over the target and still isn't with the group
added; a block's first group costs ``13 + g`` characters, a further one ``1 + g``.

The rule is sequential, but what one group does depends on those before it only
through the open block, which is bounded.  The rows are range-partitioned into
chunks; each chunk says, for every number of its leading groups that may still
go into a block opened before it, in which state it ends.  That is a table of a
few hundred numbers for each chunk, not for each row; chained on the driver, it
gives each chunk its starting state, and the chunks are then packed side by side.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..functions.text import json_length

FIRST, FURTHER = 13, 1
TARGET = 24_000


def group_size(kind: Column, units: Column) -> Column:
    """Characters of a group as compact JSON; units: array of arrays of lines."""
    zero = F.lit(0).cast("long")
    line = lambda acc, x: acc + json_length(x)
    unit = lambda acc, lines: acc + 9 + F.aggregate(lines, zero, line) + F.greatest(F.size(lines) - 1, F.lit(0)) + 2
    return 8 + json_length(kind) + 10 + F.aggregate(units, zero, unit) + F.greatest(F.size(units) - 1, F.lit(0)) + 2


def _fill(sizes: list[int], cur: int | None, target: int) -> tuple[list[int], int | None, int]:
    """Block numbers (0 is the block that is open at the start), the open block's size at the end, blocks begun."""
    out, block = [], 0
    for g in sizes:
        if cur is not None and cur <= target and cur + g + FURTHER <= target:
            cur += g + FURTHER
        else:
            block += 1
            cur = g + FIRST
        out.append(block)
    return out, cur, block


def _ends(sizes: list[int], target: int) -> tuple[list[int], list[tuple[int | None, int]]]:
    """Running cost of leading groups in an open block, and (open size or None if it stays open, blocks begun) by the number of groups that fit."""
    costs, total = [], 0
    for g in sizes:
        total += g + FURTHER
        if total > target:
            break
        costs.append(total)
    ends: list[tuple[int | None, int]] = []
    # What comes of a block that starts at i; starts that meet go on together.
    after: dict[int, tuple[int, int]] = {}

    def run(i: int) -> tuple[int, int]:
        path = []
        while i not in after:
            cur, j = sizes[i] + FIRST, i + 1
            while j < len(sizes) and cur <= target and cur + sizes[j] + FURTHER <= target:
                cur += sizes[j] + FURTHER
                j += 1
            if j == len(sizes):
                after[i] = (cur, 1)
            else:
                path.append(i)
                i = j
        result = after[i]
        for p in reversed(path):
            result = after[p] = (result[0], result[1] + 1)
        return result

    for k in range(len(costs) + 1):
        ends.append((None, 0) if k == len(sizes) else run(k))
    return costs, ends


def pack_blocks(rows: DataFrame, target: int = TARGET, scope: str = "scope", order: str = "group_id", size: str = "size") -> DataFrame:
    """scope, order, size and block (from 0 in each scope) of every row; a null scope is a scope."""
    dealt = rows.select(F.col(scope).alias("scope"), F.col(order).alias("ord"), F.col(size).cast("long").alias("size"))
    kept = scratch.keep(dealt.repartitionByRange("scope", "ord").withColumn("chunk", F.spark_partition_id()), "blocks")

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["scope", "ord"], kind="stable", na_position="first")
        out = []
        for place, (name, part) in enumerate(pdf.groupby("scope", sort=False, dropna=False)):
            costs, ends = _ends(part["size"].tolist(), target)
            out.append((pdf["chunk"].iloc[0], place, None if pd.isna(name) else name, costs, [-1 if c is None else c for c, _ in ends], [n for _, n in ends]))
        # A scope inside the chunk begins and ends here; only the chunk's first and last can go on elsewhere.
        return pd.DataFrame([o for o in out if o[1] in (0, len(out) - 1)], columns=["chunk", "place", "scope", "costs", "ends", "begun"])

    kind = dict(dealt.dtypes)["scope"]
    tables = kept.groupBy("chunk").applyInPandas(summary, f"chunk int, place int, scope {kind}, costs array<long>, ends array<long>, begun array<long>")
    opened, state = [], {"scope": object(), "cur": None, "blocks": 0}
    for r in sorted(tables.collect(), key=lambda r: (r["chunk"], r["place"])):  # two rows a chunk at most
        if r["scope"] != state["scope"]:
            state = {"scope": r["scope"], "cur": None, "blocks": 0}
        if r["place"] == 0:
            opened.append((r["chunk"], state["cur"], state["blocks"]))
        cur = state["cur"]
        fit = 0 if cur is None or cur > target else bisect_right(r["costs"], target - cur)
        end, begun = r["ends"][fit], r["begun"][fit]
        if end < 0:
            end = None if cur is None else cur + (r["costs"][fit - 1] if fit else 0)
        state = {"scope": r["scope"], "cur": end, "blocks": state["blocks"] + begun}

    start = rows.sparkSession.createDataFrame(opened, "chunk int, cur long, blocks long")

    def label(pdf: pd.DataFrame, first: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["scope", "ord"], kind="stable", na_position="first")
        out = []
        for place, (_, part) in enumerate(pdf.groupby("scope", sort=False, dropna=False)):
            cur, before = (None, 0) if place or not len(first) or pd.isna(first["cur"].iloc[0]) else (int(first["cur"].iloc[0]), int(first["blocks"].iloc[0]))
            numbers, _, _ = _fill(part["size"].tolist(), cur, target)
            out += [before + b - 1 for b in numbers]
        pdf["block"] = out
        return pdf[["scope", "ord", "size", "block"]]

    schema = f"scope {kind}, ord {dict(dealt.dtypes)['ord']}, size long, block long"
    return kept.groupBy("chunk").cogroup(start.groupBy("chunk")).applyInPandas(label, schema)
