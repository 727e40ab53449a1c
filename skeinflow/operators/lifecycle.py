"""State transitions as rewrites of frames: snapshots, reconciliation, conditional commits, upserts, deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def natural_snapshot(files: DataFrame, groups: DataFrame, units: DataFrame, manual: DataFrame, rejected: DataFrame) -> DataFrame:
    """files -> groups -> units, with manual and rejected rows where there are any; one row for each unit."""
    return (
        files.join(groups, "path")
        .join(units, "group_id")
        .join(manual, ["group_id", "unit_id"], "left")
        .join(rejected, ["group_id", "unit_id"], "left")
    )


def detached(manual: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    """Manual rows whose unit is gone; they are kept, and current again when it comes back."""
    return manual.join(units, keys, "left_anti")


def reconcile(before: DataFrame, after: DataFrame) -> DataFrame:
    """group_id, change (new, gone, kept, cleared) between two snapshots of (group_id, kind, unit_ids, texts).

    A group is kept whole if kind, number, order and texts are the same and no
    unit id has moved to another place; ids that are only renamed clear their unit.
    """
    b = before.select(F.col("group_id").alias("g1"), F.col("kind").alias("k1"), F.col("unit_ids").alias("u1"), F.col("texts").alias("t1"))
    a = after.select(F.col("group_id").alias("g2"), F.col("kind").alias("k2"), F.col("unit_ids").alias("u2"), F.col("texts").alias("t2"))
    moved = F.exists(F.sequence(F.lit(1), F.greatest(F.size("u2"), F.lit(1))), lambda i: (F.get("u1", i - 1) != F.get("u2", i - 1)) & F.array_contains(F.col("u1"), F.get("u2", i - 1)))
    same = F.col("k1").eqNullSafe(F.col("k2")) & F.col("t1").eqNullSafe(F.col("t2")) & ~F.coalesce(moved, F.lit(False))
    change = F.when(F.col("g1").isNull(), "new").when(F.col("g2").isNull(), "gone").when(same, "kept").otherwise("cleared")
    renamed = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size("u2"), F.lit(1))), lambda i: F.get("u1", i - 1) != F.get("u2", i - 1)))
    return b.join(a, F.col("g1") == F.col("g2"), "full").select(F.coalesce("g2", "g1").alias("group_id"), change.alias("change"), F.when(change == "kept", renamed).otherwise(0).cast("long").alias("renamed_units"))


def match_keys(expected: DataFrame, given: DataFrame, keys: list[str]) -> DataFrame:
    """keys, problem of planning inputs against facts: duplicate, missing or unknown."""
    e = expected.select(*keys, F.lit(1).alias("e")).distinct()
    g = given.groupBy(*keys).agg(F.count("*").alias("n"))
    problem = F.when(F.col("n") > 1, "duplicate").when(F.col("n").isNull(), "missing").when(F.col("e").isNull(), "unknown")
    return e.join(g, keys, "full").select(*keys, problem.alias("problem")).filter("problem is not null")


def compare_and_swap(units: DataFrame, pending: DataFrame, keys: list[str], value: str, digests: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(units after the commit, conflicts in input order).

    pending: keys, expected, ``value`` and ordinal; a row applies where the
    unit's value still is the expected one, null being a value.  ``digests``
    (one row: seen, now) gates the whole batch: where the input has changed since
    it was read, every row is a conflict.  Keys are unique in a batch, as they are
    in units: rows that share one are conflicts, all of them.
    """
    twice = pending.groupBy(*keys).agg(F.count("*").alias("__c")).filter("__c > 1").drop("__c")
    shared = pending.join(twice, keys, "left_semi").select(*keys, "ordinal")
    pending = pending.join(twice, keys, "left_anti")
    if digests is not None:
        same_input = digests.groupBy().agg(F.coalesce(F.bool_and(F.col("seen").eqNullSafe(F.col("now"))), F.lit(False)).alias("__same"))  # one row
        gated = pending.join(F.broadcast(same_input), F.lit(True))
        late, pending = gated.filter("not __same").select(*keys, "ordinal"), gated.filter("__same").drop("__same")
        shared = shared.unionByName(late)
    p = pending.select(*[F.col(k).alias(f"p_{k}") for k in keys], "expected", F.col(value).alias("put"), "ordinal")
    same: Column = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"p_{k}"))
    hit = same & F.col(value).eqNullSafe(F.col("expected"))
    applied = units.join(p, hit, "left").select(*[F.when(F.col("ordinal").isNotNull(), F.col("put")).otherwise(F.col(value)).alias(c) if c == value else F.col(c) for c in units.columns])
    conflicts = p.join(units, hit, "left_anti").select(*[F.col(f"p_{k}").alias(k) for k in keys], "ordinal")
    return applied, conflicts.unionByName(shared)


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``changes`` replace those with equal keys and are added where there are none."""
    return current.join(changes, keys, "left_anti").unionByName(changes)


def upsert_where(current: DataFrame, changes: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    """upsert() of the changes whose keys are in ``allowed``."""
    return upsert(current, changes.join(allowed, keys, "left_semi"), keys)


def delete(current: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return current.join(gone, keys, "left_anti")


def cascade(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """The children that still have a parent."""
    return children.join(parents, keys, "left_semi")


def apply_manual(state: DataFrame, manual: DataFrame, keys: list[str]) -> DataFrame:
    """Automatic text and rejection are cleared where a manual row is applied."""
    m = manual.select(*keys, F.col("text").alias("manual_text"))
    return state.join(m, keys, "left").select(
        *keys,
        F.when(F.col("manual_text").isNull(), F.col("automatic")).alias("automatic"),
        (F.col("rejected") & F.col("manual_text").isNull()).alias("rejected"),
        F.coalesce("manual_text", "manual").alias("manual"),
    )


def state_of(manual: Column, automatic: Column, rejected: Column) -> Column:
    """current, rejected or pending: manual work first, then automatic, then a rejected candidate."""
    return F.when(manual | automatic, "current").when(rejected, "rejected").otherwise("pending")


def needs_candidate(needs_translation: Column, has_current: Column, rejected: Column, retry_rejected: bool) -> Column:
    return needs_translation & ~has_current & (F.lit(retry_rejected) | ~rejected)
