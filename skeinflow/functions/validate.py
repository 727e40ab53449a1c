"""Candidate checks that stop at the first violation, in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import structural_blank


def candidate_violation(source: Column, candidate: Column, fixed: Column) -> Column:
    """The first rule that a candidate (array of lines) breaks, or null.

    fixed: the number of lines is part of the shape, and a line may hold no line feed.
    """
    forbidden = F.when(fixed, F.exists(candidate, lambda c: c.rlike("[\\r\\n\\x00]"))).otherwise(F.exists(candidate, lambda c: c.rlike("[\\r\\x00]")))
    pairs = F.arrays_zip(source.alias("s"), candidate.alias("c"))
    filled = F.exists(pairs, lambda p: structural_blank(p["s"]) & (p["c"] != ""))
    emptied = F.exists(pairs, lambda p: ~structural_blank(p["s"]) & structural_blank(p["c"]))
    return (
        F.when(fixed & (F.size(source) != F.size(candidate)), "line_count")
        .when(forbidden, "forbidden_character")
        .when(F.exists(candidate, lambda c: F.contains(c, F.lit("﻿"))), "byte_order_mark")
        .when(fixed & filled, "blank_slot_filled")
        .when(fixed & emptied, "slot_emptied")
        .when(~fixed & F.forall(candidate, structural_blank), "all_blank")
    )


def reflowed_violation(candidate: Column) -> Column:
    """For text that is joined: line feeds are allowed."""
    return F.when(candidate.rlike("[\\r\\x00]"), "forbidden_character").when(F.contains(candidate, F.lit("﻿")), "byte_order_mark").when(structural_blank(candidate), "all_blank")


def group_violations(groups: DataFrame) -> DataFrame:
    """group_id, violation of groups (group_id, kind, units array<struct<id, text>>): one row for each rule that is broken."""
    ids = F.transform("units", lambda u: u["id"])
    rules = {
        "empty group id": F.col("group_id") == "",
        "empty kind": F.col("kind") == "",
        "no units": F.size("units") == 0,
        "empty unit id": F.exists("units", lambda u: u["id"] == ""),
        "repeated unit id": F.size(F.array_distinct(ids)) < F.size(ids),
        "forbidden character": F.exists("units", lambda u: u["text"].rlike("[\\r\\x00]")),
    }
    broken = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return groups.select("group_id", F.explode(broken).alias("violation"))


def repeated_groups(groups: DataFrame) -> DataFrame:
    """group_id, first and second place (path, line) of ids that occur more than once in a project."""
    place = F.struct("path", "line")
    found = groups.groupBy("group_id").agg(F.count("*").alias("n"), F.min(place).alias("a")).filter("n > 1")
    rest = groups.join(found.select(F.col("group_id").alias("g"), "a"), F.col("group_id") == F.col("g")).filter(place > F.col("a"))
    return rest.groupBy("group_id").agg(F.min("a").alias("first"), F.min(place).alias("second"))


def classify_answers(expected: DataFrame, answers: DataFrame) -> DataFrame:
    """task, output_id, verdict of answer entries (task, raw_id, shape) against expected (task, output_id)."""
    entry = answers.withColumn("output_id", F.when(F.col("raw_id").rlike("^(0|[1-9][0-9]{0,8})$"), F.col("raw_id").cast("int")))
    bad = entry.filter("output_id is null").select("task", "output_id", F.lit("invalid_id").alias("verdict"))
    counted = entry.filter("output_id is not null").groupBy("task", "output_id").agg(F.count("*").alias("n"), F.min("shape").alias("shape"))
    e = expected.select("task", "output_id", F.lit(True).alias("asked"))
    verdict = F.when(F.col("asked").isNull(), "unexpected_id").when(F.col("n").isNull(), "missing_id").when(F.col("n") > 1, "duplicate_id").when(F.col("shape") != "strings", "bad_shape").otherwise("accepted")
    return e.join(counted, ["task", "output_id"], "full").select("task", "output_id", verdict.alias("verdict")).unionByName(bad)


def decode_answer(value: Column, echo: bool) -> Column:
    """lines of an answer value (JSON text): an array of strings, or with ``echo`` the member translation of {source, translation}; null if of another shape."""
    holder = F.variant_get(F.try_parse_json(value), "$.translation", "variant") if echo else F.try_parse_json(value)
    shape = F.schema_of_variant(holder)
    return F.when(shape == "ARRAY<STRING>", holder.cast("array<string>"))


def manual_verdict(times: Column, known: Column, line_ok: Column, source_same: Column, type_same: Column, filled: Column, violation: Column, tokens_ok: Column) -> Column:
    """Checks of a manual entry in their order."""
    return (
        F.when(times > 1, "duplicate")
        .when(~known, "unknown")
        .when(~line_ok, "bad_source_line")
        .when(~source_same, "source_changed")
        .when(~type_same, "type_mismatch")
        .when(~filled, "unfilled")
        .when(violation.isNotNull(), F.concat(F.lit("invariant:"), violation))
        .when(~tokens_ok, "placeholder")
        .otherwise("ok")
    )


def token_check(source_tokens: Column, candidate_tokens: Column, preserved: Column) -> Column:
    """missing_or_extra if the tokens differ as multisets, order if the order-preserving ones stand in another order, else null."""
    keep = lambda tokens: F.filter(tokens, lambda t: F.array_contains(preserved, t))
    return F.when(~F.array_sort(source_tokens).eqNullSafe(F.array_sort(candidate_tokens)), "missing_or_extra").when(~keep(source_tokens).eqNullSafe(keep(candidate_tokens)), "order")
