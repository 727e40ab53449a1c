"""Interval algebra on arrays of half-open spans struct<start, end>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def merged(spans: Column) -> Column:
    """Sorted union: spans that overlap or touch become one."""

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (s["start"] <= last["end"])
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when(joins, grown).otherwise(F.concat(acc, F.array(s)))

    empty = F.filter(spans, lambda s: F.lit(False))
    return F.aggregate(F.array_sort(spans), empty, step)


def has_overlap(spans: Column) -> Column:
    """Whether two spans of an array share a position."""
    ordered = F.array_sort(spans)
    return F.aggregate(
        ordered,
        F.struct(F.lit(False).alias("bad"), F.lit(-1).cast("long").alias("end")),
        lambda acc, s: F.struct((acc["bad"] | (s["start"] < acc["end"])).alias("bad"), F.greatest(acc["end"], s["end"].cast("long")).alias("end")),
        lambda acc: acc["bad"],
    )
