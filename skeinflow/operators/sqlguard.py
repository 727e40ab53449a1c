"""One read-only SQL statement over registered frames, with parameters."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_BLANKED = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)
#: First words of statements that only read.
READS = ("select", "with", "values", "from", "table", "describe", "explain", "show")


def query(spark: SparkSession, sql: str, args: dict | list | None = None) -> DataFrame:
    """spark.sql() of a single statement that reads; others are refused."""
    bare = _BLANKED.sub(" ", sql).strip().rstrip(";").strip()
    if ";" in bare:
        raise ValueError("one statement at a time")
    first = re.match(r"[\s(]*([A-Za-z]+)", bare)
    if not first or first[1].lower() not in READS or re.search(r"\b(insert|overwrite\s+directory|into)\b", bare, re.I):
        raise ValueError("only statements that read")
    return spark.sql(sql, args=args) if args is not None else spark.sql(sql)
