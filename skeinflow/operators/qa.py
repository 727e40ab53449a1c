"""Quality findings on translated units, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.placeholders import control_shapes
from ..functions.text import structural_blank


def findings(rows: DataFrame, terms: list[tuple[str, str]] | None = None) -> DataFrame:
    """unit_key, kind, detail of rows (unit_key, state, source, translation): one row for each finding.

    pending, rejected; of those with a translation: blank, line_count (other
    number of lines), controls (other control shapes), residual (three words of
    the source or more stand in the translation), term (a term's translation is
    missing where the term is in the source).
    """
    s, t = F.col("source"), F.coalesce("translation", F.lit(""))
    done = F.col("translation").isNotNull() & (F.col("state") == "current")
    words = lambda x: F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("[a-z]{3,}"), F.lit(0)))
    shared = F.array_intersect(words(s), words(t))
    kinds: list[tuple[str, Column, Column]] = [
        ("pending", F.col("state") == "pending", F.lit("")),
        ("rejected", F.col("state") == "rejected", F.lit("")),
        ("blank", done & structural_blank(t) & ~structural_blank(s), F.lit("")),
        ("line_count", done & (F.regexp_count(s, F.lit("\n")) != F.regexp_count(t, F.lit("\n"))), F.lit("")),
        ("controls", done & ~(F.array_sort(control_shapes(s)) == F.array_sort(control_shapes(t))), F.array_join(F.array_except(control_shapes(s), control_shapes(t)), " ")),
        ("residual", done & (F.size(shared) >= 3), F.size(shared).cast("string")),
    ]
    for term, translation in terms or []:
        kinds.append(("term", done & F.contains(s, F.lit(term)) & ~F.contains(t, F.lit(translation)), F.lit(term)))
    found = F.filter(F.array(*[F.when(c, F.struct(F.lit(k).alias("kind"), d.alias("detail"))) for k, c, d in kinds]), lambda x: x.isNotNull())
    return rows.select("unit_key", F.explode(found).alias("f")).select("unit_key", "f.kind", "f.detail")


def grouped(found: DataFrame) -> DataFrame:
    """kind, n, units, first: counts of findings."""
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("unit_key").alias("units"), F.min("unit_key").alias("first"))


def verdict(summary: DataFrame) -> DataFrame:
    """One row: unverified where units are pending, needs_review where there are findings, else clean."""
    return summary.agg(F.when(F.coalesce(F.bool_or(F.col("kind") == "pending"), F.lit(False)), "unverified").when(F.count("*") > 0, "needs_review").otherwise("clean").alias("verdict"))


def translation_export(rows: DataFrame) -> DataFrame:
    """unit_key, state, origin, json of every unit: what goes to a JSON-lines export."""
    origin = F.when(F.col("manual").isNotNull(), "manual").when(F.col("automatic").isNotNull(), "automatic").otherwise("none")
    state = F.when(origin != "none", "current").when(F.col("rejected"), "rejected").otherwise("pending")
    text = F.coalesce("manual", "automatic")
    return rows.select("unit_key", state.alias("state"), origin.alias("origin"), F.to_json(F.struct(F.col("unit_key").alias("manual_id"), F.array("source").alias("source"), F.when(text.isNotNull(), F.array(text)).alias("translation"), state.alias("state"), origin.alias("origin"))).alias("json"))


def block_message(units: DataFrame) -> DataFrame:
    """block, message: the user message of each block as JSON: groups of units with ids where something is asked; blocks are bounded."""
    unit = F.struct(F.col("task_id").cast("string").alias("id"), F.array("source_text").alias("text"))
    groups = units.groupBy("block", "group_id", "kind").agg(F.array_sort(F.collect_list(F.struct("ordinal", unit.alias("unit")))).alias("u"))
    each = groups.select("block", F.struct("group_id", F.struct("kind", F.transform("u", lambda x: x["unit"]).alias("units")).alias("g")).alias("s"))
    return each.groupBy("block").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["g"]).alias("groups"))).alias("message"))


def review_decisions(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """candidate, outcome: a decision counts if it names one of the candidate's options and has evidence."""
    d = decisions.select(F.col("candidate").alias("c"), "option", "evidence")
    fine = F.array_contains("options", F.col("option"))
    outcome = F.when(F.col("c").isNull(), "undecided").when(F.trim(F.coalesce("evidence", F.lit(""))) == "", "no_evidence").when(~fine, "unknown_option").otherwise(F.col("option"))
    return candidates.join(d, F.col("candidate") == F.col("c"), "left").select("candidate", outcome.alias("outcome"))


def player_text(text: Column) -> Column:
    """Whether a string looks like something to read: it has letters of a script with words, and isn't a path, a number or an identifier."""
    letters = text.rlike("[\\p{L}]{2,}")
    technical = text.rlike(r"^[A-Za-z0-9_./\\:-]+$") & (~F.contains(text, F.lit(" "))) & text.rlike(r"[_./\\0-9:]")
    return letters & ~technical & ~text.rlike("^(true|false|null|on|off)$")


def natural_scope(readable: Column) -> Column:
    """The scope of a readable id: the file, and for events their page."""
    parts = F.split(readable, ":")
    return F.when(F.size(parts) <= 2, F.get(parts, F.lit(0))).when(F.get(parts, F.lit(1)).rlike("^event[0-9]+$"), F.concat_ws(":", F.slice(parts, F.lit(1), F.lit(3)))).otherwise(F.get(parts, F.lit(0)))
