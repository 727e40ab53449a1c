"""Placeholders: spans that a translation must keep, as reserved tokens.

A rule is a pattern in the ``regex`` dialect, an order (``preserve`` or
``reorder_within_slot``) and optional scopes and ids.  Without a named group
the whole match is opaque.  With a group named ``text`` that group stays natural
text and what stands around it becomes an opening and a closing token.  Rules
act in their order; spans may not overlap, be empty or cross a line.

The functions on one text are plain Python; protected() and restored() run them
in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"⟦([A-Z]+)_(WHOLE|BEGIN|END)_([0-9]{4,})⟧")
BINDING = "array<struct<token: string, original: string, segment: string, order: string, rule: int>>"


@dataclass(frozen=True)
class Rule:
    pattern: str
    order: str = "preserve"
    scopes: tuple[str, ...] | None = None
    ids: tuple[str, ...] | None = None

    def applies(self, scope: str, target: str | None) -> bool:
        return (self.scopes is None or scope in self.scopes) and (self.ids is None or target in self.ids)


def check_rule(rule: Rule) -> str | None:
    """What is wrong with a rule, or None."""
    import regex

    if not rule.pattern:
        return "empty pattern"
    if rule.order not in ("preserve", "reorder_within_slot"):
        return "unknown order"
    try:
        names = list(regex.compile(rule.pattern).groupindex)
    except regex.error as error:
        return f"pattern: {error}"
    if names not in ([], ["text"]):
        return "only a group named text may be named"
    if names and rule.order != "preserve":
        return "a wrapper preserves order"
    if rule.scopes == () or rule.ids == ():
        return "empty selector"
    return None


def token(segment: str, number: int, label: str = "PH") -> str:
    return f"⟦{label}_{segment}_{number:04d}⟧"


def protect(text: str, rules: list[Rule], scope: str = "", target: str | None = None) -> tuple[str | None, list[dict], str | None]:
    """(protected text, bindings, error) of one text."""
    import regex

    if TOKEN.search(text):
        return None, [], "reserved_token"
    spans: list[tuple[int, int, str, int, str]] = []
    wrappers: list[tuple[tuple[int, int], tuple[int, int], int]] = []
    for number, rule in enumerate(rules, 1):
        if not rule.applies(scope, target):
            continue
        compiled = regex.compile(rule.pattern)
        for m in compiled.finditer(text):
            if m.start() == m.end():
                return None, [], "empty_match"
            if "text" in compiled.groupindex:
                a, b = m.span("text")
                if a < 0:
                    return None, [], "missing_text_capture"
                if m.start() < a:
                    spans.append((m.start(), a, "BEGIN", number, rule.order))
                if b < m.end():
                    spans.append((b, m.end(), "END", number, rule.order))
                wrappers.append(((m.start(), a), (b, m.end()), number))
            else:
                spans.append((m.start(), m.end(), "WHOLE", number, rule.order))
    spans.sort()
    for (_, end, *_), (start, *_) in zip(spans, spans[1:]):
        if start < end:
            return None, [], "overlap"
    if any("\n" in text[a:b] for a, b, *_ in spans):
        return None, [], "line_crossing"
    out, bindings, at = [], [], 0
    for i, (a, b, segment, number, order) in enumerate(spans):
        name = token(segment, i)
        out += [text[at:a], name]
        bindings.append({"token": name, "original": text[a:b], "segment": segment, "order": order, "rule": number})
        at = b
    return "".join(out) + text[at:], bindings, None


def restore(candidate: str, bindings: list[dict]) -> tuple[str | None, str | None]:
    """(text with the originals put back in one pass, error)."""
    known = {b["token"]: b["original"] for b in bindings}
    problem = check_tokens(candidate, bindings)
    if problem:
        return None, problem
    return TOKEN.sub(lambda m: known[m[0]], candidate), None


def check_tokens(candidate: str, bindings: list[dict]) -> str | None:
    """The first rule that a candidate's tokens break: unknown, unclosed, missing, duplicated, order, topology."""
    found = [m[0] for m in TOKEN.finditer(candidate)]
    known = {b["token"]: b for b in bindings}
    if any(t not in known for t in found):
        return "unknown"
    rest = TOKEN.sub("", candidate)
    if "⟦" in rest or "⟧" in rest:
        return "unclosed"
    for b in bindings:
        n = found.count(b["token"])
        if n != 1:
            return "missing" if n == 0 else "duplicated"
    kept = [t for t in found if known[t]["order"] == "preserve"]
    if kept != [b["token"] for b in bindings if b["order"] == "preserve"]:
        return "order"
    depth = 0
    for t in found:
        depth += {"BEGIN": 1, "END": -1}.get(known[t]["segment"], 0)
        if depth < 0 and any(b["segment"] == "BEGIN" for b in bindings):
            return "topology"
    return None


def segments(protected: Column) -> Column:
    """Natural text between tokens and the tokens, as array<struct<kind, text>> in order."""
    pattern = "⟦[A-Z]+_(?:WHOLE|BEGIN|END)_[0-9]{4,}⟧"
    natural = F.split(protected, pattern)
    opaque = F.regexp_extract_all(protected, F.lit(pattern), F.lit(0))
    pairs = F.transform(natural, lambda n, i: F.array(F.struct(F.lit("natural").alias("kind"), n.alias("text")), F.struct(F.lit("opaque").alias("kind"), F.get(opaque, i).alias("text"))))
    return F.filter(F.flatten(pairs), lambda s: s["text"].isNotNull() & (s["text"] != ""))


def protected(units: DataFrame, key: str, text: str, scope: str, rules: list[Rule]) -> DataFrame:
    """key, protected, bindings, error of every unit; a null text has neither."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [protect(t, rules, s or "", str(k)) if t is not None else (None, [], None) for k, t, s in zip(pdf["k"], pdf["t"], pdf["s"])]
            yield pd.DataFrame({"k": pdf["k"], "protected": [d[0] for d in done], "bindings": [d[1] for d in done], "error": [d[2] for d in done]})

    kind = dict(units.dtypes)[key]
    return units.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(scope).alias("s")).mapInPandas(run, f"k {kind}, protected string, bindings {BINDING}, error string").withColumnRenamed("k", key)


def restored(rows: DataFrame, key: str, candidate: str, bindings: str) -> DataFrame:
    """key, restored, error of every candidate."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [restore(c, list(b)) if c is not None else (None, "null") for c, b in zip(pdf["c"], pdf["b"])]
            yield pd.DataFrame({"k": pdf["k"], "restored": [d[0] for d in done], "error": [d[1] for d in done]})

    kind = dict(rows.dtypes)[key]
    return rows.select(F.col(key).alias("k"), F.col(candidate).alias("c"), F.col(bindings).alias("b")).mapInPandas(run, f"k {kind}, restored string, error string").withColumnRenamed("k", key)


def binding_digest(bindings: Column) -> Column:
    """Digest of a unit's bindings, whatever their order."""
    from .text import frame

    each = F.array_sort(F.transform(bindings, lambda b: F.sha2(F.concat(frame(1, b["original"]), frame(2, b["segment"]), frame(3, b["order"])), 256)))
    return F.sha2(F.array_join(each, ","), 256)


def span_problem(spans: Column) -> Column:
    """overlap, empty or null for an array of spans struct<start, end>."""
    from .intervals import has_overlap

    return F.when(F.exists(spans, lambda s: s["start"] >= s["end"]), "empty").when(has_overlap(spans), "overlap")


def control_shapes(text: Column) -> Column:
    """Backslash commands, printf places, braces and tags of a text, in order."""
    return F.regexp_extract_all(text, F.lit(r"\\[A-Za-z]+(?:\[[^\]\n]*\])?|%[0-9]+|%[sd]|\{[^{}\n]*\}|</?[A-Za-z][^<>\n]*>"), F.lit(0))


def arguments_beyond(text: Column, arity: Column) -> Column:
    """The numbers of %N places above a contract's arity."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit("%([0-9]{1,6})"), F.lit(1)), lambda n: n.cast("int"))
    return F.filter(numbers, lambda n: (n > arity) | (n < 1))


def crossing_lines(text: Column) -> Column:
    """Bracketed or tagged spans that hold a line feed."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"(?s)(\{[^{}]*\}|<[A-Za-z][^<>]*>)"), F.lit(1)), lambda s: F.contains(s, F.lit("\n")))


def mined_shapes(units: DataFrame, key: str, text: str, owner: str) -> DataFrame:
    """shape, occurrences, owners, keys, examples (the first five): control shapes grouped by their skeleton."""
    each = units.select(F.col(key).alias("key"), F.col(owner).alias("owner"), F.explode(control_shapes(F.col(text))).alias("span"))
    shaped = each.withColumn("shape", F.regexp_replace(F.regexp_replace("span", "[0-9]+", "0"), r"([\[{<=\"' ])[^\[\]{}<>=\"' ]+", "$1x"))
    return shaped.groupBy("shape").agg(F.count("*").alias("occurrences"), F.count_distinct("owner").alias("owners"), F.count_distinct("key").alias("keys"), F.min("span").alias("example"))


def verify_rules(units: DataFrame, key: str, text: str, rules: list[Rule]) -> DataFrame:
    """error, n: how often rules fail on a corpus, before they are used."""
    return protected(units.withColumn("__scope", F.lit("")), key, text, "__scope", rules).filter("error is not null").groupBy("error").agg(F.count("*").alias("n"))
