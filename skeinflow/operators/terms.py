"""Term dictionaries: matching, occurrence counts, review."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Triggers beyond which an alternation is left for the automaton of term_hits_many().
ALTERNATION = 500


def check_terms(terms: list[dict]) -> list[str]:
    """Problems of a term list: empty or repeated terms, triggers empty, repeated or shared."""
    problems, seen, owner = [], set(), {}
    for t in terms:
        name, triggers = t.get("term", ""), t.get("triggers", [t.get("term", "")])
        if not name:
            problems.append("empty term")
        if name in seen:
            problems.append(f"repeated term: {name}")
        seen.add(name)
        if not triggers:
            problems.append(f"no triggers: {name}")
        for x in triggers:
            if not x:
                problems.append(f"empty trigger: {name}")
            elif x in owner:
                problems.append(f"shared trigger: {x}")
            owner[x] = name
    return problems


def alternation(triggers: list[str]) -> str:
    """A pattern whose leftmost match is the longest trigger there."""
    escaped = [re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", t) for t in sorted(triggers, key=lambda t: (-len(t), t))]
    return "(" + "|".join(escaped) + ")"


def term_hits(text: Column, terms: list[dict]) -> Column:
    """The terms that occur, leftmost and longest first, without intersecting matches, in dictionary order."""
    owner = {x: t["term"] for t in terms for x in t.get("triggers", [t["term"]])}
    if len(owner) > ALTERNATION:
        raise ValueError("use term_hits_many for a dictionary of this size")
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(alternation(list(owner))), F.lit(1)))
    of = lambda f: F.filter(F.array(*[F.when(F.arrays_overlap(f, F.array(*[F.lit(x) for x in t.get("triggers", [t["term"]])])), F.lit(t["term"])) for t in terms]), lambda x: x.isNotNull())
    # A lambda's argument is evaluated once, however often its body uses it.
    return F.get(F.transform(F.array(found), of), F.lit(0))


def term_rows(units: DataFrame, keys: list[str], text: str, terms: list[dict]) -> DataFrame:
    """keys, term: a row for each term that occurs in a unit, leftmost and longest first; the text is matched once."""
    owner = {x: t["term"] for t in terms for x in t.get("triggers", [t["term"]])}
    if len(owner) > ALTERNATION:
        raise ValueError("use term_hits_many for a dictionary of this size")
    found = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(alternation(list(owner))), F.lit(1)))
    named = F.create_map(*[F.lit(v) for pair in owner.items() for v in pair])
    return units.select(*keys, F.explode(F.array_distinct(F.transform(found, lambda x: F.element_at(named, x)))).alias("term"))


def term_hits_many(units: DataFrame, key: str, text: str, terms: list[dict]) -> DataFrame:
    """key, hits for a large dictionary: one automaton in each worker."""
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        a = ahocorasick.Automaton()
        for i, t in enumerate(terms):
            for x in t.get("triggers", [t["term"]]):
                a.add_word(x, (len(x), i))
        a.make_automaton()
        for pdf in batches:
            hits = []
            for s in pdf[text]:
                spans = sorted((end - n + 1, -n, i) for end, (n, i) in a.iter(s or "")) if len(a) else []
                at, found = 0, set()
                for start, n, i in spans:
                    if start >= at:
                        at = start - n
                        found.add(i)
                hits.append([terms[i]["term"] for i in sorted(found)])
            yield pd.DataFrame({key: pdf[key], "hits": hits})

    kind = dict(units.dtypes)[key]
    return units.select(key, text).mapInPandas(run, f"{key} {kind}, hits array<string>")


def occurrences(text: Column, term: str) -> Column:
    """How often a term occurs, overlapping occurrences included."""
    escaped = re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", term)
    return F.regexp_count(text, F.lit(f"(?={escaped})")).cast("long")


def review(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """candidate, verdict: duplicate, not_found, single or accepted."""
    named = candidates.groupBy("candidate").agg(F.count("*").alias("named"))
    found = named.join(counts, "candidate", "left")
    n = F.coalesce("n", F.lit(0))
    return found.select("candidate", F.when(F.col("named") > 1, "duplicate").when(n == 0, "not_found").when(n == 1, "single").otherwise("accepted").alias("verdict"))
