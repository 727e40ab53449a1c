"""Rules over documents, and writing text back into them.

Extract rules select strings by file and path; a pattern on a rule cuts a
string into literal and captured parts, of which the captures are units.
Writing back puts new values at places, inside JSON strings too, and leaves every
other character of a document as it is (numbers keep their text, repeated keys
are refused, any depth will do); other functions rebuild event lists whose bodies have more lines than before.  A document is one row, so
documents are rewritten side by side.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import RuleError, path_steps, walk

PARTS = "array<struct<part: string, text: string>>"


def captures(pattern: str, text: str) -> list[dict]:
    """A string as parts: literal, and slot for each non-blank capture; captures may not overlap."""
    import regex

    spans = sorted({m.span(g) for m in regex.finditer(pattern, text) for g in range(1, len(m.groups()) + 1) if m.span(g)[0] >= 0})
    for (_, end), (start, _) in zip(spans, spans[1:]):
        if start < end:
            raise RuleError("captures overlap")
    out, at = [], 0
    for a, b in spans:
        if not text[a:b].strip():
            continue
        if at < a:
            out.append({"part": "literal", "text": text[at:a]})
        out.append({"part": "slot", "text": text[a:b]})
        at = b
    if at < len(text):
        out.append({"part": "literal", "text": text[at:]})
    return out


def fill(parts: Column, slots: Column) -> Column:
    """The parts with the n-th slot's text replaced by the n-th value (null keeps it)."""
    number = lambda i: F.size(F.filter(F.slice(parts, F.lit(1), i + 1), lambda p: p["part"] == "slot"))
    return F.array_join(F.transform(parts, lambda p, i: F.when(p["part"] == "slot", F.coalesce(F.get(slots, number(i) - 1), p["text"])).otherwise(p["text"])), "")


def select(docs: DataFrame, rules: list[dict]) -> DataFrame:
    """rule (from 1), file, place, text, parts, error of what rules (file, path, pattern?) select in documents (file, content).

    Documents that no rule names aren't read further; rules of one document
    share its decoding.
    """
    steps = [path_steps(r["path"]) for r in rules]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for file, content in zip(pdf["file"], pdf["content"]):
                try:
                    value = json.loads(content)
                except (TypeError, ValueError):
                    out.append((None, file, None, None, None, "not JSON"))
                    continue
                except RecursionError:
                    out.append((None, file, None, None, None, "nested too deep"))
                    continue
                for n, r in enumerate(rules, 1):
                    if r["file"] != file:
                        continue
                    try:
                        for where, text in walk(value, steps[n - 1]):
                            parts = captures(r["pattern"], text) if r.get("pattern") else [{"part": "slot", "text": text}]
                            if text.strip() and any(p["part"] == "slot" for p in parts):
                                out.append((n, file, json.dumps(where, ensure_ascii=False), text, parts, None))
                    except RuleError as error:
                        out.append((n, file, None, None, None, str(error)))
            yield pd.DataFrame(out, columns=["rule", "file", "place", "text", "parts", "error"])

    named = docs.filter(F.col("file").isin(*{r["file"] for r in rules})).select("file", "content")
    return named.mapInPandas(run, f"rule int, file string, place string, text string, parts {PARTS}, error string")


def selected_twice(found: DataFrame) -> DataFrame:
    """file, place, rules: places that more than one match selects."""
    return found.filter("place is not null").groupBy("file", "place").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("rule")).alias("rules")).filter("n > 1")


def put(value, where: list, text: str) -> None:
    """Set the string at a place; "@json" opens the JSON string there, and closes it again."""
    if "@json" in where:
        i = where.index("@json")
        holder, key = _holder(value, where[:i])
        inner = json.loads(holder[key])
        put(inner, where[i + 1 :], text)
        holder[key] = json.dumps(inner, ensure_ascii=False, separators=(",", ":"))
    else:
        holder, key = _holder(value, where)
        if not isinstance(holder[key], str):
            raise RuleError(f"no string at {where}")
        holder[key] = text


def _holder(value, where: list):
    for step in where[:-1]:
        value = value[step]
    return value, where[-1]


#: A token of JSON after white space: mark, string, number or word.
_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null))')


def edited(content: str, changes: dict[tuple, str]) -> str:
    """A JSON text with the strings at places changed, and nothing else; "@json" in a place opens the JSON string there."""
    whole = {place: text for place, text in changes.items() if "@json" not in place}
    inside: dict[tuple, dict[tuple, str]] = {}
    for place, text in changes.items():
        if "@json" in place:
            i = place.index("@json")
            inside.setdefault(place[:i], {})[place[i + 1 :]] = text
    if whole.keys() & inside.keys():
        raise RuleError("a string is changed as a whole and inside")
    left = {*whole, *inside}
    ends = {(len(place), place[-1] if place else None) for place in left}
    out: list[str] = []
    copied = at = 0
    # A frame's keys so far (None: a list), and where the walk stands in it.
    frames: list[set | None] = []
    path: list = []
    state = "value"
    while match := _TOKEN.match(content, at):
        mark, string, number, word = match.groups()
        at = match.end()
        if state in ("value", "first") and mark not in ("}", "]", ",", ":"):
            here = tuple(path) if (len(path), path[-1] if path else None) in ends else None
            if here is not None and here in left:
                if string is None:
                    raise RuleError(f"no string at {list(here)}")
                new = whole[here] if here in whole else edited(json.loads(string), inside[here])
                out += [content[copied : match.start(2)], json.dumps(new, ensure_ascii=False)]
                copied = at
                left.discard(here)
            if mark:
                frames.append(set() if mark == "{" else None)
                path.append("" if mark == "{" else 0)
                state = "first key" if mark == "{" else "first"
            else:
                state = "end"
        elif state in ("key", "first key") and string is not None:
            key = json.loads(string)
            if key in frames[-1]:
                raise RuleError(f"repeated key: {key}")
            frames[-1].add(key)
            path[-1], state = key, "colon"
        elif state == "colon" and mark == ":":
            state = "value"
        elif state == "end" and frames and mark == ",":
            if frames[-1] is None:
                path[-1] += 1
            state = "value" if frames[-1] is None else "key"
        elif frames and (mark == "]" and frames[-1] is None and state in ("first", "end") or mark == "}" and frames[-1] is not None and state in ("first key", "end")):
            frames.pop()
            path.pop()
            state = "end"
        else:
            raise ValueError(f"unexpected at character {match.start()}")
    if state != "end" or frames or content[at:].strip(" \t\n\r"):
        raise ValueError(f"unexpected at character {at}")
    if left:
        raise LookupError(f"nothing at {sorted(map(str, left))[0]}")
    return "".join([*out, content[copied:]])


def rebuild_runs(commands: list[dict], bodies: dict[int, list[str]], line: int) -> list[dict]:
    """An event list with new bodies: head index -> lines.  Added lines copy the body's last one, missing ones go."""
    out, i = [], 0
    while i < len(commands):
        out.append(commands[i])
        if i in bodies:
            j = i + 1
            while j < len(commands) and commands[j]["code"] == line:
                j += 1
            old = commands[i + 1 : j]
            for n, text in enumerate(bodies[i]):
                like = old[min(n, len(old) - 1)] if old else {"code": line, "indent": commands[i].get("indent", 0), "parameters": [""]}
                out.append({**like, "parameters": [text, *like["parameters"][1:]]})
            i = j
        else:
            i += 1
    return out


def rewritten(docs: DataFrame, mutations: DataFrame) -> DataFrame:
    """file, content, problem of documents (file, content) after their mutations (file, place, text); a document with a problem stays as it is."""

    def run(pdf: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
        out = []
        for file, content in zip(pdf["file"], pdf["content"]):
            try:
                asked: dict[tuple, str] = {}
                for place, text in zip(changes["place"], changes["text"]):
                    if asked.setdefault(tuple(json.loads(place)), text) != text:
                        raise RuleError(f"two texts for {place}")
                out.append((file, edited(content, asked), None))
            except (RuleError, ValueError, LookupError, TypeError) as error:
                out.append((file, content, f"{type(error).__name__}: {error}"))
        return pd.DataFrame(out, columns=["file", "content", "problem"])

    return docs.select("file", "content").groupBy("file").cogroup(mutations.groupBy("file")).applyInPandas(run, "file string, content string, problem string")


def order_key(place: Column) -> Column:
    """A sortable text of a place: numbers and names tagged and padded, so that text order is document order."""
    steps = F.from_json(place, "array<string>")
    return F.array_join(F.transform(steps, lambda s: F.when(s.rlike("^[0-9]{1,18}$"), F.concat(F.lit("0"), F.lpad(s, 20, "0"))).otherwise(F.concat(F.lit("1"), s))), "/")
