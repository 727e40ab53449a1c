"""JSON as strings and variants: strict decoding, leaves, repair."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strict(text: Column) -> Column:
    """The value as a variant; null where it isn't JSON or an object has a key twice."""
    return F.try_parse_json(text)


def closed_object(text: Column, keys: list[str]) -> Column:
    """Whether a text is an object with exactly these keys, none twice."""
    have = F.json_object_keys(text)
    return strict(text).isNotNull() & (F.array_sort(have) == F.array(*[F.lit(k) for k in sorted(keys)]))


def member_ordinal(text: Column, key: Column) -> Column:
    """Place of a key among an object's members as written, from 0; null if it has none."""
    at = F.array_position(F.json_object_keys(text), key)
    return F.when(at > 0, at - 1)


def iter_leaves(value, path: tuple = (), depth: int = 0) -> Iterator[tuple[str, str, int]]:
    """(path, string, layers of JSON-in-string around it) of every string leaf; a string that is a JSON array or object is opened."""
    todo = [(value, path, depth)]
    while todo:
        v, p, d = todo.pop()
        if isinstance(v, dict):
            todo += [(x, (*p, k), d) for k, x in reversed(list(v.items()))]
        elif isinstance(v, list):
            todo += [(x, (*p, i), d) for i, x in reversed(list(enumerate(v)))]
        elif isinstance(v, str):
            if v.strip()[:1] in ("{", "["):
                try:
                    todo.append((json.loads(v), (*p, "@json"), d + 1))
                    continue
                except ValueError:
                    pass
            yield "/".join(str(x).replace("~", "~0").replace("/", "~1") for x in p), v, d


def string_leaves(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, path, value, layers of every string leaf; a text that isn't JSON has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, t in zip(pdf["k"], pdf["t"]):
                try:
                    value = json.loads(t) if t is not None else None
                except ValueError:
                    continue
                out += [(k, *leaf) for leaf in iter_leaves(value)]
            yield pd.DataFrame(out, columns=["k", "path", "value", "layers"])

    kind = dict(rows.dtypes)[key]
    return rows.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, path string, value string, layers int").withColumnRenamed("k", key)


_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'|//[^\n]*|/\*.*?\*/|[{}\[\],:]|[^\s{}\[\],:"\']+', re.S)
_WORDS = {"true": "true", "false": "false", "null": "null", "True": "true", "False": "false", "None": "null", "undefined": "null", "NaN": "null"}
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\Z")


def repair(text: str) -> tuple[str | None, list[str]]:
    """(JSON text or None, kinds of repair) of nearly-JSON, as models write it.

    Repaired are: a code fence or words around the value, comments, single
    quotes, bare keys and words, Python's and JavaScript's constants, raw line
    feeds in strings, trailing, doubled and missing commas, missing colons'
    values, and closing brackets that are missing or wrong.
    """
    kinds: list[str] = []

    def did(kind: str) -> None:
        if kind not in kinds:
            kinds.append(kind)

    try:
        json.loads(text)
        return text, []
    except ValueError:
        pass
    body = text.lstrip("﻿")
    if body != text:
        did("byte_order_mark")
    fence = re.search(r"```[A-Za-z]*\n(.*?)(?:```|\Z)", body, re.S)
    if fence:
        body = fence[1]
        did("code_fence")
    start = re.search(r"[{\[]", body)
    if not start:
        return None, kinds
    if body[: start.start()].strip():
        did("text_before")
    out: list[str] = []
    stack: list[str] = []
    need: list[str] = []  # what an open object or array waits for: key, colon, value, comma
    end = None
    for m in _TOKEN.finditer(body, start.start()):
        t = m[0]
        if t.startswith(("//", "/*")):
            did("comment")
            continue
        if end is not None:
            did("text_after")
            break
        if t in "{[":
            if need and need[-1] == "comma":
                out.append(",")
                did("missing_comma")
            if need:
                need[-1] = "comma"
            out.append(t)
            stack.append("}" if t == "{" else "]")
            need.append("key" if t == "{" else "value")
            continue
        if t in "}]":
            if t not in stack:
                did("stray_close")
                continue
            while stack:
                if need[-1] in ("colon", "member"):
                    out.append(":null" if need[-1] == "colon" else "null")
                    did("missing_value")
                if out[-1] == ",":
                    out.pop()
                    did("trailing_comma")
                close = stack.pop()
                need.pop()
                out.append(close)
                if close == t:
                    break
                did("missing_close")
            if not stack:
                end = m.end()
            continue
        if t == ",":
            if out[-1] in (",", "{", "["):
                did("extra_comma")
            elif need[-1] in ("colon", "member"):
                out += [":null,"] if need[-1] == "colon" else ["null,"]
                need[-1] = "key"
                did("missing_value")
            else:
                out.append(",")
                need[-1] = "key" if stack[-1] == "}" else "value"
            continue
        if t == ":":
            if need[-1] == "colon":
                out.append(":")
                need[-1] = "member"
            else:
                did("stray_colon")
            continue
        if t[0] in "\"'":
            inner = t[1:-1]
            if t[0] == "'":
                did("single_quotes")
                inner = re.sub(r'(?<!\\)"', r'\\"', inner.replace("\\'", "'"))
            if re.search(r"[\x00-\x1f]", inner):
                did("raw_control")
                inner = re.sub(r"[\x00-\x1f]", lambda c: json.dumps(c[0])[1:-1], inner)
            value = f'"{inner}"'
            try:
                json.loads(value)
            except ValueError:
                did("bad_escape")
                value = json.dumps(inner.replace("\\", "\\\\"))
        elif t in _WORDS:
            value = _WORDS[t]
            if value != t:
                did("constant")
        elif _NUMBER.match(t):
            value = t
        else:
            value = json.dumps(t.strip("\"'"))
            did("bare_word")
        if need[-1] == "comma":
            out.append(",")
            did("missing_comma")
            need[-1] = "key" if stack[-1] == "}" else "value"
        if need[-1] == "key":
            if value[0] != '"':
                value = json.dumps(value)
                did("bare_key")
            out.append(value)
            need[-1] = "colon"
        elif need[-1] == "colon":
            out += [":", value]
            did("missing_colon")
            need[-1] = "comma"
        else:
            out.append(value)
            need[-1] = "comma"
    while stack:
        if need[-1] in ("colon", "member"):
            out.append(":null" if need[-1] == "colon" else "null")
        if out[-1] == ",":
            out.pop()
            did("trailing_comma")
        out.append(stack.pop())
        need.pop()
        did("missing_close")
    fixed = "".join(out)
    try:
        json.loads(fixed)
    except ValueError:
        return None, kinds
    return fixed, kinds


def repaired(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, json, repairs of every row; json is null where it can't be repaired."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [repair(t) if t is not None else (None, []) for t in pdf["t"]]
            yield pd.DataFrame({"k": pdf["k"], "json": [d[0] for d in done], "repairs": [d[1] for d in done]})

    kind = dict(rows.dtypes)[key]
    return rows.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, json string, repairs array<string>").withColumnRenamed("k", key)
