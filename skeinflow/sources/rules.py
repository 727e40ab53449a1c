"""Small rule files in TOML and id lists, read on the driver with closed fields."""

from __future__ import annotations

import json
import os
import tempfile
import tomllib

from ..functions.placeholders import Rule, check_rule
from ..operators.terms import check_terms


class RuleError(ValueError):
    """A rule file that breaks its contract; the message says where."""


def _table(data: bytes, name: str) -> list[dict]:
    try:
        root = tomllib.loads(data.decode("utf-8"))
    except (UnicodeDecodeError, tomllib.TOMLDecodeError) as error:
        raise RuleError(str(error)) from error
    if set(root) != {name} or not isinstance(root[name], list):
        raise RuleError(f"the file holds one array named {name}")
    return root[name]


def _fields(i: int, row: dict, required: dict, optional: dict) -> None:
    if not isinstance(row, dict):
        raise RuleError(f"entry {i}: not a table")
    for k, v in row.items():
        kind = required.get(k) or optional.get(k)
        if kind is None:
            raise RuleError(f"entry {i}: unknown field {k}")
        if not isinstance(v, kind) or isinstance(v, bool) != (kind is bool):
            raise RuleError(f"entry {i}: {k} is of the wrong type")
        if isinstance(v, list) and (not v or len(set(map(str, v))) < len(v) or any(x == "" for x in v)):
            raise RuleError(f"entry {i}: {k} is empty or repeats a value")
    missing = [k for k in required if k not in row]
    if missing:
        raise RuleError(f"entry {i}: {missing[0]} is missing")


def terminology(data: bytes) -> list[dict]:
    rows = _table(data, "term")
    for i, r in enumerate(rows, 1):
        _fields(i, r, {"term": str, "translation": str}, {"triggers": list})
    out = [{"term": r["term"], "translation": r["translation"], "triggers": r.get("triggers", [r["term"]])} for r in rows]
    problems = check_terms(out)
    if problems:
        raise RuleError(problems[0])
    return out


def placeholders(data: bytes) -> list[Rule]:
    out = []
    for i, r in enumerate(_table(data, "rule"), 1):
        _fields(i, r, {"pattern": str, "order": str}, {"scopes": list, "ids": list})
        rule = Rule(r["pattern"], r["order"], tuple(r["scopes"]) if "scopes" in r else None, tuple(r["ids"]) if "ids" in r else None)
        problem = check_rule(rule)
        if problem:
            raise RuleError(f"entry {i}: {problem}")
        out.append(rule)
    return out


def layout(data: bytes) -> list[dict]:
    from ..functions.layout import SELECTORS

    rows = _table(data, "rule")
    for i, r in enumerate(rows, 1):
        _fields(i, r, {"max_fullwidth_chars": int}, {**dict.fromkeys(SELECTORS, list), "exclude_ids": list})
        if r["max_fullwidth_chars"] < 1:
            raise RuleError(f"entry {i}: the width is not positive")
        if not any(s in r for s in SELECTORS):
            raise RuleError(f"entry {i}: no selector")
    return [{"rule": i, **{k: r.get(k) for k in ("max_fullwidth_chars", *SELECTORS, "exclude_ids")}} for i, r in enumerate(rows, 1)]


def path_steps(path: str) -> list[tuple[str, object]]:
    """An extract path as steps: ("key", name), ("index", n), ("each", None)."""
    steps: list[tuple[str, object]] = []
    at = 0
    while at < len(path):
        if path[at] == "[":
            if path.startswith('["', at):
                try:
                    name, end = json.JSONDecoder().raw_decode(path, at + 1)
                except ValueError as error:
                    raise RuleError(f"bad name at {at}") from error
                if path[end : end + 1] != "]":
                    raise RuleError(f"no ] at {end}")
                steps.append(("key", name))
                at = end + 1
            else:
                end = path.find("]", at)
                inner = path[at + 1 : end] if end > 0 else "?"
                if inner and not (inner.isdigit() and str(int(inner)) == inner):
                    raise RuleError(f"bad index at {at}")
                steps.append(("index", int(inner)) if inner else ("each", None))
                at = end + 1
        else:
            if steps:
                if path[at] != ".":
                    raise RuleError(f"no . at {at}")
                at += 1
            end = min([x for x in (path.find(".", at), path.find("[", at)) if x >= 0], default=len(path))
            if end == at:
                raise RuleError(f"empty name at {at}")
            steps.append(("key", path[at:end]))
            at = end
    return steps


def walk(value, steps: list[tuple[str, object]]) -> list[tuple[tuple, str]]:
    """(where, string) of what a path selects.  Strings on the way are opened as JSON, a missing member selects nothing, nulls among [] are skipped, another type is an error."""
    todo, out = [(value, 0, ())], []
    while todo:
        v, i, where = todo.pop()
        if i < len(steps) and isinstance(v, str):
            try:
                v, where = json.loads(v), (*where, "@json")
            except ValueError as error:
                raise RuleError(f"no JSON at {where}") from error
        if i == len(steps):
            if not isinstance(v, str):
                raise RuleError(f"no string at {where}")
            out.append((where, v))
            continue
        kind, arg = steps[i]
        if kind == "key":
            if not isinstance(v, dict):
                raise RuleError(f"no object at {where}")
            if arg in v:
                todo.append((v[arg], i + 1, (*where, arg)))
        else:
            if not isinstance(v, list):
                raise RuleError(f"no array at {where}")
            if kind == "index":
                if arg < len(v):
                    todo.append((v[arg], i + 1, (*where, arg)))
            else:
                todo += [(x, i + 1, (*where, j)) for j, x in reversed(list(enumerate(v))) if x is not None]
    return out


def id_list(lines: str) -> list[str]:
    """Ids of a JSON-lines list {"manual_id": ...}; repeated ones are an error."""
    out: list[str] = []
    for i, line in enumerate(lines.splitlines(), 1):
        row = json.loads(line)
        if set(row) != {"manual_id"} or not isinstance(row["manual_id"], str):
            raise RuleError(f"line {i}: not one manual_id")
        out.append(row["manual_id"])
    if len(set(out)) < len(out):
        raise RuleError("repeated id")
    return out


def replace_file(path: str, data: bytes) -> None:
    """All or nothing: a temporary file beside it takes its place."""
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def manual_toml(entries: list[dict]) -> str:
    """Entries (id, type, source, translation) as TOML for a person to fill in."""
    quote = lambda s: json.dumps(s, ensure_ascii=False)
    rows = []
    for e in entries:
        lists = "".join(f"{k} = [{', '.join(quote(x) for x in e.get(k) or [])}]\n" for k in ("source", "translation"))
        rows.append(f"[[entry]]\nid = {quote(e['id'])}\ntype = {quote(e['type'])}\n{lists}")
    return "\n".join(rows)
