"""Punctuation repair: a translation's signs follow the source's where the pairing is certain.

Signs are classed by family; an opening or closing quote is told from its
neighbours and from a stack of open pairs.  A sign of the translation is
replaced only if it is matched with one source sign of its family in every
longest common subsequence of the two sign sequences, and a second run of the
repair must change nothing more.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Signs by family.
FAMILIES = {
    "comma": ",，、", "period": ".。．", "question": "?？", "exclamation": "!！", "colon": ":：", "semicolon": ";；", "ellipsis": "…", "dash": "—―–", "wave": "~～〜", "middle_dot": "·・",
    "double_quote": "\"“”＂", "single_quote": "'‘’＇", "round": "()（）", "square": "[]［］【】", "corner": "「」『』",
}
_FAMILY = {c: f for f, cs in FAMILIES.items() for c in cs}
_CLOSE = {"(": ")", "（": "）", "[": "]", "［": "］", "【": "】", "「": "」", "『": "』", "“": "”", "‘": "’"}


def signs(text: str) -> list[tuple[int, str, str]]:
    """(index, sign, class) of each sign; pairs' classes end in open or close, and a sign of a word or number is none."""
    out: list[tuple[int, str, str]] = []
    stack: list[str] = []
    for i, c in enumerate(text):
        family = _FAMILY.get(c)
        if family is None:
            continue
        before, after = text[i - 1 : i], text[i + 1 : i + 2]
        if c in ".,:'’" and before.isalnum() and after.isalnum() and before.isascii() and after.isascii():
            continue
        side = ""
        if c in _CLOSE:
            side, _ = " open", stack.append(family)
        elif c in _CLOSE.values():
            side = " close"
            if stack and stack[-1] == family:
                stack.pop()
        elif family in ("double_quote", "single_quote"):
            if stack and stack[-1] == family:
                side, _ = " close", stack.pop()
            else:
                side, _ = " open", stack.append(family)
        out.append((i, c, family + side))
    return out


def forced_pairs(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs that are in every longest common subsequence."""
    n, m = len(a), len(b)
    pre = [[0] * (m + 1) for _ in range(n + 1)]
    suf = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            pre[i + 1][j + 1] = pre[i][j] + 1 if a[i] == b[j] else max(pre[i][j + 1], pre[i + 1][j])
    for i in reversed(range(n)):
        for j in reversed(range(m)):
            suf[i][j] = suf[i + 1][j + 1] + 1 if a[i] == b[j] else max(suf[i + 1][j], suf[i][j + 1])
    best = pre[n][m]
    levels: dict[int, list[tuple[int, int]]] = {}
    for i in range(n):
        for j in range(m):
            if a[i] == b[j] and pre[i][j] + 1 + suf[i + 1][j + 1] == best:
                levels.setdefault(pre[i][j], []).append((i, j))
    return [pairs[0] for _, pairs in sorted(levels.items()) if len(pairs) == 1]


def repair(source: str, translation: str) -> tuple[str, int]:
    """(translation, signs replaced)."""

    def once(text: str) -> tuple[str, int]:
        s, t = signs(source), signs(text)
        out, changed = list(text), 0
        for i, j in forced_pairs([x[2] for x in s], [x[2] for x in t]):
            if s[i][1] != t[j][1]:
                out[t[j][0]] = s[i][1]
                changed += 1
        return "".join(out), changed

    first, n = once(translation)
    return (first, n) if once(first) == (first, 0) else (translation, 0)


def repaired(rows: DataFrame, key: str, source: str, translation: str) -> DataFrame:
    """key, text, replaced of every pair; nulls stay null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [repair(s, t) if s is not None and t is not None else (t, 0) for s, t in zip(pdf["s"], pdf["t"])]
            yield pd.DataFrame({"k": pdf["k"], "text": [d[0] for d in done], "replaced": [d[1] for d in done]})

    kind = dict(rows.dtypes)[key]
    return rows.select(F.col(key).alias("k"), F.col(source).alias("s"), F.col(translation).alias("t")).mapInPandas(run, f"k {kind}, text string, replaced int").withColumnRenamed("k", key)


def is_sign(c: str) -> bool:
    return unicodedata.category(c).startswith("P")
