"""Language identification: words first, then ever shorter character n-grams.

A word is a run of letters and marks (Unicode categories L and M) that begins
with a letter, of the lower-cased text, in training as in prediction.
Training counts the words of a bounded, documented sample of labelled texts
(``per_language`` whole texts for each language, chosen by a hash) and keeps
each language's most frequent words with their log frequencies; the character
n-grams come from those words.  A word of the model scores by its own log
frequencies; every labelled language takes part.  A word that the model doesn't know is scored by the mean over its
n-grams of the greatest length of which it has any known one, from LONGEST down
to 1, at a discount for each step back.

Defined results: a null text or one without letters (number signs are none) is ``und`` with score 0, as
is everything if no text is labelled; a text of which nothing is known gets the
most frequent language and its share; ties go to the more frequent language,
then the smaller name; repeated rows and extra columns make no difference.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .textarrays import slices

PER_LANGUAGE = 3_000
WORDS = 200_000
GRAMS = 60_000
LONGEST = 5
DISCOUNT = 0.5
KEPT = 200_000
#: Scores (words times languages) that are added up at once.
AT_ONCE = 1 << 20
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
ASCII_WORD = re.compile("[a-z]+")


def words_of(text: str | None) -> list[str]:
    low = (text or "").lower()
    return (ASCII_WORD if low.isascii() else WORD).findall(low)


@dataclass
class Model:
    languages: list[str]
    share: np.ndarray
    words: dict[str, np.ndarray]
    grams: list[dict[str, np.ndarray]]  # by length, from 1
    _row: dict[str, int] = field(default_factory=dict)
    _matrix: np.ndarray | None = None

    def __getstate__(self):
        return {"languages": self.languages, "share": self.share, "words": self.words, "grams": self.grams, "_row": {}, "_matrix": None}

    def word(self, w: str) -> np.ndarray:
        """Log scores by language; zeros if nothing of the word is known."""
        got = self.words.get(w)
        if got is not None:
            return got
        marked = f"<{w}>"
        for n in range(len(self.grams), 0, -1):
            table = self.grams[n - 1]
            found = [v for i in range(len(marked) - n + 1) if (v := table.get(marked[i : i + n])) is not None]
            if found:
                return np.mean(found, axis=0) * DISCOUNT ** (len(self.grams) - n)
        return np.zeros(len(self.languages), np.float32)

    def places(self, words: list[str]) -> np.ndarray:
        """Rows of the table of score vectors, to which new words are added."""
        if self._matrix is None or len(self._row) > KEPT + len(self.words):
            self._row = {w: i for i, w in enumerate(self.words)}
            self._matrix = np.zeros((len(self.words) + KEPT, len(self.languages)), np.float32)
            if self.words:
                self._matrix[: len(self.words)] = np.stack(list(self.words.values()))
        row = self._row
        for w in sorted({w for w in words if w not in row}):
            if len(row) == len(self._matrix):
                self._matrix = np.concatenate([self._matrix, np.zeros_like(self._matrix[:KEPT])])
            self._matrix[len(row)] = self.word(w)
            row[w] = len(row)
        return np.fromiter((row[w] for w in words), np.int64, len(words))

    def totals(self, texts: list[list[str]]) -> np.ndarray:
        """Sums of the words' scores, by text and language."""
        out = np.zeros((len(texts), len(self.languages)))
        step = max(1, AT_ONCE // max(1, len(self.languages)))
        flat = [w for words in texts for w in words]
        ends = np.cumsum([len(words) for words in texts])
        for at in range(0, len(flat), step):
            where = self.places(flat[at : at + step])
            part = self._matrix[where]
            first = np.searchsorted(ends, at, side="right")
            last = np.searchsorted(ends, at + len(part), side="left")
            begin = np.maximum(np.concatenate([[0], ends])[first : last + 1] - at, 0)
            stop = np.minimum(ends[first : last + 1] - at, len(part))
            some = np.flatnonzero(stop > begin)
            out[first + some] += np.add.reduceat(part, begin[some], axis=0, dtype=np.float64)
        return out

    def predictions(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        words = [words_of(t) for t in texts]
        total = self.totals(words) if self.languages else np.zeros((len(texts), 1))
        p = np.exp(total - total.max(axis=1, keepdims=True))
        score, best, known = p.max(axis=1) / p.sum(axis=1), total.argmax(axis=1), total.any(axis=1)
        langs, scores = [], []
        for i, w in enumerate(words):
            if not w or not self.languages:
                langs.append("und")
                scores.append(0.0)
            else:
                langs.append(self.languages[int(best[i])] if known[i] else self.languages[0])
                scores.append(float(score[i]) if known[i] else float(self.share[0]))
        return langs, scores

    def predict(self, text: str | None) -> tuple[str, float]:
        (lang,), (score,) = self.predictions([text])
        return lang, score


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """l, w, n: how often the words of a slice of texts occur, by language."""
    for batch in batches:
        for first, last, _, _ in slices(batch.column("t")):
            part = batch.slice(first, last - first)
            count = Counter((lang, w) for lang, t in zip(part.column("l").to_pylist(), part.column("t").to_pylist()) for w in words_of(t))
            langs, found = zip(*count) if count else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.string()), pa.array(list(count.values()), pa.int64())], names=["l", "w", "n"])


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, words: int = WORDS, grams: int = GRAMS) -> Model:
    """A model of the rows with a language; callers leave held-out rows away."""
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("d"), F.col(lang).alias("l"), F.col(text).alias("t"))
    # One row for each language reaches the driver.
    counts = labelled.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").collect()
    if not counts:
        return Model([], np.zeros(0), {}, [{} for _ in range(LONGEST)])
    languages = [r["l"] for r in counts]
    share = np.array([r["n"] for r in counts], float)
    fractions = docs.sparkSession.createDataFrame([(r["l"], min(1.0, per_language / r["n"])) for r in counts], "l string, fraction double")
    sample = labelled.join(F.broadcast(fractions), "l").filter(F.pmod(F.xxhash64(F.col("d"), F.lit(7)), F.lit(1 << 20)) < F.col("fraction") * (1 << 20))
    each = sample.select("l", "t").mapInArrow(_counter, "l string, w string, n long").groupBy("l", "w").agg(F.sum("n").alias("n"))
    top = each.withColumn("r", F.row_number().over(W.partitionBy("l").orderBy(F.desc("n"), "w"))).filter(F.col("r") <= max(1, words // len(languages)))
    table = top.select("l", "w", "n").toPandas()
    index = {x: i for i, x in enumerate(languages)}
    col = table["l"].map(index).to_numpy(dtype=int)
    n = table["n"].to_numpy(float)

    def scores(keys: list[str], cols: np.ndarray, values: np.ndarray, limit: int) -> dict[str, np.ndarray]:
        where: dict[str, int] = {}
        rows = np.array([where.setdefault(k, len(where)) for k in keys], dtype=int)
        count = np.zeros((len(where), len(languages)))
        np.add.at(count, (rows, cols), values)
        names = list(where)
        keep = np.argsort(-count.sum(axis=1), kind="stable")[:limit]
        alpha = 0.1
        logs = np.log((count + alpha) / (count.sum(axis=0) + alpha * len(where)))
        # Scores are differences from the mean over languages, so that unknown words weigh nothing.
        logs = (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32)
        return {names[i]: logs[i] for i in keep}

    by_length = []
    marked = [f"<{w}>" for w in table["w"]]
    for k in range(1, LONGEST + 1):
        keys, cols, values = [], [], []
        for m, c, v in zip(marked, col, n):
            for i in range(len(m) - k + 1):
                keys.append(m[i : i + k])
                cols.append(c)
                values.append(v)
        by_length.append(scores(keys, np.array(cols, dtype=int), np.array(values), grams) if keys else {})
    return Model(languages, share / share.sum(), scores(list(table["w"]), col, n, words), by_length)


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row; only the text decides."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by WORDS, GRAMS and the languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for first, last, _, _ in slices(batch.column("text")):
                part = batch.slice(first, last - first)
                langs, scores = m.predictions(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
