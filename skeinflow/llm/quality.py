"""Quality by co-training: a text view and a metadata view teach each other, and their calibrated scores are combined.

Two faults are told apart, each with classifiers of its own: low quality
(labels.quality = 0) and toxicity (labels.toxic = 1).  The models are fitted on
a bounded sample: at most ``labelled`` labelled texts and ``pool`` unlabelled
ones, chosen by a hash of their ids; everything is then scored.  The sample's features
are made and counted on the executors; the driver gets no texts but, for each
sampled row, the hashes of its features that LEAST sampled rows have.

Text view: the words, word beginnings (also those that several words of a text
have) and word ends that set faulty texts apart (a lexicon of at most LEXICON
hashed features with their log odds), and a few ratios (repeated words, capitals, digits, other signs, word length, size), under a
logistic regression.  The lexicon's sums for training rows come from lexicons
of the other folds.  Metadata view: smoothed log odds of source and language
and the declared length, under a logistic regression.

Rounds: each view labels the pool; what it is most confident of, GROWTH rows
of a kind at most, joins the other view's training rows.  At the end a held-out
part of the labelled rows, in no training set, calibrates each view (a logistic
regression on its logit) and weighs the two.

Defined results: a null text is an empty one; a null or unseen source or
language has no log odds; without labels nothing is rejected and all scores are
0; a fault that has no example is never found; labels with null ids or values
are left out, of several labels of a document the worst counts; rows are scored
each by itself, so repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from .textarrays import ALNUM_WORD, SPACE_WORD, Words, mix, release_memory, slices, span_hashes
from .tokenize import forget

LABELLED, POOL = 4_000, 1_000
LEXICON = 20_000
#: Least likelihood ratio of a lexicon feature.
EVIDENCE = 20.0
#: Least number of rows that have it.
LEAST = 4
ROUNDS, GROWTH, SURE = 3, 300, 0.97
FOLDS = 4
#: A fault this probable rejects; half would let three times as many toxic texts through for a few clean ones more.
THRESHOLD = 0.3
FAULTS = ("low", "toxic")
PREFIX_BYTES, SUFFIX_BYTES = 5, 3
RATIOS = 7


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature hash) pairs, not yet distinct, and ratios by row, of the texts of one slice."""
    rows = len(offsets) - 1
    low = Words(data, offsets, ALNUM_WORD, lower=True)
    spaced = Words(data, offsets, SPACE_WORD, lower=False)

    def cut(words: Words, starts: np.ndarray, ends: np.ndarray, kind: int) -> np.ndarray:
        out = span_hashes(words.data, starts, ends)
        out += np.uint64(kind)
        return mix(out)

    row_low = np.repeat(np.arange(rows), np.diff(low.bounds))
    row_spaced = np.repeat(np.arange(rows), np.diff(spaced.bounds))
    whole = cut(low, low.starts, low.ends, 1)
    begun = cut(low, low.starts, np.minimum(low.starts + PREFIX_BYTES, low.ends), 2)
    ended = cut(spaced, np.maximum(spaced.ends - SUFFIX_BYTES, spaced.starts), spaced.ends, 3)
    again = _several(row_low, begun)
    size = np.maximum(np.diff(offsets), 1)

    def ratio(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[offsets[1:]] - total[offsets[:-1]]) / size

    capital = (data >= 0x41) & (data <= 0x5A)
    digit = (data >= 0x30) & (data <= 0x39)
    other = ~ALNUM_WORD[data] & SPACE_WORD[data]
    words = np.diff(spaced.bounds)
    same = np.zeros(len(spaced.starts) + 1, int)
    if len(spaced.starts) > 1:
        each = cut(spaced, spaced.starts, spaced.ends, 4)
        same[2:] = np.cumsum((each[1:] == each[:-1]) & (row_spaced[1:] == row_spaced[:-1]))
    repeats = (same[spaced.bounds[1:]] - same[spaced.bounds[:-1]]) / np.maximum(words, 1)
    ratios = np.stack([repeats, ratio(capital), ratio(digit), ratio(other), size / np.maximum(words, 1) / 10, np.log1p(words), np.log1p(size)], axis=1)
    return np.concatenate([row_low, row_low, row_spaced, row_low[again]]), np.concatenate([whole, begun, ended, mix(begun[again] + np.uint64(5))]), ratios


def _several(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places of the second and later occurrences of a key in a row."""
    both = mix(key ^ mix(row.astype(np.uint64)))
    order = np.argsort(both, kind="stable")
    return order[1:][both[order[1:]] == both[order[:-1]]]


def _sums(row: np.ndarray, odds: np.ndarray, rows: int) -> np.ndarray:
    """For each row and fault: sum of positive odds, of negative odds, and greatest odds; a row's features (row, odds by fault) each once."""
    out = np.zeros((rows, 3 * odds.shape[1]))
    for f in range(odds.shape[1]):
        o = odds[:, f]
        out[:, 3 * f] = np.log1p(np.bincount(row, np.maximum(o, 0), rows))
        out[:, 3 * f + 1] = -np.log1p(np.bincount(row, np.maximum(-o, 0), rows))
        np.maximum.at(out[:, 3 * f + 2], row, o)
    return out


@dataclass
class Lexicon:
    keys: np.ndarray  # sorted
    odds: np.ndarray  # (features, faults)

    def sums(self, row: np.ndarray, key: np.ndarray, rows: int) -> np.ndarray:
        """For each row and fault: sum of positive odds, of negative odds, and greatest odds, each feature once."""
        if not len(self.keys):
            return np.zeros((rows, 3 * self.odds.shape[1]))
        seen = self._may(key)
        row, key = row[seen], key[seen]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        pair = np.unique(row[hit].astype(np.int64) * len(self.keys) + at[hit])
        return _sums(pair // len(self.keys), self.odds[pair % len(self.keys)], rows)

    def _may(self, key: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_table"):
            self._table = np.zeros(1 << 20, bool)
            self._table[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return self._table[(key & np.uint64((1 << 20) - 1)).astype(np.int64)]


def _xlog(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
    return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / expected), 0.0)


def learn_odds(row: np.ndarray, code: np.ndarray, codes: int, y: np.ndarray, known: np.ndarray) -> np.ndarray:
    """(codes, faults): log odds of the features whose share of faulty rows (y, by fault) differs most surely from that of sound ones, 0 for all others; only rows in ``known`` count."""
    use = known[row]
    row, code, faults = row[use], code[use], y.shape[1]
    total = np.bincount(code, minlength=codes).astype(float)
    odds, sure = np.zeros((codes, faults)), np.zeros(codes)
    for f in range(faults):
        bad = np.bincount(code, weights=y[row, f], minlength=codes)
        n_bad, n = y[known, f].sum(), known.sum()
        if not n_bad or n_bad == n:
            continue
        lo = np.log((bad + 0.5) / (n_bad + 1)) - np.log((total - bad + 0.5) / (n - n_bad + 1))
        # The likelihood ratio of the feature's two shares against one common share.
        g = 2 * (_xlog(bad, np.maximum(total, 1) * n_bad / n) + _xlog(total - bad, np.maximum(total, 1) * (n - n_bad) / n))
        odds[:, f] = np.where((g > EVIDENCE) & (total >= LEAST), lo, 0)
        sure = np.maximum(sure, np.where(odds[:, f] != 0, g, 0))
    odds[np.argsort(-sure, kind="stable")[LEXICON:]] = 0
    return odds


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.w[1:] + self.w[0], -30, 30)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Logistic:
    """Newton's method on standardised columns, with a ridge and a little prior."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    share = (y.sum() + 0.5) / (len(y) + 1)
    w[0] = np.log(share / (1 - share))
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    loss = lambda w: np.logaddexp(0, z @ w).sum() - y @ (z @ w) + 0.5 * penalty @ (w * w)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + penalty * w
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty)
        step, t, now = np.linalg.solve(h, g), 1.0, loss(w)
        while loss(w - t * step) > now and t > 1e-4:
            t /= 2
        w = w - t * step
        if np.abs(t * step).max() < 1e-7:
            break
    return Logistic(mean, scale, w)


@dataclass
class Meta:
    """Smoothed log odds of a row's source and language, by fault."""

    tables: list[dict]

    def columns(self, meta: list[tuple], f: int) -> np.ndarray:
        out = np.zeros((len(meta), 4))
        for i, (source, lang, n) in enumerate(meta):
            out[i, 0] = self.tables[f].get(("s", source), 0.0)
            out[i, 1] = self.tables[f].get(("l", lang), 0.0)
            out[i, 2] = np.log1p(max(n or 0, 0))
        out[:, 3] = out[:, 2] ** 2
        return out


def learn_meta(meta: list[tuple], y: np.ndarray, known: np.ndarray) -> Meta:
    tables: list[dict] = []
    for f in range(y.shape[1]):
        share = (y[known, f].sum() + 0.5) / (known.sum() + 1)
        count: dict = {}
        for i in np.flatnonzero(known):
            for k in (("s", meta[i][0]), ("l", meta[i][1])):
                if k[1] is not None:
                    c = count.setdefault(k, [0.0, 0.0])
                    c[0] += y[i, f]
                    c[1] += 1
        tables.append({k: float(np.log((a + 20 * share) / (n - a + 20 * (1 - share))) - np.log(share / (1 - share))) for k, (a, n) in count.items()})
    return Meta(tables)


@dataclass
class Model:
    lexicon: Lexicon
    meta: Meta
    text_view: list[Logistic]
    meta_view: list[Logistic]
    combine: list[Logistic]
    present: list[bool]

    def probabilities(self, row: np.ndarray, key: np.ndarray, ratios: np.ndarray, meta: list[tuple]) -> np.ndarray:
        """(rows, faults): combined; faults without an example are 0."""
        out = np.zeros((len(ratios), len(self.present)))
        x = np.column_stack([self.lexicon.sums(row, key, len(ratios)), ratios])
        for f, there in enumerate(self.present):
            if there:
                both = np.column_stack([self.text_view[f].logit(x), self.meta_view[f].logit(self.meta.columns(meta, f))])
                out[:, f] = 1 / (1 + np.exp(-self.combine[f].logit(both)))
        return out


def cotrain(row: np.ndarray, key: np.ndarray, ratios: np.ndarray, meta: list[tuple], y: np.ndarray, labelled: np.ndarray, fold: np.ndarray, rounds: int = ROUNDS, growth: int = GROWTH, sure: float = SURE) -> Model:
    """A model from (row, feature) pairs (distinct), ratios, metadata and labels; fold 0 of the labelled rows calibrates."""
    n, faults = len(ratios), y.shape[1]
    keys, code = np.unique(key, return_inverse=True)
    code = code.astype(np.int32)
    del key
    calibrating = labelled & (fold == 0)
    train = labelled & ~calibrating
    if not calibrating.any() or not train.any():
        calibrating = train = labelled
    given = {"text": (train.copy(), y.astype(float).copy()), "meta": (train.copy(), y.astype(float).copy())}
    present = [0 < y[labelled, f].sum() < labelled.sum() and y[train, f].any() for f in range(faults)]
    pool = ~labelled

    def sums_of(odds: np.ndarray) -> np.ndarray:
        some = odds.any(axis=1)[code]
        return _sums(row[some], odds[code[some]], n)

    for r in range(rounds + 1):
        known, target = given["text"]
        odds = learn_odds(row, code, len(keys), target, known)
        x = np.column_stack([sums_of(odds), ratios])
        for k in range(FOLDS):  # a training row's sums come from a lexicon that hasn't seen it
            mine = known & (fold == k)
            if mine.any() and (known & ~mine).any():
                x[mine, : 3 * faults] = sums_of(learn_odds(row, code, len(keys), target, known & ~mine))[mine]
        text_view = [fit_logistic(x[known], target[known, f]) for f in range(faults)]
        known_m, target_m = given["meta"]
        table = learn_meta(meta, target_m, known_m)
        columns = [table.columns(meta, f) for f in range(faults)]
        meta_view = [fit_logistic(columns[f][known_m], target_m[known_m, f]) for f in range(faults)]
        if r == rounds:
            break
        for view, other in (("text", "meta"), ("meta", "text")):
            logits = np.column_stack([text_view[f].logit(x) if view == "text" else meta_view[f].logit(columns[f]) for f in range(faults)])
            p = 1 / (1 + np.exp(-logits))
            known_o, target_o = given[other]
            free = pool & ~known_o
            certain = free & ((p > sure) | (p < 1 - sure)).all(axis=1)
            for kind in (certain & (p > 0.5).any(axis=1), certain & (p < 0.5).all(axis=1)):
                rows_ = np.flatnonzero(kind)
                rows_ = rows_[np.argsort(-np.abs(logits[rows_]).min(axis=1), kind="stable")][:growth]
                known_o[rows_] = True
                target_o[rows_] = p[rows_] > 0.5
    combine = []
    for f in range(faults):
        both = np.column_stack([text_view[f].logit(x), meta_view[f].logit(columns[f])])
        combine.append(fit_logistic(both[calibrating], y[calibrating, f].astype(float), ridge=0.1))
    used = odds.any(axis=1)
    return Model(Lexicon(keys[used], odds[used]), table, text_view, meta_view, combine, present)


def distinct_features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The distinct feature hashes and the ratios of each text."""
    for _, _, data, offsets in slices(texts):
        row, key, ratios = features(data, offsets)
        parts = np.split(key[np.argsort(row, kind="stable")], np.cumsum(np.bincount(row, minlength=len(ratios)))[:-1])
        yield from zip(map(np.unique, parts), ratios)


def _featurizer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            found = list(distinct_features(part.column("t")))
            added = [pa.array([k.view(np.int64) for k, _ in found], pa.list_(pa.int64())), pa.array([x.tolist() for _, x in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in _SAMPLE], *added], names=[*_SAMPLE, "keys", "ratios"])


#: Columns of a sampled row beside its text: id, text's hash, source, language, length, faults (null: unlabelled).
_SAMPLE = ("d", "h", "s", "l", "n", "low", "toxic")


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", labelled: int = LABELLED, pool: int = POOL) -> Model | None:
    """A model from a bounded sample; None without labels."""
    known = labels.filter("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").alias("__l")).agg((F.min("quality") == 0).cast("int").alias("low"), (F.max("toxic") == 1).cast("int").alias("toxic"))
    rows = docs.select(F.col(doc_id).alias("d"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("t"), F.col(source).cast("string").alias("s"), F.col(lang).cast("string").alias("l"), F.col(n_chars).cast("double").alias("n"))
    n_known = known.count()
    if not n_known:
        return None
    n_rows = max(1, docs.count())
    place = F.pmod(F.xxhash64("d", F.lit(11)), F.lit(1 << 24)) / float(1 << 24)
    # Labels outside the sample's reach are cut before the join, by the same hash of the id.
    some = known.filter(F.pmod(F.xxhash64(F.col("__l").cast(docs.schema[doc_id].dataType), F.lit(11)), F.lit(1 << 24)) / float(1 << 24) < labelled / n_known)
    wanted = rows.filter(place < max(labelled / n_known, pool / n_rows)).join(F.broadcast(some), F.col("d") == F.col("__l"), "left")
    sample = wanted.filter(F.col("__l").isNotNull() | (place < pool / n_rows)).select(*_SAMPLE, "t")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sample.schema if f.name != "t")
    made = scratch.keep(sample.mapInArrow(_featurizer, f"{kind}, keys array<long>, ratios array<double>").withColumn("u", F.monotonically_increasing_id()), "quality-sample")
    order = made.drop("keys").toArrow().sort_by([("d", "ascending"), ("h", "ascending"), ("u", "ascending")])  # `labelled` + `pool` rows of numbers
    low, toxic = order.column("low").to_pylist(), order.column("toxic").to_pylist()
    has = np.array([v is not None for v in low], bool)
    if not has.any():
        scratch.drop(made)
        return None
    each = made.select("u", F.explode("keys").alias("key"))
    often = each.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") >= LEAST).select("key")
    pairs = each.join(often, "key").groupBy("u").agg(F.collect_list("key").alias("keys")).toArrow()  # a sampled row's features, hashed
    lists = pairs.column("keys").combine_chunks()
    key = lists.flatten().to_numpy().view(np.uint64)
    where = np.argsort(order.column("u").to_numpy())
    at = where[np.searchsorted(order.column("u").to_numpy()[where], pairs.column("u").to_numpy())]
    row = np.repeat(at, np.diff(lists.offsets.to_numpy())).astype(np.int32)
    del pairs, lists
    scratch.drop(made)
    meta = list(zip(order.column("s").to_pylist(), order.column("l").to_pylist(), order.column("n").to_pylist()))
    ratios = order.column("ratios").combine_chunks().flatten().to_numpy().reshape(len(has), RATIOS)
    y = np.column_stack([[v or 0 for v in low], [v or 0 for v in toxic]]).astype(float)
    fold = np.arange(len(has)) % FOLDS
    model = cotrain(row, key, ratios, meta, y, has, fold)
    del row, key, ratios, order
    release_memory()  # the driver goes on to other stages
    return model


def score(docs: DataFrame, model: Model | None, text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars") -> DataFrame:
    """The rows with __low and __toxic, the probabilities of the two faults."""
    if model is None:
        return docs.withColumns({"__low": F.lit(0.0), "__toxic": F.lit(0.0)})
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a lexicon of at most LEXICON features

    def probabilities(batch: pa.RecordBatch) -> np.ndarray:
        texts = batch.column(batch.schema.get_field_index(text))
        meta = list(zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (source, lang, n_chars)]))
        parts = []
        for first, last, data, offsets in slices(texts):
            row, key, ratios = features(data, offsets)
            parts.append(sent.value.probabilities(row, key, ratios, meta[first:last]))
        return np.concatenate(parts) if parts else np.zeros((0, 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            p = probabilities(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p[:, 0]), pa.array(p[:, 1])], names=[*batch.schema.names, "__low", "__toxic"])

    return docs.mapInArrow(run, docs.withColumns({"__low": F.lit(0.0), "__toxic": F.lit(0.0)}).schema)


def accepted(threshold: float = THRESHOLD):
    """Whether a row that score() returned has neither fault."""
    return (F.col("__low") < threshold) & (F.col("__toxic") < threshold)
