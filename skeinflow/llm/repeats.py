"""Removal of passages that have occurred before, with Aho-Corasick automata over words.

A window is ``window`` consecutive words.  Every window has an anchor, the
smallest hash among its runs of ANCHOR words, so equal windows have equal
anchors.  Consecutive windows of one document with the same anchor make a
segment, one for about seven words.  All documents stream through automata as
their segments, which are dealt by anchor, so that a segment meets the one
shard whose automaton can hold its windows, and equal segments stream once.

1. Segments are dealt by anchor.  An anchor that occurs once can't belong to a
   recurring window, and most segments go no further.  Copies of a segment within
   some MB of a task's texts are set aside before that: all but the first are repeats.
2. Segments with the same words as an earlier one are repeats as a whole.
3. Where an anchor has different segments (or a segment repeats itself), each
   different segment is fetched as words and dealt by anchor.  Each shard takes
   them a bounded number at a time, confirms which windows recur, compiles an
   automaton of those and streams the segments through it in document order;
   every window located after its first occurrence is a repeat.  An anchor with
   very many segments is salted over several groups; the groups' own firsts are
   then compared by an aggregation over windows.

Windows are judged on the input, and always by their words: in shards as words,
elsewhere by BLAKE2 digests of all words of a segment (64 bits) within one
anchor, or of a window (128 bits).  The rolling hashes only deal the work.

Defined results: a null text has no words; order is doc_id (null first), then
position; of rows that share an id none is earlier than another (each is judged
by itself and by smaller ids; the key of a row is its id and, where an id has
several texts, a hash of its text); repeated rows get equal results; a text of
fewer than ``window`` words is left as it is; very long texts are handled whole,
in segments; an empty table gives an empty one.  Ids are integers.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from .jaccard import in_bitmap
from .textarrays import SPACE_WORD, Words, grams, mix, slices
from .tokenize import forget

WINDOW = 20
ANCHOR = 8
#: Segments of an anchor in one group, and segments compiled at a time.
GROUP, COMPILED = 500, 2_000
#: Bytes of texts among whose segments a task sets copies aside.
ASIDE = 8 << 20
_NONE = -(1 << 63)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows with ``doc`` and ``fp``, their key, and ``text`` and ``rest`` (their other columns): fp is 0 where the id has one text."""
    doc, fp = F.coalesce(F.col(doc_id).cast("long"), F.lit(_NONE)), F.xxhash64(F.col(text))
    shared = docs.select(doc.alias("id"), fp.alias("fp")).groupBy("id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi").select("id")
    rows = docs.select(doc.alias("doc"), F.col(text).alias("text"), F.struct(*[docs[c] for c in docs.columns if c != text], F.lit(0).alias("__")).alias("rest"))
    marked = in_bitmap(rows, "doc", scratch.keep(shared, "shared-ids"))
    return marked.select("doc", F.when(F.col("__may"), F.xxhash64("text")).otherwise(F.lit(0).cast("long")).alias("fp"), "text", "rest")


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of each run of k values."""
    have = 1
    while have * 2 <= k:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return x if have == k else np.minimum(x[: len(x) - (k - have)], x[k - have :])


def _joined(words: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words with one space between, and where each begins and ends."""
    inside = SPACE_WORD[words.data]
    keep = inside.copy()
    keep[words.ends[words.ends < len(keep)]] = True
    place = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    return np.where(inside, words.data, np.uint8(0x20))[keep].tobytes(), place[words.starts], place[words.ends]


def segments(words: Words, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, anchor, digest of the words, 1 if a window recurs inside) of the segments of one slice's texts."""
    hashes, bounds = words.hashes(), words.bounds
    n = len(hashes) - window + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int8))
    k = min(ANCHOR, window)
    small = grams(hashes, k)
    low = sliding_min(small, window - k + 1)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    whole = text[:n] == text[window - 1 :]
    joined = np.zeros(n + 1, bool)
    joined[1:n] = (low[1:] == low[:-1]) & whole[1:] & whole[:-1] & (text[1:n] == text[: n - 1])
    first = np.flatnonzero(whole & ~joined[:n])
    last = np.flatnonzero(whole & ~joined[1:])
    length = last - first + 1
    blob, begin, end = _joined(words)
    seg = np.array([int.from_bytes(hashlib.blake2b(blob[a:b], digest_size=8).digest(), "little") for a, b in zip(begin[first].tolist(), end[last + window - 1].tolist())], np.uint64)
    loops = np.zeros(len(first), np.int8)
    reach = np.arange(window - k + 1)
    left = first + (small[first[:, None] + reach] == low[first][:, None]).argmax(axis=1)
    right = last + (small[last[:, None] + reach[::-1]] == low[last][:, None]).argmax(axis=1) * -1 + (window - k)
    for i in np.flatnonzero(left != right):  # the anchor stands in several places
        g = grams(hashes[first[i] : last[i] + window], window)
        loops[i] = len(np.unique(g)) < len(g)
    return text[first], first - bounds[text[first]], length, low[first], seg, loops


_SEGMENTS = "anchor long not null, seg long not null, doc long not null, fp long not null, start int not null, n int not null, kind byte not null"


def _set_aside(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """The segments (anchor, seg, doc, fp, start, n, kind) of which no copy has a smaller id here; kind 2: repeats."""
    a, s, d, f, p, n, kind = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((p, f, d, s, a))
    a, s, d, f, p, n, kind = (x[order] for x in (a, s, d, f, p, n, kind))
    new, mine = np.ones(len(a), bool), np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
    mine[1:] = new[1:] | (d[1:] != d[:-1]) | (f[1:] != f[:-1])
    at = np.arange(len(a))
    lead, own = np.maximum.accumulate(np.where(new, at, 0)), np.maximum.accumulate(np.where(mine, at, 0))
    late = (d > d[lead]) | (p > p[own])
    kind = np.where(late, 2, kind).astype(np.int8)
    # Repeats go along only to be handed on; a hash of their place deals them evenly.
    a = np.where(late, mix(a ^ d.astype(np.uint64) ^ mix(p.astype(np.uint64))), a)
    keep = mine | late  # the others are rows that are repeated
    return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (a.view(np.int64), s.view(np.int64), d, f, p.astype(np.int32), n.astype(np.int32), kind)], names=["anchor", "seg", "doc", "fp", "start", "n", "kind"])


def _segmenter(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0
        for batch in batches:
            docs, fps = batch.column("doc").to_numpy(), batch.column("fp").to_numpy()
            for first, _, data, offsets in slices(batch.column("text")):
                text, start, n, anchor, seg, kind = segments(Words(data, offsets, SPACE_WORD, lower=False), window)
                parts.append((anchor, seg, docs[first + text], fps[first + text], start, n, kind))
                held += len(data)
                if held >= ASIDE:
                    yield _set_aside(parts)
                    parts, held = [], 0
        if parts:
            yield _set_aside(parts)

    return run


def _cutter(window: int):
    """Words of the wanted segments of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"anchor": pa.int64(), "salt": pa.int32(), "doc": pa.int64(), "fp": pa.int64(), "start": pa.int32(), "words": pa.binary()}
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                out: list[list] = [[] for _ in kinds]
                for doc, fp, text, wanted in zip(*[part.column(c).to_pylist() for c in ("doc", "fp", "text", "wanted")]):
                    words = (text or "").encode().split()
                    for w in wanted:
                        for o, v in zip(out, (w["anchor"], w["salt"], doc, fp, w["start"], b" ".join(words[w["start"] : w["start"] + w["n"] + window - 1]))):
                            o.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds.values())], names=list(kinds))

    return run


class _Firsts:
    """Where windows occur first: the smallest id, and the first place in each of its texts."""

    def __init__(self):
        self.where: dict = {}

    def late(self, window, doc: int, fp: int, at: int) -> bool:
        """Whether the window has occurred before; to be asked in order."""
        first, places = self.where.setdefault(window, (doc, {}))
        return doc > first or places.setdefault(fp, at) < at


def locate(rows: list[tuple[int, int, int, list[bytes]]], window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """(doc, fp, start, windows) of the runs of windows that occur earlier in rows (doc, fp, start, words), which are in order."""
    import ahocorasick

    number: dict[bytes, int] = {}
    lines = [tuple([number.setdefault(w, len(number)) for w in words]) for *_, words in rows]
    count = Counter(line[i : i + window] for line in lines for i in range(len(line) - window + 1))
    recurring = [w for w, c in count.items() if c > 1]
    if not recurring:
        return []
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for i, w in enumerate(recurring):
        automaton.add_word(w, i)
    automaton.make_automaton()
    firsts = _Firsts()
    out: list[tuple[int, int, int, int]] = []
    for (doc, fp, start, _), line in zip(rows, lines):
        for end, i in automaton.iter(line):
            at = start + end - window + 1
            if firsts.late(i, doc, fp, at):
                if out and out[-1][:2] == (doc, fp) and out[-1][2] + out[-1][3] == at:
                    out[-1] = (doc, fp, out[-1][2], out[-1][3] + 1)
                else:
                    out.append((doc, fp, at, 1))
    return out


def _locator(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*[batch.column(c).to_pylist() for c in ("anchor", "salt", "doc", "fp", "start", "words")])

        def out(found: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*found)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["doc", "fp", "start", "n", "first"])

        group: list[tuple[int, int, int, list[bytes]]] = []
        for (_, salt), members in groupby(rows(), key=lambda r: r[:2]):
            mine = [(d, f, p, w.split(b" ")) for _, _, d, f, p, w in members]
            if salt < 0:
                group += mine
                if len(group) >= COMPILED:
                    yield out([(*r, None) for r in locate(sorted(group, key=lambda r: r[:3]), window)])
                    group = []
                continue
            seen = _Firsts()
            for d, f, p, w in mine:
                for i in range(len(w) - window + 1):
                    seen.late(hashlib.blake2b(b" ".join(w[i : i + window]), digest_size=16).digest(), d, f, p + i)
            yield out([(*r, None) for r in locate(mine, window)] + [(d, f, p, 1, h) for h, (d, places) in seen.where.items() for f, p in places.items()])
        yield out([(*r, None) for r in locate(sorted(group, key=lambda r: r[:3]), window)])

    return run


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc, fp, start, n: runs of n windows (from word ``start``) of a document that occur earlier."""
    return _repeats(_keyed(docs, doc_id, text).select("doc", "fp", "text"), window)


def _repeats(rows: DataFrame, window: int) -> DataFrame:
    found = rows.mapInArrow(_segmenter(window), _SEGMENTS).repartition("anchor")
    # All columns are used here, so that both uses read one and the same exchange.
    known = found.groupBy("anchor").agg(
        F.count("*").alias("c"), F.min("seg").alias("lo"), F.max("seg").alias("hi"), F.max("kind").alias("loop"), F.min("doc").alias("d0"), F.min("fp").alias("f0"), F.min("start").alias("s0"), F.max("n").alias("n0")
    )
    known = known.filter("(c > 1 or loop = 1) and d0 is not null and f0 is not null and s0 is not null and n0 is not null").select(F.col("anchor").alias("a"), "c", ((F.col("lo") != F.col("hi")) | (F.col("loop") == 1)).alias("several"))
    kept = scratch.keep(found.join(known, F.col("anchor") == F.col("a"), "left").filter("kind = 2 or c is not null").drop("a"), "segments")
    whole = kept.filter("kind < 2")
    least = whole.groupBy(F.col("anchor").alias("a"), F.col("seg").alias("s")).agg(F.min("doc").alias("least"))
    placed = whole.join(least, (F.col("anchor") == F.col("a")) & (F.col("seg") == F.col("s"))).drop("a", "s")
    again = placed.filter("doc > least")
    # A segment's firsts: its smallest id, and all texts of that.
    firsts = placed.filter("several and doc = least").dropDuplicates(["anchor", "seg", "doc", "fp"])
    salt = F.when(F.col("c") > GROUP, F.pmod(F.xxhash64("doc"), F.ceil(F.col("c") / GROUP))).otherwise(-1).cast("int")
    wanted = firsts.select(F.col("doc").alias("d"), F.col("fp").alias("f"), F.struct("anchor", salt.alias("salt"), "start", "n").alias("w")).groupBy("d", "f").agg(F.collect_list("w").alias("wanted"))
    cut = rows.repartition("doc", "fp").join(wanted, (F.col("doc") == F.col("d")) & (F.col("fp") == F.col("f"))).dropDuplicates(["doc", "fp"]).select("doc", "fp", "text", "wanted")
    cut = cut.mapInArrow(_cutter(window), "anchor long, salt int, doc long, fp long, start int, words binary")
    located = cut.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "doc", "fp", "start").mapInArrow(_locator(window), "doc long, fp long, start int, n int, first binary")
    located = scratch.keep(located, "located")
    place = ["doc", "fp", "start", "n"]
    runs = kept.filter("kind = 2").select(place).unionByName(again.select(place)).unionByName(located.filter("first is null").select(place))
    salted = located.filter("first is not null")
    best = salted.groupBy(F.col("first").alias("h")).agg(F.min("doc").alias("least"), F.count("*").alias("c")).filter("c > 1").select("h", "least")
    return runs.unionByName(salted.join(best, F.col("first") == F.col("h")).filter("doc > least").select(place))


def _covered(count: int, runs: list, window: int) -> np.ndarray:
    """Which of count words lie in a run's windows."""
    edge = np.zeros(count + 1, np.int64)
    for r in runs:
        edge[min(r["start"], count)] += 1
        edge[min(r["start"] + r["n"] + window - 1, count)] -= 1
    return np.cumsum(edge[:count]) > 0


def _with_runs(rows: DataFrame, window: int) -> DataFrame:
    """The keyed rows with their ``runs``."""
    runs = _repeats(rows.select("doc", "fp", "text"), window).groupBy(F.col("doc").alias("d"), F.col("fp").alias("f")).agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    return rows.repartition("doc", "fp").join(runs, (F.col("doc") == F.col("d")) & (F.col("fp") == F.col("f")), "left").drop("d", "f")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    rows = _keyed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text").select("doc", "fp", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                total, removed, digest = [], [], []
                for t, runs in zip(part.column("text").to_pylist(), part.column("runs").to_pylist()):
                    words = (t or "").encode().split()
                    total.append(len(words))
                    gone = _covered(len(words), runs or [], window)
                    removed.append(int(gone.sum()))
                    digest.append(hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if runs else words)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], names=["doc", "n_words", "n_removed", "kept_sha256"])

    out = _with_runs(rows, window).select("doc", "text", "runs").mapInArrow(run, "doc long, n_words long, n_removed long, kept_sha256 string")
    return out.select(F.when(F.col("doc") != _NONE, F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents with repeated words cut out of their texts, each with the white space before it; texts without repeats are untouched."""
    joined = _with_runs(_keyed(docs, doc_id, text), window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, runs in enumerate(batch.column("runs").to_pylist()):
                if runs and texts[i] is not None:
                    data = texts[i].encode()
                    words = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), SPACE_WORD, lower=False)
                    gone = _covered(len(words.starts), runs, window)
                    before = np.concatenate([[0], words.ends[:-1]])
                    keep = [data[a:b] for a, b, g in zip(before.tolist(), words.ends.tolist(), gone.tolist()) if not g]
                    texts[i] = (b"".join(keep) + data[words.ends[-1] :]).decode()
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column("rest")], names=["text", "rest"])

    changed = joined.select("text", "rest", "runs").mapInArrow(run, joined.select("text", "rest").schema)
    return changed.select(*[F.col("text").alias(c) if c == text else F.col("rest").getField(c).alias(c) for c in docs.columns])
