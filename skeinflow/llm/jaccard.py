"""Exact n-gram Jaccard join: which documents' shingle sets are similar, and the groups that the links make.

Sets are put in one global order, rare shingles first, by counts of all
shingles in a table of fixed size (any function of a shingle gives a valid
order; the counts make it a good one).  Two similar sets share a shingle within
a short prefix of each, so an index list is kept for every prefix shingle, whose
entries carry the set's size and the shingle's position.

* Lists with one set, the most, end there.  Equal sets are one entry.
* Answers of similar sets: of every list's entries of about one size the smallest
  is their pivot, and the others are compared with it first.  Sets linked to a
  pivot are in one group, and a list whose sets are in one group already is
  skipped as a whole.  Then each group is compared with the likeliest other
  group of each of its lists, for a few rounds, so that large groups grow
  together from a few pairs for each set before all that is left is compared.
* Elsewhere the list is taken in order of size.  Whole blocks of it are skipped
  by size and by position (what follows the position can't hold enough common
  shingles).  For the rest, the differences from the common pivot that are known
  already decide by the triangle inequality both ways, and then a sketch of the
  set (a lower bound of the difference) before any two sets are compared.

Lists, pivots' entries and pairs are streams or are bounded: a list of more than
``BLOCK`` entries is dealt as pairs of blocks, a pivot with very many entries
is salted.

Defined results: texts without words and null texts have empty sets, which are
linked with nothing; with fewer words than ``k`` all of them are one shingle;
repeated rows and equal texts are in one group; null ids are kept and are no
group's smallest id unless alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..operators.components import connected_components
from .textarrays import SPACE_WORD, Words, grams, mix, slices
from .tokenize import forget

COUNTERS = 1 << 21
CHUNKS = 16
BLOCK = 4_000
SALT_ROWS = 4_000
FILTER_BITS = 1 << 24
#: Rounds in which each group's likeliest partner of each list is compared.
GROWING = 2
#: Then: pairs of two groups that are compared before the groups are looked at again; None: all.
ROUNDS = (1, 16, None)


def shingle_sets(text: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text."""
    for first, last, data, offsets in slices(text):
        words = Words(data, offsets, SPACE_WORD, lower=True)
        h = words.hashes()
        g = grams(h, k)
        b = words.bounds.tolist()
        for i in range(last - first):
            lo, hi = b[i], b[i + 1]
            if hi - lo >= k:
                yield first + i, np.unique(g[lo : hi - k + 1])
            elif hi > lo:
                yield first + i, grams(h[lo:hi], hi - lo)
            else:
                yield first + i, h[lo:hi]


def node_of(s: np.ndarray) -> int:
    """Identity of a set: sums of two mixes and the size, in 64 bits."""
    a = mix(s).sum(dtype=np.uint64)
    b = mix(s ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
    return int(mix(np.array([a ^ mix(np.array([b + np.uint64(len(s))]))[0]], np.uint64)).view(np.int64)[0])


def bins_of(n: int) -> int:
    """Bins of a sketch of n shingles: a power of two, about half as many."""
    return 1 << min(max(8, (n - 1).bit_length() - 1), 20)


def sketch(s: np.ndarray) -> bytes:
    """A 4-bit sum over the hashes in each of bins_of() ranges: where two sketches differ, the sets differ."""
    count = bins_of(len(s))
    shift = np.uint64(64 - count.bit_length() + 1)
    edges = np.searchsorted(s, np.arange(count, dtype=np.uint64) << shift)
    total = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(mix(s) & np.uint64(15), out=total[1:])
    nibble = ((total[np.append(edges[1:], len(s))] - total[edges]) & np.uint64(15)).astype(np.uint8).reshape(-1, 2)
    return (nibble[:, 0] << 4 | nibble[:, 1]).tobytes()


def halved(sketches: np.ndarray) -> np.ndarray:
    """The sketches (rows) with half as many bins: sums of neighbours."""
    one = (((sketches >> 4) + (sketches & 15)) & 15).reshape(len(sketches), -1, 2)
    return one[:, :, 0] << 4 | one[:, :, 1]


class Sketches:
    """Sketches of a list's entries, by their number of bins; sizes that may link have the same number or twice as many."""

    def __init__(self, blobs: list[bytes]):
        self.size = np.array([len(b) for b in blobs])
        self.place = np.zeros(len(blobs), int)
        self.full, self.half = {}, {}
        for size in np.unique(self.size).tolist():
            rows = np.flatnonzero(self.size == size)
            self.place[rows] = np.arange(len(rows))
            self.full[size] = np.frombuffer(b"".join([blobs[i] for i in rows.tolist()]), np.uint8).reshape(len(rows), size)
        for size in self.full:
            if size // 2 in self.full:
                self.half[size] = halved(self.full[size])

    def differ(self, i: int, js: np.ndarray) -> np.ndarray:
        """A lower bound of the differences of entry i from entries of the same size or larger ones."""
        out = np.zeros(len(js), np.int64)
        mine = self.full[int(self.size[i])][self.place[i]]
        for size, table in ((self.size[i], self.full), (self.size[i] * 2, self.half)):
            at = np.flatnonzero(self.size[js] == size)
            if len(at):
                out[at] = _NIBBLES[table[int(size)][self.place[js[at]]] ^ mine].sum(axis=1, dtype=np.int64)
        return out


_NIBBLES = np.array([(i >> 4 != 0) + (i & 15 != 0) for i in range(256)], np.uint8)


def most_different(a, b, percent: int):
    """Largest symmetric difference of two sets of these sizes that still link."""
    return (100 - percent) * (a + b) // (100 + percent)


def _count_table(docs: DataFrame, k: int) -> np.ndarray:
    """How often shingles fall on each of COUNTERS counters, over all texts."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        table = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column("text")):
                g = grams(Words(data, offsets, SPACE_WORD, lower=True).hashes(), k)
                table += np.bincount((g & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        # A partition's count beyond 16 bits stays there: such a shingle is late in the order anyway.
        parts = np.minimum(table, 0xFFFF).astype(np.uint16).reshape(CHUNKS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["chunk", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, blob in zip(batch.column("chunk").to_pylist(), batch.column("counts")):
                part = np.frombuffer(blob.as_buffer(), np.uint16).astype(np.int64)
                sums[c] = sums[c] + part if c in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(s, 0xFFFFFFFF).astype(np.uint32).tobytes() for s in sums.values()], pa.binary())], names=["chunk", "counts"])

    kind = "chunk int, counts binary"
    rows = docs.mapInArrow(partial, kind).repartition(CHUNKS, "chunk").mapInArrow(total, kind).collect()  # COUNTERS numbers
    parts = dict(map(tuple, rows))
    return np.concatenate([np.frombuffer(parts[c], np.uint32) for c in range(CHUNKS)]) if parts else np.zeros(COUNTERS, np.uint32)


def _indexer(sent, k: int, percent: int):
    """doc_id, n, node, and the prefix in order with the sketch (only where the set is the partition's first of its kind)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        counts = sent.value
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n, nodes, prefixes, sketches = [], [], [], []
                for _, s in shingle_sets(part.column("text"), k):
                    n.append(len(s))
                    if not len(s):
                        nodes.append(None)
                        prefixes.append(None)
                        sketches.append(None)
                        continue
                    node = node_of(s)
                    nodes.append(node)
                    if node in seen:
                        prefixes.append(None)
                        sketches.append(None)
                        continue
                    sketches.append(sketch(s))
                    if len(seen) < 500_000:
                        seen.add(node)
                    size = len(s) - (percent * len(s) + 99) // 100 + 1
                    order = (counts[(s & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(32)) | (s >> np.uint64(32))
                    if size < len(s):
                        some = np.argpartition(order, size - 1)[:size]
                        # Ties at the edge would be broken by chance: all of the last key's equals stay.
                        some = np.flatnonzero(order <= order[some].max())
                    else:
                        some = np.arange(len(s))
                    some = some[np.lexsort((s[some], order[some]))]
                    prefixes.append(s[some].view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["doc_id", "n", "node", "prefix", "sketch"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [s for _, s in shingle_sets(part.column("text"), k) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "set"])

    return run


def _comparer(percent: int):
    """Rows of a pivot come together, its own set first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, own = None, None
        for batch in batches:
            out: list[tuple[int, int, int, bool]] = []
            for p, node, blob in zip(batch.column("pivot").to_pylist(), batch.column("node").to_pylist(), batch.column("set")):
                s = np.frombuffer(blob.as_buffer(), np.uint64)
                if p == node:
                    pivot, own = p, s
                    continue
                assert p == pivot
                at = np.searchsorted(own, s)
                common = int((own[np.minimum(at, len(own) - 1)] == s).sum())
                different = len(own) + len(s) - 2 * common
                out.append((p, node, different, 100 * common >= percent * (len(own) + len(s) - common)))
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], names=["pivot", "node", "different", "linked"])

    return run


def in_bitmap(docs: DataFrame, doc_id: str, ids: DataFrame) -> DataFrame:
    """The rows of docs with __may: whether their id may be among ids (id), by a bitmap of FILTER_BITS, which is broadcast."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (place(c) % 64).cast("int"))
    bitmap = ids.groupBy(F.floor(place(F.col("id")) / 64).alias("__word")).agg(F.bit_or(bit(F.col("id"))).alias("__bits"))
    joined = docs.join(F.broadcast(bitmap), F.floor(place(docs[doc_id]) / 64) == F.col("__word"), "left")
    return joined.withColumn("__may", F.coalesce(F.col("__bits").bitwiseAND(bit(docs[doc_id])) != 0, F.lit(False))).drop("__word", "__bits")


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs (doc_id) that may be among ids (id), so that few others are shuffled."""
    return in_bitmap(docs, "doc_id", ids).filter("__may").drop("__may")


def _compare(pairs: DataFrame, docs: DataFrame, first: DataFrame, k: int, percent: int) -> DataFrame:
    """pivot, node, different, linked of distinct (pivot, node) pairs; first: node and the id of a document that has its set."""
    wanted = pairs.select(F.explode(F.array("pivot", "node")).alias("v")).distinct()
    ids = scratch.keep(first.join(wanted, F.col("node") == F.col("v"), "left_semi").select("node", "id"), "wanted")
    texts = _only(docs, ids.select("id")).join(ids.select("id").distinct(), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("text")
    sets = scratch.keep(texts.mapInArrow(_sets(k), "node long, set binary"), "sets").dropDuplicates(["node"])
    many = pairs.groupBy(F.col("pivot").alias("p")).agg(F.ceil(F.count("*") / SALT_ROWS).alias("salts"))
    salted = pairs.join(many, F.col("pivot") == F.col("p")).select("pivot", "node", F.pmod(F.xxhash64("node"), F.col("salts")).alias("salt"))
    own = salted.select("pivot", F.col("pivot").alias("node"), "salt").distinct()
    rows = salted.unionByName(own).join(sets.select(F.col("node").alias("id"), "set"), F.col("node") == F.col("id")).select("pivot", "salt", "node", "set")
    ordered = rows.repartition("pivot", "salt").sortWithinPartitions(F.col("pivot"), F.col("salt"), F.col("pivot") != F.col("node"))
    return scratch.keep(ordered.select("pivot", "node", "set").mapInArrow(_comparer(percent), "pivot long, node long, different long, linked boolean"), "compared")


def likely(n: np.ndarray, pos: np.ndarray, group: np.ndarray, away: np.ndarray, pivot: np.ndarray, sketches: Sketches | None, side: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(entry, later entries, the sketches' differences): pairs of a list's entries, in different groups, that can't be told apart by size, position, distance from a common pivot or (if given) sketch; entries in order of size."""
    for i in range(len(n) - 1):
        # Sizes are sorted: entries too large for this one are skipped as a block.
        top = int(np.searchsorted(n, n[i] * 100 // percent, side="right"))
        js = np.arange(i + 1, top)
        if not len(js):
            continue
        most = most_different(n[i], n[js], percent)
        need = (n[i] + n[js] - most + 1) // 2
        fine = (group[js] != group[i]) & (np.minimum(n[i] - pos[i], n[js] - pos[js]) >= need)
        if side[i] >= 0:
            fine &= side[js] != side[i]
        known = (away[js] >= 0) & (away[i] >= 0) & (pivot[js] == pivot[i])
        fine &= ~(known & (np.abs(away[js] - away[i]) > most))
        js, most = js[fine], most[fine]
        differ = np.zeros(len(js), np.int64)
        if len(js) and sketches is not None:
            differ = sketches.differ(i, js)
            js, differ = js[differ <= most], differ[differ <= most]
        if len(js):
            yield i, js, differ


def partnered(pairs: Iterator[tuple[int, np.ndarray, np.ndarray]], count: int) -> list[int]:
    """The entries that are in a pair."""
    there = np.zeros(count, bool)
    for i, js, _ in pairs:
        there[i] = there[js] = True
    return np.flatnonzero(there).tolist()


def likeliest(pairs: Iterator[tuple[int, np.ndarray, np.ndarray]], group: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(entry, entry, difference) of each group's pair with the smallest difference; the first of equals."""
    _, code = np.unique(group, return_inverse=True)
    best = np.full(int(code.max()) + 1 if len(code) else 0, 1 << 62)
    pair = np.zeros((len(best), 2), np.int64)
    for i, js, gap in pairs:
        order = np.lexsort((gap, code[js]))
        first = order[np.flatnonzero(np.diff(code[js[order]], prepend=-1))]
        first = first[gap[first] < best[code[js[first]]]]
        best[code[js[first]]] = gap[first]
        pair[code[js[first]]] = np.stack([np.full(len(first), i), js[first]], axis=1)
        low = int(gap.argmin())
        if gap[low] < best[code[i]]:
            best[code[i]] = gap[low]
            pair[code[i]] = i, js[low]
    for g in np.flatnonzero(best < 1 << 62).tolist():
        yield int(pair[g, 0]), int(pair[g, 1]), int(best[g])


_ENTRY = ("tok", "b1", "b2", "node", "n", "pos", "label", "away", "pivot", "side")
_ENTRY_TYPES = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
_ENTRY_SCHEMA = "tok long, b1 int, b2 int, node long, n int, pos int, label long, away long, pivot long, side int"


def _in_lists(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[tuple]]:
    """The entries of one list (or pair of blocks) after another."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[batch.column(c).to_pylist() for c in names])

    for _, members in groupby(rows(), key=lambda r: r[:3]):
        yield sorted(members, key=lambda r: r[4])


def _lister(percent: int, growing: bool):
    """The pairs of each list that sketches don't tell apart: of each group the likeliest (``growing``), or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(pairs: set[tuple[int, int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1, 2)], names=["pivot", "node", "gap"])

        pairs: set[tuple[int, int, int]] = set()
        for members in _in_lists(batches, (*_ENTRY, "sketch")):
            _, _, _, node, n, pos, label, away, pivot, side, sk = zip(*members)
            if len(set(label)) < 2:
                continue
            n, pos, label, away, pivot, side = map(np.array, (n, pos, label, away, pivot, side))
            found = likely(n, pos, label, away, pivot, Sketches(list(sk)), side, percent)
            every = likeliest(found, label) if growing else ((i, j, g) for i, js, gap in found for j, g in zip(js.tolist(), gap.tolist()))
            for i, j, gap in every:
                pairs.add((min(node[i], node[j]), max(node[i], node[j]), gap))
                if len(pairs) > 50_000:
                    yield out(pairs)
                    pairs = set()
        yield out(pairs)

    return run


def _skipper(percent: int):
    """The entries that size, position and distance leave with a possible partner in their list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []

        def out() -> pa.RecordBatch:
            cols = list(zip(*kept)) or [()] * len(_ENTRY)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _ENTRY_TYPES)], names=list(_ENTRY))

        for members in _in_lists(batches, _ENTRY):
            _, _, _, _, n, pos, label, away, pivot, side = map(np.array, zip(*members))
            kept += [members[x] for x in partnered(likely(n, pos, label, away, pivot, None, side, percent), len(n))]
            if len(kept) > 50_000:
                yield out()
                kept = []
        yield out()

    return run


_LIST = ("tok", "node", "n", "pos", "pivot", "pn", "ppos")
_LIST_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32())


def _sifter(percent: int):
    """The entries of each list that have a partner of a near size and position in it; lists of more than BLOCK go through whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []

        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*[batch.column(c).to_pylist() for c in _LIST])

        def out() -> pa.RecordBatch:
            cols = list(zip(*kept)) or [()] * len(_LIST)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _LIST_TYPES)], names=list(_LIST))

        for _, entries in groupby(rows(), key=lambda r: r[0]):
            members = list(islice(entries, BLOCK))
            if len(members) < BLOCK:
                members.sort(key=lambda r: r[2])
                _, node, n, pos, _, _, _ = map(np.array, zip(*members))
                alone = np.full(len(n), -1)
                members = [members[x] for x in partnered(likely(n, pos, node, alone, alone, None, alone, percent), len(n))]
            kept += members
            for r in entries:
                kept.append(r)
                if len(kept) > 50_000:
                    yield out()
                    kept.clear()
            if len(kept) > 50_000:
                yield out()
                kept.clear()
        yield out()

    return run


def _sketched(percent: int):
    """The pairs (pivot, node, their sizes and sketches) that the sketches leave possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = []
            n, pn = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "pn"))
            most = most_different(n, pn, percent).tolist()
            for a, b, m in zip(batch.column("s1").to_pylist(), batch.column("s2").to_pylist(), most):
                few = Sketches(sorted((a, b), key=len))
                fine.append(bool(few.differ(0, np.array([1]))[0] <= m))
            yield pa.RecordBatch.from_arrays([batch.column("pivot"), batch.column("node")], names=["pivot", "node"]).filter(pa.array(fine, pa.bool_()))

    return run


def classes(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (size of the set), component (smallest id of the group) of every document."""
    kind = docs.schema[doc_id].dataType.simpleString()
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(_count_table(narrow.select("text"), k))  # COUNTERS numbers
    index = scratch.keep(narrow.mapInArrow(_indexer(sent, k, percent), f"doc_id {kind}, n long, node long, prefix array<long>, sketch binary"), "index")

    entries = index.filter(F.size("prefix") > 0).select("node", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "tok")).repartition("tok")
    # All columns are used on both sides, so that both read one and the same exchange.
    about = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent))).cast("int")  # sizes of one number may link
    pivots = entries.groupBy(F.col("tok").alias("t"), about.alias("about")).agg(F.min(F.struct("node", "n", "pos")).alias("p"), F.max("node").alias("last"))
    # A list has a few dozen sizes.
    pivots = pivots.groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct("about", "p"))).alias("ps"), F.min("p.node").alias("first"), F.max("last").alias("last")).filter("first < last").select("t", "ps")
    met = entries.join(pivots, F.col("tok") == F.col("t")).withColumn("p", F.element_at("ps", about)).select("tok", "node", "n", "pos", F.col("p.node").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.pos").alias("ppos"))
    lists = scratch.keep(met.sortWithinPartitions("tok").mapInArrow(_sifter(percent), "tok long, node long, n int, pos int, pivot long, pn int, ppos int"), "lists")

    most = F.floor((100 - percent) * (F.col("n") + F.col("pn")) / (100 + percent))
    need = F.ceil((F.col("n") + F.col("pn") - most) / 2)
    may = (F.least("n", "pn") * 100 >= F.greatest("n", "pn") * percent) & (F.least(F.col("n") - F.col("pos"), F.col("pn") - F.col("ppos")) >= need)
    sketches = index.filter("sketch is not null").select(F.col("node").alias("id"), "sketch").dropDuplicates(["id"])
    pairs = lists.filter((F.col("node") != F.col("pivot")) & may).select("pivot", "node", "n", "pn").distinct()
    one = sketches.select(F.col("id").alias("id1"), F.col("sketch").alias("s1"))
    two = sketches.select(F.col("id").alias("id2"), F.col("sketch").alias("s2"))
    stars = pairs.join(one, F.col("pivot") == F.col("id1")).join(two, F.col("node") == F.col("id2")).select("pivot", "node", "n", "pn", "s1", "s2")
    stars = scratch.keep(stars.mapInArrow(_sketched(percent), "pivot long, node long"), "stars")

    first = index.filter("node is not null").groupBy("node").agg(F.min(F.struct("doc_id")).alias("d")).select("node", F.col("d.doc_id").alias("id"))
    near = _compare(stars, narrow, first, k, percent)
    links = near.filter("linked").select(F.col("pivot").alias("u"), F.col("node").alias("v"))
    labels = scratch.keep(connected_components(links), "labels")

    label = labels.select(F.col("node").alias("l"), "component")
    open_lists = lists.join(label, F.col("node") == F.col("l"), "left").withColumn("label", F.coalesce("component", "node")).drop("l", "component")
    open_lists = scratch.keep(open_lists.distinct(), "labelled")
    mixed = open_lists.groupBy(F.col("tok").alias("t")).agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("lo < hi").select("t", "blocks")
    away = near.select(F.col("pivot").alias("ap"), F.col("node").alias("an"), F.col("different").alias("away"))
    rows = (
        open_lists.join(mixed, F.col("tok") == F.col("t"))
        .join(away, (F.col("pivot") == F.col("ap")) & (F.col("node") == F.col("an")), "left")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("tok", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), F.when(F.col("block") == F.col("other"), -1).otherwise(F.col("block")).alias("side"), "node", "n", "pos", "label", "pivot",
                F.when(F.col("node") == F.col("pivot"), 0).otherwise(F.coalesce("away", F.lit(-1))).cast("long").alias("away"))
    )
    dealt = ["tok", "b1", "b2"]
    may = rows.repartition(*dealt).sortWithinPartitions(*dealt).mapInArrow(_skipper(percent), _ENTRY_SCHEMA)
    opened = scratch.keep(may.join(sketches, F.col("node") == F.col("id")).drop("id"), "open")

    def linked_by(labels: DataFrame, now: DataFrame) -> DataFrame:
        more = now.filter("linked").select(F.col("pivot").alias("u"), F.col("node").alias("v"))
        return scratch.keep(connected_components(labels.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more)), "labels")

    def pairs_of(labels: DataFrame, growing: bool) -> DataFrame:
        named = opened.drop("label").join(labels.select(F.col("node").alias("l"), "component"), F.col("node") == F.col("l"), "left").withColumn("label", F.coalesce("component", "node"))
        ordered = named.select(*_ENTRY, "sketch").repartition(*dealt).sortWithinPartitions(*dealt)
        return scratch.keep(ordered.mapInArrow(_lister(percent, growing), "pivot long, node long, gap long").distinct().join(compared, ["pivot", "node"], "left_anti"), "pairs")

    compared, pairs = near.select("pivot", "node"), None
    for _ in range(GROWING):
        pairs = pairs_of(labels, growing=True)
        if pairs.isEmpty():
            break
        now = _compare(pairs.select("pivot", "node").distinct(), narrow, first, k, percent)
        compared = compared.unionByName(now.select("pivot", "node"))
        labels = linked_by(labels, now)
    pairs = pairs_of(labels, growing=False)
    # Groups only have to be joined once: the likeliest pairs of two groups are compared first, and
    # what these join needs no more comparing.  The last round takes all that is left.
    for share in ROUNDS:
        at = lambda end: labels.select(F.col("node").alias(f"{end}_node"), F.col("component").alias(f"{end}_group"))  # noqa: E731, B023
        grouped = pairs.join(at("l"), F.col("pivot") == F.col("l_node"), "left").join(at("r"), F.col("node") == F.col("r_node"), "left")
        ends = grouped.select("pivot", "node", "gap", F.coalesce("l_group", "pivot").alias("l"), F.coalesce("r_group", "node").alias("r")).filter("l != r")
        pairs = scratch.keep(ends, "pairs")
        if pairs.isEmpty():
            break
        pick = pairs
        if share:
            best = pairs.groupBy(F.least("l", "r"), F.greatest("l", "r"), F.pmod(F.xxhash64("pivot", "node"), F.lit(share))).agg(F.min(F.struct("gap", "pivot", "node")).alias("p"))
            pick = best.select("p.*")
        now = _compare(pick.select("pivot", "node").distinct(), narrow, first, k, percent)
        labels = linked_by(labels, now)
        pairs = pairs.join(now.select("pivot", "node"), ["pivot", "node"], "left_anti").select("pivot", "node", "gap")

    label = labels.select(F.col("node").alias("l"), "component")
    every = scratch.keep(index.select("doc_id", "n", "node").join(label, F.col("node") == F.col("l"), "left").select("doc_id", "n", F.coalesce("component", "node").alias("label")), "classes")
    # Written, so that a label of very many documents is a skewed join, which can be split.
    least = scratch.keep(every.filter("label is not null").groupBy(F.col("label").alias("g")).agg(F.min("doc_id").alias("least")), "least")
    return every.join(least, F.col("label") == F.col("g"), "left").select("doc_id", "n", F.coalesce("least", "doc_id").alias("component"))


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that are in a group with a smaller id."""
    found = classes(docs, k, percent, doc_id, text).filter(F.col("doc_id") != F.col("component")).select(F.col("doc_id").alias("id")).distinct()
    gone = scratch.keep(found, "gone")
    marked = in_bitmap(docs, doc_id, gone)
    # Only rows that may go are shuffled.
    rest = marked.filter("__may").join(gone.withColumnRenamed("id", "__id"), F.col(doc_id) == F.col("__id"), "left_anti")
    return marked.filter("not __may").unionByName(rest).select(*docs.columns)
