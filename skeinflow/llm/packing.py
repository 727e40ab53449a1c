"""Mixture-controlled packing of token ids into sequences of a fixed length.

Documents are tokenised once into the shared folder and dealt by a hash of
their key into lanes of about ``lane_tokens`` tokens; a lane is one group, so
its size is bounded however the sources are distributed.  In a lane every
source is a queue in key order, and the windows are filled one after another by
deficit round-robin: a window credits each source with its target share of the
window, the source with the largest deficit is served next, and what it was
given more or less than its due is carried into the next window.  A lane begins
with the deficits that the lanes before it leave behind.  Those follow from the
lanes' totals alone (due share of all their tokens less the tokens they had),
so lanes are packed side by side.  When a source runs dry, the others go on.

What is left at a lane's end is cut into sequences whose lengths are powers of
two, which need no padding.

Defined results: a null text is an empty one and has the end token alone; a null
source is a source of its own; an empty table has no pieces; repeated rows are
packed each by itself, in an order among them that doesn't matter because they
are alike (rows with equal ids and different texts are ordered by their ids'
bytes).
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import scratch
from .textarrays import slices
from .tokenize import encoder

LENGTH = 2048
END = 1
LANE_TOKENS = 2_000_000
#: Lanes whose totals are summed in one task.
BLOCK_LANES = 4096
#: A source is served at least so many tokens at once, so that texts aren't cut into shreds.
MIN_SERVE = 256
#: Bytes of text that are tokenised at once.
SLICE_BYTES = 1 << 22
#: Tokens a byte, for the number of lanes only.
TOKENS_PER_BYTE = 0.45


def tokenized(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", source: str = "source", lanes: int = 1, end: int = END) -> DataFrame:
    """__lane, __doc, __source, __n, __ids (unsigned 16-bit where all ids fit, told by __wide)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, last = encoder(tokenizer), np.array([end], "<u4")
        for batch in batches:
            for first, after, data, offsets in slices(batch.column("text"), SLICE_BYTES):
                part = batch.slice(first, after - first)
                n, wide, small = [], [], []
                found, at = enc.texts(data, offsets)
                for i in range(len(part)):
                    ids = np.concatenate([found[at[i] : at[i + 1]], last])
                    n.append(len(ids))
                    wide.append(int(ids.max()) > 0xFFFF)
                    small.append(ids.astype("<u4" if wide[-1] else "<u2").tobytes())
                yield pa.RecordBatch.from_arrays([part.column("lane"), part.column("doc"), part.column("source"), pa.array(n, pa.int64()), pa.array(wide, pa.bool_()), pa.array(small, pa.binary())], names=["__lane", "__doc", "__source", "__n", "__wide", "__ids"])

    narrow = docs.select(F.pmod(F.xxhash64(F.col(doc_id)), F.lit(lanes)).cast("int").alias("lane"), F.col(doc_id).cast("long").alias("doc"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "__lane int, __doc long, __source string, __n long, __wide boolean, __ids binary")


def lane_count(docs: DataFrame, text: str = "text", lane_tokens: int = LANE_TOKENS) -> int:
    size = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)))).first()[0] or 0
    return max(1, round(size * TOKENS_PER_BYTE / lane_tokens))


def deficits(tokens: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """__lane, __source, share, carried: what each lane starts with.

    Shares are ``weights`` (sources without one get nothing by right, and fill
    up what is left) or else the corpus's own proportions.  The table has a row
    for each lane and source, a few numbers each.
    """
    totals = tokens.groupBy("__lane", "__source").agg(F.sum("__n").alias("n"))
    by_source = totals.groupBy(F.col("__source").alias("s")).agg(F.sum("n").alias("n"))
    if weights is None:
        whole = totals.agg(F.sum("n")).first()[0] or 1
        shares = by_source.select("s", (F.col("n") / F.lit(whole)).alias("share"))
    else:
        total = sum(weights.values())
        table = tokens.sparkSession.createDataFrame([(k, v / total) for k, v in weights.items()], "w string, weight double")
        shares = by_source.join(table, F.col("s").eqNullSafe(F.col("w")), "left").select("s", F.coalesce("weight", F.lit(0.0)).alias("share"))
    lanes = before(totals.groupBy("__lane").agg(F.sum("n").alias("n")), []).select(F.col("__lane").alias("lane"), F.col("before").alias("so_far"))
    had = before(totals, ["__source"]).select(F.col("__lane").alias("at"), F.col("__source").alias("of"), F.col("before").alias("had"))
    return (
        had.join(lanes, F.col("at") == F.col("lane"))
        .join(shares, F.col("of").eqNullSafe(F.col("s")))
        .select(F.col("at").alias("__lane"), F.col("of").alias("__source"), "share", (F.col("share") * F.col("so_far") - F.col("had")).alias("carried"))
    )


def before(totals: DataFrame, keys: list[str]) -> DataFrame:
    """totals (__lane, keys, n) with ``before``: the sum of n of the key's rows in smaller lanes.

    Sums run within blocks of BLOCK_LANES lanes, and over the blocks' totals, so
    that no task has more rows than a block, or than there are blocks.
    """
    block = F.floor(F.col("__lane") / F.lit(BLOCK_LANES)).cast("int")
    sums = totals.groupBy(block.alias("b"), *[F.col(k).alias("of_" + k) for k in keys]).agg(F.sum("n").alias("sum"))
    earlier = W.partitionBy(*["of_" + k for k in keys]).orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("sum").over(earlier), F.lit(0))).drop("sum")
    inside = W.partitionBy("block", *keys).orderBy("__lane").rowsBetween(W.unboundedPreceding, -1)
    rows = totals.withColumn("block", block).withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    same = F.col("block") == F.col("b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("of_" + k))
    return rows.join(sums, same).select("__lane", *keys, (F.col("base") + F.col("inside")).alias("before"))


def schedule(queues: dict, share: dict, carried: dict, length: int = LENGTH, least: int = MIN_SERVE) -> Iterator[tuple[int, int, object, int, int, int]]:
    """(window, offset, source, document's place in its queue, start, tokens) by deficit round-robin; queues: source -> token counts."""
    deficit = {s: float(carried.get(s, 0.0)) for s in queues}
    at = {s: (0, 0) for s in queues}
    order = {s: i for i, s in enumerate(queues)}
    live = [s for s in queues if queues[s]]
    window = 0
    while live:
        for s in live:
            deficit[s] += share.get(s, 0.0) * length
        heap = [(-deficit[s], order[s], s) for s in live]
        heapq.heapify(heap)
        filled = 0
        while filled < length and heap:
            _, _, s = heapq.heappop(heap)
            due = max(int(deficit[s]), least)
            while due > 0 and filled < length:
                doc, start = at[s]
                if doc == len(queues[s]):
                    break
                take = min(due, length - filled, queues[s][doc] - start)
                yield window, filled, s, doc, start, take
                filled += take
                due -= take
                deficit[s] -= take
                start += take
                at[s] = (doc + 1, 0) if start == queues[s][doc] else (doc, start)
            if at[s][0] < len(queues[s]):
                heapq.heappush(heap, (-deficit[s], order[s], s))
        live = [s for s in live if at[s][0] < len(queues[s])]
        window += 1


def pack(docs: DataFrame, tokenizer: str, weights: dict[str, float] | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", length: int = LENGTH, lane_tokens: int = LANE_TOKENS, with_ids: bool = True) -> DataFrame:
    """doc_id, source, start, length, doc_tokens, sequence_id, offset, sequence_length, ids_crc32 and (``with_ids``) ids binary for each piece; ids are little-endian unsigned 32-bit."""
    lanes = lane_count(docs, text, lane_tokens)
    tokens = scratch.keep(tokenized(docs, tokenizer, doc_id, text, source, lanes), "tokens")
    starts = deficits(tokens.select("__lane", "__source", "__n"), weights)

    def one(rows: pa.Table, start: pa.Table) -> pa.Table:
        lane = rows.column("__lane")[0].as_py() if rows.num_rows else 0
        docs_, sources, wides = rows.column("__doc").to_pylist(), rows.column("__source").to_pylist(), rows.column("__wide").to_pylist()
        blobs = rows.column("__ids").combine_chunks() if rows.num_rows else pa.array([], pa.binary())
        blob = lambda i: blobs[i].as_buffer()
        counts = rows.column("__n").to_pylist()
        share = dict(zip(start.column("__source").to_pylist(), start.column("share").to_pylist()))
        carried = dict(zip(start.column("__source").to_pylist(), start.column("carried").to_pylist()))
        members: dict = {}
        for i in sorted(range(len(docs_)), key=lambda i: (docs_[i] is not None, docs_[i] or 0, counts[i], zlib.crc32(blob(i)))):
            members.setdefault(sources[i], []).append(i)
        members = {s: members[s] for s in sorted(members, key=lambda s: (s is not None, s or ""))}
        out: dict[str, list] = {k: [] for k in OUT}
        total = sum(counts)
        full, rest = divmod(total, length)
        # The last window's tail goes to sequences of powers of two.
        tails, at = [], 0
        for bit in reversed(range(length.bit_length())):
            if rest >> bit & 1:
                tails.append((at, 1 << bit))
                at += 1 << bit
        now, ids = None, None
        for window, offset, s, k, begin, take in schedule({s: [counts[i] for i in m] for s, m in members.items()}, share, carried, length):
            i = members[s][k]
            if now != i:
                now, ids = i, np.frombuffer(blob(i), "<u4" if wides[i] else "<u2").astype("<u4")
            spans = [(window, length, offset, begin, take)]
            if window >= full:
                spans = []
                for t, (low, size) in enumerate(tails):
                    a, b = max(offset, low), min(offset + take, low + size)
                    if a < b:
                        spans.append((full + t, size, a - low, begin + a - offset, b - a))
            for seq, size, off, first, n in spans:
                raw = ids[first : first + n].tobytes()
                for name, v in zip(OUT, (docs_[i], s, first, n, counts[i], (lane << 32) + seq, off, size, zlib.crc32(raw), raw if with_ids else None)):
                    out[name].append(v)
        return pa.table({k: pa.array(v, t) for (k, t), v in zip(OUT.items(), out.values())})

    grouped = tokens.groupBy("__lane").cogroup(starts.groupBy("__lane"))
    packed = grouped.applyInArrow(one, "doc_id long, source string, start long, length long, doc_tokens long, sequence_id long, offset long, sequence_length long, ids_crc32 long, ids binary")
    return packed if with_ids else packed.drop("ids")


OUT = {"doc_id": pa.int64(), "source": pa.string(), "start": pa.int64(), "length": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(), "sequence_length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.binary()}
