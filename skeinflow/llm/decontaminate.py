"""Benchmark decontamination with a broadcast set of normalised test n-grams.

The test items' word windows form a table that is as large as the benchmark,
not the corpus; it is written once, broadcast only after its rows and bytes have
been counted.  Beyond ``broadcast_limit`` rows or BROADCAST_BYTES its 64-bit
hashes are broadcast instead, HASH_LIMIT at once, and only windows whose hash is
among them are shuffled to be compared.  Training texts are cut into chunks of
words (so that one long text is many small rows) in one pass for all lengths of
windows, every window is compared with the set by its whole string, which
verifies a hit, and only hits are grouped.

Defined results: null and empty texts have no words and no hits; an item with
no words matches nothing; repeated rows each get the same result; the key of a
row is its id together with a hash of its text, so equal ids with different
texts don't mix; extra columns are kept by ``decontaminate`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch

WINDOW = 10
CHUNK_WORDS = 256
BROADCAST_LIMIT = 500_000
BROADCAST_BYTES = 128 << 20
#: Hashes of windows that are broadcast at once, beyond the limits above.
HASH_LIMIT = 4_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _listed(apart_from: str) -> str:
    """The ASCII characters but some, one by one for a class: Java looks such a class up in one table, and tries ranges in turn."""
    return "".join(f"\\x{c:02X}" for c in range(128) if chr(c) not in apart_from)


#: Of lower-cased texts, and of texts as they are.
_NOT_WORD = f"[{_listed('0123456789' + _LOWER)}]"
_NOT_WORD_ANY = f"[{_listed('0123456789' + _LOWER + _UPPER)}]"
_WORD = f"[^{_listed('0123456789' + _LOWER + _UPPER)}]"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; the fast built-in does it where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _NOT_WORD + "+"), "")


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_WORD + "+")).cast("long")


def _windows(source: Column, length: int) -> Column:
    """All windows of ``length`` words of an array, as strings, in order."""
    return F.when(
        F.size(source) >= length,
        F.transform(F.sequence(F.lit(1), F.size(source) - (length - 1)), lambda i: F.array_join(F.slice(source, i, F.lit(length)), " ")),
    )


def item_grams(benchmark: DataFrame, window: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """gram, length, items (sorted distinct ids as strings): each distinct window of the items."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w"))
    grams = F.when(F.size("w") >= window, _windows(F.col("w"), window)).when(F.size("w") > 0, F.array(F.array_join("w", " ")))
    return (
        items.select("item", F.explode(grams).alias("gram"), F.least(F.size("w"), F.lit(window)).alias("length"))
        .groupBy("gram", "length")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )


def _key(doc_id: str, text: str) -> list[Column]:
    return [F.col(doc_id).alias("__doc"), F.xxhash64(F.col(text)).alias("__fp")]


def _numbered(chunk: Column, length: int) -> Column:
    """Structs of place and window for the windows of ``length`` words that start among a chunk's first CHUNK_WORDS words."""
    last = F.least(F.lit(CHUNK_WORDS), F.size(chunk) - (length - 1))
    made = F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.struct(i.alias("i"), F.array_join(F.slice(chunk, i + 1, F.lit(length)), " ").alias("gram")))
    return F.when(F.size(chunk) >= length, made).otherwise(F.array().cast("array<struct<i: int, gram: string>>"))


def spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", broadcast_limit: int = BROADCAST_LIMIT, item_text: str = "text", hash_limit: int = HASH_LIMIT) -> DataFrame:
    """__doc, __fp, spans array<struct<start, length>> (sorted, distinct), items: one row for each text with hits."""
    grams = scratch.keep(item_grams(benchmark, window, text=item_text), "item-grams")
    size = F.sum(F.octet_length("gram") + F.octet_length(F.array_join("items", " ")) + F.lit(24) * F.size("items"))
    counted = grams.groupBy("length").agg(F.count("*").alias("n"), size.alias("bytes")).collect()  # at most `window` rows
    lengths = sorted(r["length"] for r in counted) or [window]
    n, size_ = sum(r["n"] for r in counted), sum(r["bytes"] for r in counted)
    step, least, most = CHUNK_WORDS, lengths[0], lengths[-1]
    source = docs.select(*_key(doc_id, text), words(F.col(text)).alias("w"))
    starts = F.when(F.size("w") >= least, F.sequence(F.lit(0), F.size("w") - least, F.lit(step)))
    chunks = source.select("__doc", "__fp", F.posexplode(F.transform(starts, lambda s: F.slice("w", s + 1, F.lit(step + most - 1)))).alias("c", "chunk"))
    made = [_numbered(F.col("chunk"), length) for length in lengths]
    rows = chunks.select("__doc", "__fp", "c", F.inline(made[0] if len(made) == 1 else F.concat(*made))).select("__doc", "__fp", (F.col("c") * step + F.col("i")).alias("start"), "gram")
    # Windows of different lengths differ in their number of words, so a window's string tells its length.
    if n <= broadcast_limit and size_ <= BROADCAST_BYTES:
        hits = rows.join(F.broadcast(grams), "gram")
    else:
        # The corpus is sifted by broadcast hashes, in blocks of a bounded size; only what passes is shuffled and compared by its string.
        blocks = max(1, -(-n // hash_limit))
        hashes = scratch.keep(grams.select(F.xxhash64("gram").alias("h")).distinct().withColumn("block", F.pmod(F.col("h"), F.lit(blocks)).cast("int")), "gram-hashes")
        hashed, passed = rows.withColumn("h", F.xxhash64("gram")), None
        for block in range(blocks):
            mine = hashed.join(F.broadcast(hashes.filter(F.col("block") == block).select("h")), "h", "left_semi").drop("h")
            passed = mine if passed is None else passed.unionByName(mine)
        hits = passed.join(grams, "gram")
    return hits.groupBy("__doc", "__fp").agg(
        F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def covered(spans_: Column) -> Column:
    """Number of words in the union of sorted spans."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def step(acc: Column, s: Column) -> Column:
        end = (s["start"] + s["length"]).cast("long")
        new = end - F.greatest(s["start"].cast("long"), acc["end"])
        return F.struct((acc["n"] + F.greatest(new, F.lit(0).cast("long"))).alias("n"), F.greatest(acc["end"], end).alias("end"))

    return F.coalesce(F.aggregate(spans_, zero, step, lambda acc: acc["n"]), F.lit(0).cast("long"))


def _joined(docs: DataFrame, hits: DataFrame, how: str) -> DataFrame:
    return docs.join(hits, docs["__doc"].eqNullSafe(hits["__doc"]) & docs["__fp"].eqNullSafe(hits["__fp"]), how)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", broadcast_limit: int = BROADCAST_LIMIT, item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (ids as strings, sorted), contaminated for every document."""
    hits = spans(docs, benchmark, window, doc_id, text, broadcast_limit, item_text)
    every = docs.select(*_key(doc_id, text), count_words(F.col(text)).alias("n_words"))
    hits = hits.select(F.col("__doc").alias("__d"), F.col("__fp").alias("__f"), covered(F.col("spans")).alias("hit"), F.col("items").alias("its"))
    return every.join(hits, every["__doc"].eqNullSafe(hits["__d"]) & every["__fp"].eqNullSafe(hits["__f"]), "left").select(
        F.col("__doc").alias("doc_id"),
        "n_words",
        F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("its"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("its", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("hit", F.lit(0)) > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", item_text: str = "text") -> DataFrame:
    """The documents without those that hold a window of an item, or (``remove="spans"``) with the hit words and what separates them from the word before cut out."""
    columns = docs.columns
    hits = spans(docs, benchmark, window, doc_id, text, item_text=item_text)
    keyed = docs.withColumns({"__doc": F.col(doc_id), "__fp": F.xxhash64(F.col(text))})
    if remove == "documents":
        hits = hits.select(F.col("__doc").alias("__d"), F.col("__fp").alias("__f"))
        return keyed.join(hits, keyed["__doc"].eqNullSafe(hits["__d"]) & keyed["__fp"].eqNullSafe(hits["__f"]), "left_anti").select(*[keyed[c] for c in columns])
    if remove != "spans":
        raise ValueError("remove is 'documents' or 'spans'")
    hits = hits.select(F.col("__doc").alias("__d"), F.col("__fp").alias("__f"), F.col("spans").alias("__spans"))
    joined = keyed.join(hits, keyed["__doc"].eqNullSafe(hits["__d"]) & keyed["__fp"].eqNullSafe(hits["__f"]), "left")
    units = F.regexp_extract_all(F.col(text), F.lit(f"(?s){_NOT_WORD_ANY}*{_WORD}+"), F.lit(0))
    tail = F.regexp_extract(F.col(text), f"(?s){_NOT_WORD_ANY}*\\z", 0)
    left = F.filter(units, lambda u, i: ~F.exists("__spans", lambda s: (i >= s["start"]) & (i < s["start"] + s["length"])))
    cut = F.when(F.col("__spans").isNull(), F.col(text)).otherwise(F.concat(F.array_join(left, ""), tail))
    return joined.withColumn(text, cut).select(*columns)

