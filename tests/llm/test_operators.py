import collections
import hashlib
import math
import random
import re
import unicodedata
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skeinflow.llm import ann, decontaminate, jaccard, langid, licenses, packing, quality, repeats, sharding, textarrays, tokencount, tokenize
from skeinflow.llm.queries import tokenizer_file

from .conftest import edge_rows

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BENCH = "item_id long, text string"


# --- words as arrays -------------------------------------------------------


def test_words_like_a_regex():
    texts = ["a b", "", None, "Ä9 x,y", "z" * 50, " q", "r "]
    arr = pa.array(texts)
    seen = []
    for first, last, data, offsets in textarrays.slices(arr, 20):
        w = textarrays.Words(data, offsets, textarrays.ALNUM_WORD, lower=True)
        raw = w.data.tobytes()
        for i in range(last - first):
            lo, hi = w.bounds[i], w.bounds[i + 1]
            seen.append([raw[a:b].decode() for a, b in zip(w.starts[lo:hi], w.ends[lo:hi])])
    assert seen == [WORD.findall((t or "").translate(LOW)) for t in texts]


def test_hashes_depend_on_bytes_only():
    def hashes(t):
        ((_, _, data, offsets),) = textarrays.slices(pa.array([t]))
        return textarrays.Words(data, offsets, textarrays.SPACE_WORD, lower=False).hashes().tolist()

    a, b = hashes("ab cd ab"), hashes("xyz cd")
    assert a[0] == a[2] != a[1] and a[1] == b[1]


# --- 1 ---------------------------------------------------------------------


def brute_hits(docs, items, window=10):
    grams = collections.defaultdict(set)
    for item, t in items:
        w = WORD.findall((t or "").translate(LOW))
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if w else 0):
            grams[tuple(w[i : i + n])].add(str(item))
    sizes = {len(g) for g in grams}
    out = {}
    for d, t in docs:
        w = WORD.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                got = grams.get(tuple(w[i : i + n]))
                if got:
                    hit |= set(range(i, i + n))
                    found |= got
        out[d] = (len(w), len(hit), sorted(found))
    return out


def test_decontaminate_edges(spark, edge, nothing):
    rows = edge_rows()
    base = rows[0][1]
    items = [(1, " ".join(base.split()[5:17])), (2, "TWO"), (3, None), (4, ""), (5, "no such passage of ten words in any text of these"), (1, "id here")]
    bench = spark.createDataFrame(items, BENCH).withColumn("length", F.lit(1))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.report(edge, bench).collect()}
    assert got == brute_hits([(r[0], r[1]) for r in rows], items)
    assert decontaminate.report(edge, bench).count() == len(rows)
    assert decontaminate.report(nothing, bench).count() == 0
    assert decontaminate.report(edge, bench.filter("false")).filter("contaminated").count() == 0
    kept = decontaminate.decontaminate(edge, bench)
    assert kept.columns == edge.columns
    dirty = {d for d, (_, n, _) in got.items() if n}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for r in rows if r[0] not in dirty)
    cut = decontaminate.decontaminate(edge, bench, remove="spans").select("doc_id", "text").collect()
    left = brute_hits([(r["doc_id"], r["text"]) for r in cut], [(2, "TWO")])
    assert not any(n for _, n, _ in left.values())
    assert {r["doc_id"]: r["text"] for r in cut}[9] == rows[9][1]


def test_decontaminate_other_columns(spark, edge):
    bench = spark.createDataFrame([(1, "one two")], "item_id long, body string")
    docs = edge.withColumnRenamed("text", "content")
    got = decontaminate.report(docs, bench, text="content", item_text="body").filter("contaminated").select("doc_id").collect()
    assert {r["doc_id"] for r in got} == {7, 8}
    assert decontaminate.decontaminate(docs, bench, text="content", item_text="body").count() == len(edge_rows()) - 2


def test_decontaminate_without_broadcast(spark, edge):
    bench = spark.createDataFrame([(1, "one two")], BENCH)
    a = decontaminate.report(edge, bench, broadcast_limit=0).select("doc_id", "n_hit").collect()
    assert {r["doc_id"] for r in a if r["n_hit"]} == {7, 8}


def test_decontaminate_in_blocks_of_hashes(spark, edge):
    base = edge_rows()[0][1]
    items = [(1, " ".join(base.split()[5:40])), (2, "TWO"), (3, "one two"), (4, " ".join(base.split()[300:315]))]
    bench = spark.createDataFrame(items, BENCH)
    rows = lambda **how: sorted(map(str, decontaminate.spans(edge, bench, **how).collect()))
    assert rows() and rows() == rows(broadcast_limit=0, hash_limit=3) == rows(broadcast_limit=0)


def test_classes_of_word_characters_are_lists(spark):
    texts = [f"a{c}B {c}{c}" for c in map(chr, [*range(0x180), 0x2028, 0x3000, 0xFFFD, 0x1F389])]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", decontaminate.words(F.col("t")).alias("w"), decontaminate.count_words(F.col("t")).alias("n")).collect()
    want = {i: WORD.findall(t.translate(LOW)) for i, t in enumerate(texts)}
    assert {r["i"]: list(r["w"]) for r in rows} == want and {r["i"]: r["n"] for r in rows} == {i: len(w) for i, w in want.items()}
    # Java tries ranges one after another at every character, which took most of the time.
    assert "-" not in decontaminate._WORD + decontaminate._NOT_WORD + decontaminate._NOT_WORD_ANY


# --- 2 ---------------------------------------------------------------------


def test_ids_like_the_library(monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    plain = lambda t, lib=Tokenizer.from_file(path): lib.encode(t, add_special_tokens=False).ids
    rng = random.Random(8)
    pieces = [" ", "  ", "\n", "\t", "\u00a0", "\u3000", "\x1c", "\x85", "a", "b", "word", "It's", "9", ",", "...", "日本", "é", "\u200b", "<|endoftext|>", "<|end", "\ufeff", "🎉", "\r\n", "\x00"]
    texts = ["", " ", "a <|endoftext|> b", "a<|endoftext|>b", "It's  a\n\n test", *[r[1] or "" for r in edge_rows()], *["".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(600)]]
    want = [plain(t) for t in texts]
    assert want[2] == [64, 220, 50256, 275]
    e = tokenize.Encoder(path)
    assert [x.tolist() for x in e.batch(texts)] == want == [x.tolist() for x in e.batch(texts)]
    monkeypatch.setattr(tokenize, "KEPT", 10)
    small = tokenize.Encoder(path)
    assert [x.tolist() for i in range(0, len(texts), 7) for x in small.batch(texts[i : i + 7])] == want
    assert e.batch([]) == []


def test_ids_of_long_white_space():
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    plain, e = Tokenizer.from_file(path), tokenize.Encoder(path)
    run = " " * 1_000_100
    for text in [run, f"a{run}b", f"a\n{run[:150_000]}\u3000\x1c{run[:120_000]}\t", f"{run[:100_000]}\n1 {run[:99_999]}x"]:
        assert e.batch([text])[0].tolist() == plain.encode(text, add_special_tokens=False).ids


def test_ids_at_cuts(monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rng = random.Random(21)
    spaces = [c for c in map(chr, range(0x3001)) if c.isspace()]
    pieces = [*[" ", "\n"] * 8, *",.;:!?'", "a", "B", "it's", "12", "é", "日本", "×", "“", "…", "e\u0301", "<|endoftext|>", "<|end", "\r\n", *spaces]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(40))) for _ in range(4000)]
    want = [e.ids for e in plain.encode_batch_fast(texts, add_special_tokens=False)]
    assert [x.tolist() for x in tokenize.Encoder(path).batch(texts)] == want
    monkeypatch.setattr(tokenize, "BLOCK", 7)
    monkeypatch.setattr(tokenize, "KEPT", 50)
    assert [x.tolist() for x in tokenize.Encoder(path).batch(texts)] == want


def test_words_before_marks_and_line_ends_are_encoded_once(monkeypatch):
    given, whole = [], tokenize.Encoder.whole
    monkeypatch.setattr(tokenize.Encoder, "whole", lambda self, texts: given.extend(texts) or whole(self, texts))
    words = [f"w{i}" for i in range(200)]
    texts = [f"x {w}{mark}{after}{w} {w}." for w in words for mark in ("", ",", ".", ";", "!") for after in (" ", "\n")]
    path = tokenizer_file("byte_bpe_50k.json")
    got = tokenize.Encoder(path).batch(texts)
    # Each word after a space, after a line end and at a text's end; the texts' first word and the marks.
    assert sum(map(len, given)) <= sum(3 * len(w) + 4 for w in words) + 20
    monkeypatch.undo()
    assert [x.tolist() for x in got] == [x.tolist() for x in tokenize.Encoder(path).whole(texts)]


def test_other_work_gives_back_what_the_encoder_keeps():
    path = tokenizer_file("byte_bpe_50k.json")
    for work in (quality._featurizer, repeats._segmenter(20), jaccard._indexer(SimpleNamespace(value=None), 5, 80)):
        want = tokenize.encoder(path).batch(["a word, and a word"])[0].tolist()
        assert list(work(iter([]))) == [] and tokenize.encoder.cache_info().currsize == 0
        assert tokenize.encoder(path).batch(["a word, and a word"])[0].tolist() == want


@pytest.mark.parametrize("weights", [None, {"a": 3.0, "c": 1.0}])
def test_pack_round_trip(edge, weights):
    path = tokenizer_file("byte_bpe_50k.json")
    rows = packing.pack(edge, path, weights, length=64, lane_tokens=20_000).collect()
    enc = tokenize.Encoder(path)
    want = collections.Counter((r[0], tuple(enc.whole([r[1] or ""])[0].tolist()) + (1,)) for r in edge_rows())
    seqs = collections.defaultdict(list)
    pieces = collections.defaultdict(list)
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] > 0
        seqs[r["sequence_id"]].append((r["offset"], r["length"], r["sequence_length"]))
        pieces[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    for parts in seqs.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at == parts[0][2] <= 64 and at & (at - 1) == 0
    got = collections.Counter()
    for doc, parts in pieces.items():
        twins = sum(n for (d, _), n in want.items() if d == doc)
        ids = [x for _, p in sorted(parts) for x in p]
        if twins == 1:
            got[(doc, tuple(ids))] += 1
        else:  # repeated rows: each of the same ids
            (text,) = [t for (d, t) in want if d == doc]
            assert collections.Counter(ids) == collections.Counter(text * twins)
            got[(doc, text)] += twins
    assert got == want


def test_schedule_keeps_proportions():
    queues = {"a": [50] * 600, "b": [7] * 1000, "c": [900] * 3}
    total = {s: sum(q) for s, q in queues.items()}
    share = {s: n / sum(total.values()) for s, n in total.items()}
    done = collections.Counter()
    last = 0
    for window, _, s, _, _, take in packing.schedule(queues, share, {}, 128, 16):
        if window != last:
            for x in total:
                if done[x] < total[x]:
                    assert abs(done[x] - share[x] * 128 * (last + 1)) < 128
            last = window
        done[s] += take
    assert done == total


def test_sums_before_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_LANES", 4)
    rng = np.random.default_rng(5)
    rows = [(lane, s, int(rng.integers(1, 100))) for lane in range(23) for s in ("a", "b", None) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "__lane int, __source string, n long")
    got = {(r["__lane"], r["__source"]): r["before"] for r in packing.before(df, ["__source"]).collect()}
    assert got == {(lane, s): sum(n for at, of, n in rows if of == s and at < lane) for lane, s, _ in rows}
    every = df.groupBy("__lane").agg(F.sum("n").alias("n"))
    got = {r["__lane"]: r["before"] for r in packing.before(every, []).collect()}
    assert got == {lane: sum(n for at, _, n in rows if at < lane) for lane, _, _ in rows}


def test_lanes_carry_deficits(spark):
    rng = random.Random(1)
    rows = [(lane, s, rng.randrange(1, 50)) for lane in range(6) for s in ("a", "b", None) for _ in range(rng.randrange(0, 9))]
    df = spark.createDataFrame(rows, "__lane int, __source string, __n long")
    total = sum(n for _, _, n in rows)
    for r in packing.deficits(df).collect():
        share = sum(n for _, s, n in rows if s == r["__source"]) / total
        before = sum(n for lane, _, n in rows if lane < r["__lane"])
        had = sum(n for lane, s, n in rows if lane < r["__lane"] and s == r["__source"])
        assert math.isclose(r["share"], share) and math.isclose(r["carried"], share * before - had, abs_tol=1e-6)


def test_pack_nothing(nothing):
    assert packing.pack(nothing, tokenizer_file("byte_bpe_50k.json")).count() == 0


# --- 3 ---------------------------------------------------------------------


def brute_classes(docs, k, percent):
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [d for d in sets if d is not None]
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), d if d is None else find(d)) for d, s in sets.items()}


def near_copies(seed, n=150, edits=14):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    docs, bases = [], [[rng.choice(vocabulary) for _ in range(rng.choice((6, 40, 150)))] for _ in range(6)]
    common = [rng.choice(vocabulary) for _ in range(30)]
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        docs.append((i, " ".join(w + (common if i % 3 == 0 else []))))
    return docs


@pytest.mark.parametrize(("k", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (1, 50, 3)])
def test_classes_like_brute_force(spark, monkeypatch, k, percent, seed):
    monkeypatch.setattr(jaccard, "BLOCK", 20)  # lists are dealt as pairs of blocks
    monkeypatch.setattr(jaccard, "SALT_ROWS", 5)
    docs = near_copies(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n"], r["component"]) for r in jaccard.classes(df, k, percent).collect()}
    assert got == brute_classes(docs, k, percent)


def test_classes_edges(edge, nothing):
    rows = jaccard.classes(edge, 3, 90).collect()
    assert {r["doc_id"]: (r["n"], r["component"]) for r in rows} == brute_classes([(r[0], r[1]) for r in edge_rows()], 3, 90)
    assert len(rows) == len(edge_rows())
    assert jaccard.classes(nothing, 3, 90).count() == 0
    kept = jaccard.keep_first(edge, 3, 90)
    first = {r["doc_id"] for r in rows if r["doc_id"] == r["component"]}
    assert kept.columns == edge.columns and {r["doc_id"] for r in kept.collect()} == first and {1, 4, 5, 6, 7, 9, None} <= first and not {2, 8} & first


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(3)
    for n in (5, 60, 530, 800, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[n // 10 :], rng.integers(0, 1 << 63, n // 10).astype(np.uint64)]))
        for c in (b, b[: int(len(b) * 0.93)]):
            both = sorted((jaccard.sketch(a), jaccard.sketch(c)), key=len)
            assert jaccard.Sketches(both).differ(0, np.array([1]))[0] <= len(np.setxor1d(a, c))


# --- 4 ---------------------------------------------------------------------


def slow_count(word, scores, byte_score):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        width = len(word[end - 1].encode())
        options = [(best[end - 1][0] + width * byte_score, -(best[end - 1][1] + width))]
        options += [(best[i][0] + scores[word[i:end]], -(best[i][1] + 1)) for i in range(end) if word[i:end] in scores]
        s, n = max(options)
        best.append((s, -n))
    return best[-1]


def test_token_counts_like_plain_dynamic_programming(edge, nothing):
    path = tokenizer_file("piece_bpe_32k.model")
    scores = tokencount.read_scores(path)
    m = tokencount.model(path)
    rng = random.Random(2)
    words = ["▁" + "".join(rng.choice("abehtnoé日x") for _ in range(rng.randrange(0, 9))) for _ in range(300)]
    m.count(sorted(set(words), key=hash))
    for w in words:
        s, n = slow_count(w, scores, m.byte_score)
        assert m.terminals[w][0] == n and math.isclose(m.terminals[w][1], s)
    got = sorted((str(r["doc_id"]), r["n_pretokens"], r["n_tokens"]) for r in tokencount.count_tokens(edge, path).collect())
    cache = {}
    want = []
    for d, t, *_ in edge_rows():
        ws = ["▁" + w for w in (t or "").split()]
        for w in ws:
            if w not in cache:
                cache[w] = slow_count(w, scores, m.byte_score)[1]
        want.append((str(d), len(ws), sum(cache[w] for w in ws)))
    assert got == sorted(want)
    assert tokencount.count_tokens(nothing, path).count() == 0


def test_prefixes_are_scored_once():
    m = tokencount.Unigram({"a": -1.0, "ab": -1.5, "b": -1.0})
    calls = []
    extend = m.extend
    m.extend = lambda text, scores, counts: (calls.append(text[: len(scores)]), extend(text, scores, counts))
    m.count(["abab", "abba", "ab"])
    assert len(calls) == len(set(calls)) == 6


# --- 5 ---------------------------------------------------------------------


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    out = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(langid.held_out(F.col("doc_id"))).collect()
    assert len(out) > 100 and sum(r["lang_pred"] == r["lang"] for r in out) >= 0.98 * len(out)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_backoff_to_shorter_grams():
    logs = lambda *v: np.array(v, np.float32)
    m = langid.Model(["x", "y"], np.array([0.6, 0.4]), {"known": logs(1, -1)}, [{"q": logs(-2, 2)}, {}, {"abc": logs(3, -3)}, {}, {}])
    assert m.word("known").tolist() == [1, -1]
    assert m.word("zabcz").tolist() == [0.75, -0.75]
    assert m.word("q").tolist() == [-0.125, 0.125]
    assert m.predict("unseen!") == ("x", 0.6) and m.predict("12 !") == ("und", 0.0) and m.predict(None) == ("und", 0.0)


def test_letters_and_marks():
    m = langid.Model(["en", "hi"], np.array([0.6, 0.4]), {"हिन्दी": np.array([-3, 3], np.float32)}, [{}, {}, {}, {}, {}])
    assert [m.predict(t)[0] for t in ("²½①", "Ⅷ ₂ 12", "_ \u0301", "हिन्दी ²", "Ünï")] == ["und", "und", "und", "hi", "en"]
    assert langid.words_of("E\u0301té_9 हिन्दी a1b") == ["e\u0301té", "हिन्दी", "a", "b"]


def brute_languages(taught, asked):
    """The same model and scores with dictionaries and loops; all texts are in the sample, and no table is full."""
    share = collections.Counter(lang for _, lang in taught)
    langs = sorted(share, key=lambda x: (-share[x], x))
    word = lambda t: "".join(c if unicodedata.category(c)[0] == "L" else " " for c in t.lower()).split()
    count = collections.Counter((w, lang) for t, lang in taught for w in word(t))

    def scores(counts):
        keys = {k for k, _ in counts}
        total = {x: sum(n for (_, y), n in counts.items() if x == y) for x in langs}
        logs = {k: [math.log((counts[k, x] + 0.1) / (total[x] + 0.1 * len(keys))) for x in langs] for k in keys}
        return {k: [v - sum(vs) / len(vs) for v in vs] for k, vs in logs.items()}

    tables = [scores(count)]
    for k in range(1, 6):
        grams = collections.Counter()
        for (w, x), n in count.items():
            for i in range(len(w) + 3 - k):
                grams[f"<{w}>"[i : i + k], x] += n
        tables.append(scores(grams))

    def of(w):
        if w in tables[0]:
            return tables[0][w]
        for k in range(5, 0, -1):
            found = [tables[k][g] for i in range(len(w) + 3 - k) if (g := f"<{w}>"[i : i + k]) in tables[k]]
            if found:
                return [sum(v) / len(found) * 0.5 ** (5 - k) for v in zip(*found)]
        return [0.0] * len(langs)

    out = []
    for t in asked:
        total = [sum(v) for v in zip(*map(of, word(t)))] if word(t) else None
        if total is None:
            out.append(("und", 0.0))
        elif not any(total):
            out.append((langs[0], share[langs[0]] / len(taught)))
        else:
            p = [math.exp(v - max(total)) for v in total]
            out.append((langs[total.index(max(total))], max(p) / sum(p)))
    return out


def test_languages_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(langid, "AT_ONCE", 30)  # a text's words are added up in several parts
    rng = random.Random(3)
    stems = {"aa": ["ba", "lo", "mi", "né"], "bb": ["sk", "or", "ty", "øn"], "cc": ["ba", "or", "zu", "é"]}
    text = lambda x, n: " ".join("".join(rng.choice(stems[x]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    taught = [(text(x, 12), x) for x in ("aa", "bb", "cc", "aa", "bb", "aa") for _ in range(4)]
    asked = [text(rng.choice(list(stems)), rng.randrange(9)) for _ in range(40)] + ["", "12 ²", "qqq www", "Ba LO"]
    model = langid.train(spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(taught)], "doc_id long, text string, lang string").repartition(3))
    rows = langid.identify(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()
    got = [(r["lang_pred"], r["score"]) for r in sorted(rows)]
    want = brute_languages(taught, asked)
    assert [x for x, _ in got] == [x for x, _ in want] and np.allclose([s for _, s in got], [s for _, s in want], atol=1e-4)
    langs, scores = model.predictions(asked)  # here AT_ONCE holds
    assert langs == [x for x, _ in want] and np.allclose(scores, [s for _, s in want], atol=1e-4)


def test_more_languages_than_a_thousand(spark):
    df = spark.createDataFrame([(i, "same" + "".join(chr(97 + int(c)) for c in str(i)), f"l{i}") for i in range(1003)], "doc_id long, text string, lang string")
    model = langid.train(df)
    assert set(model.languages) == {f"l{i}" for i in range(1003)}


def test_language_edges(edge, nothing):
    model = langid.train(edge)
    out = {r["doc_id"]: r["lang_pred"] for r in langid.identify(edge, model).collect()}
    assert out[4] == out[5] == out[6] == "und" and out[1] == "en"
    empty = langid.train(nothing)
    assert {r["lang_pred"] for r in langid.identify(edge, empty).collect()} == {"und"}
    assert langid.identify(nothing, model).count() == 0


# --- 6 ---------------------------------------------------------------------


def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    taught = labels.filter("doc_id % 2 = 0")
    out = quality.score(docs, quality.train(docs, taught)).select("doc_id", quality.accepted().alias("keep")).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    toxic = [r["keep"] for r in out if r["toxic"] == 1]
    clean = [r["keep"] for r in out if r["toxic"] == 0 and r["quality"] == 1]
    assert sum(toxic) <= 0.05 * len(toxic) and sum(clean) >= 0.98 * len(clean)


def test_quality_edges(spark, edge, nothing):
    labels = "doc_id long, quality int, toxic int"
    none = quality.score(edge, quality.train(edge, spark.createDataFrame([], labels)))
    assert none.filter(quality.accepted()).count() == len(edge_rows()) and none.columns[: len(edge.columns)] == edge.columns
    few = spark.createDataFrame([(1, 1, 0), (7, 0, 1), (7, None, 1), (None, 0, 0), (9, 1, 0), (12, 0, 0)], labels)
    model = quality.train(edge, few)
    assert quality.score(edge, model).count() == len(edge_rows())
    assert quality.score(nothing, model).count() == 0
    assert quality.train(nothing, few) is None


# --- 7 ---------------------------------------------------------------------


def test_shards_fit(spark, edge, nothing):
    rng = random.Random(4)
    rows = [(i, "x" * rng.choice((1, 10, 200, 900))) for i in range(700)] + [(5000, "y" * 4000), (5001, None), (None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    shards = {r["prefix"] << 8 | r["depth"]: r for r in sharding.directory(df, 3000).collect()}
    placed = sharding.assign(df, sharding.directory(df, 3000)).collect()
    assert len(placed) == len(rows)
    size = collections.Counter()
    for r in placed:
        size[r["shard"]] += len(r["text"] or "")
        assert len(r["shard"]) == r["depth"]
    for r in placed:
        assert size[r["shard"]] == r["shard_bytes"] and (r["oversized"] == (r["shard_bytes"] > 3000))
        assert r["shard_bytes"] <= 3000 or r["shard_rows"] == 1
    for s in size:  # split only where it had to be: a shard and its sibling together don't fit
        if s:
            together = sum(n for x, n in size.items() if x.startswith(s[:-1]))
            assert together > 3000
    assert len(shards) == len(size)
    assert sharding.assign(edge, sharding.directory(edge)).select(*edge.columns[:5]).count() == len(edge_rows())
    assert sharding.assign(nothing, sharding.directory(nothing)).count() == 0


def test_shards_of_later_passes(spark):
    # A long text and a hot key (null ids) lie in cells with other rows, so that these are split in a second pass.
    rows = [(i, "abcd") for i in range(5000)] + [(5000, "x" * 3000)] + [(None, "abcd")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string")
    shards = sharding.directory(df, 1000)
    placed = sharding.assign(df, shards).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in placed) == collections.Counter(rows)
    assert max(r["depth"] for r in placed) > 10 and shards.agg(F.sum("shard_rows")).first()[0] == len(rows)
    size = collections.Counter()
    for r in placed:
        size[r["shard"]] += len(r["text"])
    assert all(size[r["shard"]] == r["shard_bytes"] and (r["shard_bytes"] <= 1000 or r["oversized"]) for r in placed)
    assert {r["doc_id"] for r in placed if r["oversized"]} == {5000, None}


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * 50) for i in range(40)], "doc_id long, text string")
    sharding.write_shards(df, str(tmp_path / "out"), 500)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40
    assert len(list((tmp_path / "out").glob("shard=*"))) >= 4
    own = df.withColumns({"shard": F.lit("mine"), "depth": F.lit(7)})
    sharding.write_shards(own, str(tmp_path / "own"), 500)
    back = spark.read.parquet(str(tmp_path / "own"))
    assert sorted(back.columns) == ["depth_own", "doc_id", "shard", "shard_own", "text"] and back.filter("shard_own = 'mine' and depth_own = 7").count() == 40


# --- 8 ---------------------------------------------------------------------


def brute_repeats(docs, window):
    seen, out = {}, {}
    for d, t in sorted(docs):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[i : i + window]), (d, i)) < (d, i):
                gone[i : i + window] = [True] * window
        out[d] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize(("window", "seed", "group"), [(20, 1, 500), (20, 2, 3), (5, 3, 4), (9, 4, 2)])
def test_repeats_like_brute_force(spark, monkeypatch, window, seed, group):
    monkeypatch.setattr(repeats, "GROUP", group)  # anchors are salted
    monkeypatch.setattr(repeats, "COMPILED", 7)
    rng = random.Random(seed)
    passages = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(rng.randrange(15, 60))) for _ in range(5)] + ["p q " * 40, "r " * 70]
    docs = []
    for i in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(f"u{rng.randrange(5000)}" for _ in range(rng.randrange(30))) for _ in range(rng.randrange(5))]
        docs.append((i, "\n".join(parts)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.report(df, window=window).collect()}
    assert got == brute_repeats(docs, window)


@pytest.mark.parametrize("group", [500, 2])
def test_repeats_where_ids_repeat(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    rng = random.Random(group)
    passages = [[f"p{i}w{j}" for j in range(rng.randrange(6, 25))] for i in range(6)]
    docs = []
    for i in range(80):
        words = [w for _ in range(rng.randrange(1, 6)) for w in (rng.choice(passages) if rng.random() < 0.6 else [f"u{rng.randrange(900)}" for _ in range(9)])]
        docs.append((rng.choice([None, *range(25)]), " ".join(words)))
    docs += docs[:9]
    got = collections.Counter(tuple(r) for r in repeats.report(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), window=5).collect())
    seen: dict = {}
    key = lambda d: -1 if d is None else d
    for d, t in docs:
        w = t.split()
        for i in range(len(w) - 4):
            seen[tuple(w[i : i + 5])] = min(key(d), seen.get(tuple(w[i : i + 5]), 99))
    want: collections.Counter = collections.Counter()
    for d, t in docs:
        w, gone, own = t.split(), set(), set()
        for i in range(len(w) - 4):
            x = tuple(w[i : i + 5])
            if x in own or seen[x] < key(d):
                gone.update(range(i, i + 5))
            own.add(x)
        want[(d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())] += 1
    assert got == want


def test_repeats_of_other_rows_with_the_same_id(spark):
    w, z = " ".join(f"w{i}" for i in range(40)), " ".join(f"z{i}" for i in range(40))
    out = repeats.report(spark.createDataFrame([(1, w), (2, w), (2, z)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in out) == [(1, 0), (2, 0), (2, 40)]


def test_repeats_when_hashes_collide(monkeypatch):
    # Rolling hashes only deal the work: with 3 different ones, segments and windows are still told apart by words.
    monkeypatch.setattr(repeats, "grams", lambda words, k: np.array([int(x) % 3 for x in textarrays.grams(words, k)], np.uint64))
    rng = random.Random(6)
    docs = [" ".join(rng.choice("ab") + str(rng.randrange(4)) for _ in range(60)) for _ in range(12)] + ["a1 b2 " * 20]
    rows = []
    for d, t in enumerate(docs):
        ((_, _, data, offsets),) = textarrays.slices(pa.array([t]))
        for _, start, n, anchor, seg, _ in zip(*repeats.segments(textarrays.Words(data, offsets, textarrays.SPACE_WORD, lower=False), 5)):
            words = t.encode().split()[start : start + n + 4]
            assert int(seg) == int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little")
            rows.append((d, 0, int(start), words))
    gone = collections.defaultdict(set)
    for d, _, start, n in repeats.locate(rows, 5):
        gone[d].update(range(start, start + n + 4))
    assert {d: len(gone[d]) for d in range(len(docs))} == {d: removed for d, (_, removed, _) in brute_repeats(list(enumerate(docs)), 5).items()}


def test_repeats_edges(edge, nothing):
    rows = [(-1 if d is None else d, t) for d, t, *_ in edge_rows()]
    want = brute_repeats(list(dict.fromkeys(rows)), 20)
    got = repeats.report(edge).collect()
    assert len(got) == len(rows)
    assert {-1 if r["doc_id"] is None else r["doc_id"]: tuple(r)[1:] for r in got} == want
    assert repeats.report(nothing).count() == 0
    cut = repeats.remove(edge)
    assert cut.columns == edge.columns
    texts = {-1 if r["doc_id"] is None else r["doc_id"]: r["text"] for r in cut.collect()}
    assert texts[1] == edge_rows()[0][1] and texts[4] is None and texts[6] == " \t\n "
    for d, (_, _, digest) in want.items():
        assert hashlib.sha256(b" ".join((texts[d] or "").encode().split())).hexdigest() == digest


# --- 9 ---------------------------------------------------------------------


def brute_nearest(rows, k):
    fine = {i: np.array(v, np.float32).astype(float) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in fine:
        if q % 20 == 0:
            near = sorted((-float(np.cumsum(fine[q] * v)[-1]), i) for i, v in fine.items() if i != q and len(v) == len(fine[q]))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


@pytest.mark.parametrize(("wave", "tile"), [(4096, 2048), (3, 16)])
def test_nearest_like_brute_force(spark, wave, tile):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=24).tolist()) for i in range(220)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (320, [0.0] * 24), (340, None), (360, [float("nan")] * 24), (380, [None, *rows[3][1][1:]]), (400, [1.0, 2.0]), (401, [2.0, 1.0]), (420, [float("inf")] * 24), (440, [1e-30] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"i": F.lit(1), "v": F.lit(2)}).repartition(4)
    got = collections.defaultdict(list)
    for r in sorted(ann.search(df, df.filter("vec_id % 20 = 0"), wave=wave, tile=tile).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert dict(got) == brute_nearest(rows, 20)


def test_nearest_repeated_and_empty(spark):
    rows = [(i, [float(i), 1.0]) for i in range(30)]
    df = spark.createDataFrame(rows + rows, "vec_id long, embedding array<float>")
    out = ann.search(df, df.filter("vec_id = 20"), k=3).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in out) == [(1, 29), (2, 28), (3, 27)]
    assert ann.search(df.filter("false"), df.filter("false")).count() == 0
    assert ann.search(df.filter("vec_id = 20"), df.filter("vec_id = 20")).count() == 0


def test_nearest_of_extreme_vectors(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=5) * s).tolist()) for i, s in enumerate([1e160, 1e-322, 1e-200, 1.0, 1e300, 1e154] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = collections.defaultdict(dict)
    for r in ann.search(df, df.filter("vec_id % 20 = 0"), k=7, tile=8).collect():
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    vectors = {i: np.array(v) for i, v in rows}
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        for q in (0, 20, 40):
            scores = {i: float(np.cumsum(vectors[q] * v)[-1]) for i, v in vectors.items() if i != q}
            fine = {i: s for i, s in scores.items() if not math.isnan(s)}
            want = sorted(fine, key=lambda i: (-fine[i], i))[:7]
            assert [got[q][r + 1] for r in range(7)] == [(i, fine[i]) for i in want]


def test_nearest_of_an_id_with_two_vectors(spark):
    df = spark.createDataFrame([(0, [2.0, 0.0]), (0, [1.0, 5.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in sorted(ann.search(df, df.filter("vec_id = 0"), k=2).collect(), key=lambda r: r["rank"])] == [(2, 5.0), (1, 1.0)]


def test_bounds_hold():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(40, 33)), rng.normal(size=(50, 33)) * 7
    qa, sa, la, ka = ann.quantise(a)
    qb, sb, lb, _ = ann.quantise(b)
    about = ann.tile_product(qa, qb) * sa[:, None] * sb
    assert (np.abs(a @ b.T - about) <= la[:, None] * np.linalg.norm(b, axis=1) + ka[:, None] * lb + 1e-9).all()


# --- 10 --------------------------------------------------------------------


def test_licences(spark, edge, nothing):
    texts = [
        (1, "Intro.\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
        (2, "Released under the MIT License.\nAll rights reserved."),
        (3, "Licensed under the Apache License, Version 2.0. More text. All rights reserved."),
        (4, "licensed under the apache license version 2.0 and other words"),
        (2, "Released under the MIT License.\nAll rights reserved."),
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: (r["sentence_ids"], r["licences"]) for r in licenses.scan(df).collect()}
    assert got == {1: ("mit_grant,mit_notice", ["MIT"]), 2: ("mit_released,reserved", ["MIT", "Proprietary"]), 3: ("apache_header,|,reserved", ["Apache-2.0", "Proprietary"]), 4: ("", [])}
    assert licenses.scan(df).count() == 5
    assert licenses.scan(edge).filter(F.size("licences") > 0).count() == 0 and licenses.scan(edge).count() == len(edge_rows())
    assert licenses.scan(nothing).count() == 0


def test_licences_of_wrapped_texts(spark):
    mit = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
"""
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
    gpl = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
"""
    mpl = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
"""
    isc = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
    comment = lambda text: "/*\r\n" + "".join(f" * {line}\r\n" for line in text.splitlines()) + " */"
    texts = {
        1: (mit, ["MIT"]),
        2: (comment(mit), ["MIT"]),
        3: (bsd, ["BSD-3-Clause"]),
        4: (comment(bsd), ["BSD-3-Clause"]),
        5: (bsd.replace("1. ", "(1) ").replace("2. ", "b) ").replace("3. ", "* "), ["BSD-3-Clause"]),
        6: (gpl, ["GPL-3.0-or-later"]),
        7: (comment(gpl.replace("software:", "software;")), ["GPL-3.0-or-later"]),
        8: (mpl, ["MPL-2.0"]),
        9: (mpl.replace("v. 2.0", "\nv. 2.0"), ["MPL-2.0"]),
        10: ("// SPDX-License-Identifier: MIT\nint x;", ["MIT"]),
        11: ("# SPDX-License-Identifier: Apache-2.0\n", ["Apache-2.0"]),
        12: ("/* SPDX-License-Identifier: GPL-3.0-or-later */", ["GPL-3.0-or-later"]),
        13: (isc, ["ISC"]),
        14: ("Released under\n\nthe MIT. License", []),
        15: ("Released under the. MIT License", []),
        16: ("SPDX-License-Identifier: MIT-0\n", []),
        17: (bsd.replace("2. ", "Another sentence. 2. "), []),
        19: ("Copyright (c) 2001, A. Person\nAll rights reserved.\n\n" + bsd, ["BSD-3-Clause"]),
        20: (comment("Copyright 2001 X. All rights reserved.\n\n" + bsd[: bsd.index("3.")]), ["BSD-2-Clause"]),
        21: (bsd[: bsd.index("3.")].replace("1. ", "* ").replace("2. ", "* "), ["BSD-2-Clause"]),
        18: ("! " * 50_000 + "\n" + "1. " * 50_000 + "\r\n" * 50_000 + "Released under the MIT License!" + " \t" * 50_000, ["MIT"]),
    }
    df = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert {i: r["licences"] for i, r in got.items()} == {i: want for i, (_, want) in texts.items()}
    assert got[1]["sentence_ids"] == got[2]["sentence_ids"] == "mit_grant,mit_notice,as_is"
    assert got[3]["sentence_ids"] == got[5]["sentence_ids"] == "bsd_grant,bsd_source,bsd_binary,bsd_name"
