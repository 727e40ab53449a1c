import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

from skeinflow.functions import intervals, language, layout, placeholders, punctuation, text, validate
from skeinflow.functions import json as js


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("value", ["", "plain", 'a"b\\c', "\n\t\r\b\f", "\x00\x1f\x7f", "ß😀日本"])
def test_json_length(spark, value):
    assert one(spark, text.json_length(F.col("v")), v=value) == len(json.dumps(value, ensure_ascii=False))


@pytest.mark.parametrize(("value", "blank"), [("", True), (" \t\n　", True), ("\f", False), (" a ", False)])
def test_structural_blank(spark, value, blank):
    assert one(spark, text.structural_blank(F.col("v")), v=value) is blank


def test_framed_digest(spark):
    want = hashlib.sha256(b"".join(bytes([t]) + struct.pack(">Q", len(v.encode())) + v.encode() for t, v in ((1, "a"), (2, "ßü")))).hexdigest()
    assert one(spark, text.framed_digest(text.frame(1, F.lit("a")), text.frame(2, F.lit("ßü")))) == want


@pytest.mark.parametrize(("tag", "want"), [("JA", "ja"), ("zh-hans", "zh-Hans"), ("pt-br", "pt-BR"), ("x_y", None)])
def test_language_tag(spark, tag, want):
    assert one(spark, text.language_tag(F.col("v")), v=tag) == want


@pytest.mark.parametrize(("name", "want"), [("Map001.json", 1), ("Map1234.json", 1234), ("Map0123.json", None), ("Map000.json", None), ("map001.json", None), ("Map4294967295.json", 4294967295)])
def test_map_number(spark, name, want):
    assert one(spark, text.map_number(F.col("v")), v=name) == want


def test_intervals(spark):
    spans = F.array(*[F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end")) for a, b in ((5, 7), (1, 3), (2, 4), (7, 9), (12, 13))])
    assert [tuple(x) for x in one(spark, intervals.merged(spans))] == [(1, 4), (5, 9), (12, 13)]
    assert one(spark, intervals.has_overlap(spans)) is True


def test_japanese(spark):
    assert one(spark, language.japanese_source(F.col("v")), v="東京") is True
    assert one(spark, language.japanese_source(F.col("v")), v="ー、。") is False
    assert one(spark, language.japanese_residual(F.col("v"), 2, ["カナ"]), v="x カナ あ いろは") == "いろは"


@pytest.mark.parametrize(
    ("target", "source", "want"),
    [("well the quick brown fox ran", "a quick brown fox", "quick brown fox"), ("no such words", "other text here", None), ("one two three one two three four", "one two three four", "one two three")],
)
def test_copied_fragment(spark, target, source, want):
    runs = lambda v: language.english_runs(F.lit(v))
    assert one(spark, language.copied_fragment(F.get(runs(target), F.lit(0)), runs(source), 2, 4)) == want


def test_term_boundaries(spark):
    assert one(spark, language.mask_terms(F.col("v"), ["page up", "up"]), v="Page Up upper up!") == "\u0001 upper \u0001!"


def test_candidate_order(spark):
    df = spark.createDataFrame([(["a", " "], ["b"], True), (["a"], ["b\n"], True), (["a", " "], ["b", "x"], True), (["a"], [" "], True), (["a"], ["b\nc"], False), (["a"], ["", " "], False)], "s array<string>, c array<string>, f boolean")
    got = [r["v"] for r in df.select(validate.candidate_violation(F.col("s"), F.col("c"), F.col("f")).alias("v")).collect()]
    assert got == ["line_count", "forbidden_character", "blank_slot_filled", "slot_emptied", None, "all_blank"]


def test_answers(spark):
    expected = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "task int, output_id int")
    answers = spark.createDataFrame([(1, "0", "strings"), (1, "1", "strings"), (1, "1", "strings"), (1, "07", "strings"), (1, "9", "strings")], "task int, raw_id string, shape string")
    got = sorted((str(r["output_id"]), r["verdict"]) for r in validate.classify_answers(expected, answers).collect())
    assert got == [("0", "accepted"), ("1", "duplicate_id"), ("2", "missing_id"), ("9", "unexpected_id"), ("None", "invalid_id")]


def test_decode_answer(spark):
    assert one(spark, validate.decode_answer(F.lit('["a","b"]'), False)) == ["a", "b"]
    assert one(spark, validate.decode_answer(F.lit('{"source":["x"],"translation":["y"]}'), True)) == ["y"]
    assert one(spark, validate.decode_answer(F.lit('["a",1]'), False)) is None


RULES = [placeholders.Rule(r"<b>(?<text>.*?)</b>"), placeholders.Rule(r"%[0-9]+", "reorder_within_slot")]


def test_protect_and_restore():
    out, bindings, error = placeholders.protect("say <b>hi</b> to %1 and %2", RULES)
    assert error is None and [b["segment"] for b in bindings] == ["BEGIN", "END", "WHOLE", "WHOLE"]
    assert placeholders.restore(out, bindings) == ("say <b>hi</b> to %1 and %2", None)
    t = [b["token"] for b in bindings]
    assert placeholders.check_tokens(out.replace(t[2], "").replace(t[3], t[3] + t[2]), bindings) is None
    assert placeholders.check_tokens(out.replace(t[0], "§").replace(t[1], t[0]).replace("§", t[1]), bindings) == "order"
    assert placeholders.check_tokens(out.replace(t[2], ""), bindings) == "missing"
    assert placeholders.check_tokens(out + t[2], bindings) == "duplicated"
    assert placeholders.check_tokens(out + "⟦PH_WHOLE_0099⟧", bindings) == "unknown"


@pytest.mark.parametrize(("rules", "value", "error"), [(["x*"], "abc", "empty_match"), (["ab", "bc"], "abc", "overlap"), (["a\nb"], "a\nb", "line_crossing"), (["(?<text>a)|b"], "b", "missing_text_capture")])
def test_protect_errors(rules, value, error):
    assert placeholders.protect(value, [placeholders.Rule(r) for r in rules])[2] == error


def test_segments(spark):
    out, _, _ = placeholders.protect("a %1 b", RULES)
    assert [(x["kind"], x["text"]) for x in one(spark, placeholders.segments(F.lit(out)))] == [("natural", "a "), ("opaque", "⟦PH_WHOLE_0000⟧"), ("natural", " b")]


def test_layout():
    assert layout.display_width("日本a\\C[2]b") == 6
    assert layout.lay_out("one two three four", 5) == "one two\nthree four"
    assert layout.lay_out("日本語、です", 3) == "日本\n語、で\nす"
    assert layout.lay_out("unbreakable", 3) is None
    assert layout.lay_out("「one two three」", 5, indent=True).split("\n")[1].startswith("　")
    for line in layout.lay_out("aa bb cc dd ee ff gg", 4).split("\n"):
        assert layout.display_width(line) <= 8


def test_punctuation():
    assert punctuation.repair("Hi, you!", "Hi， you！") == ("Hi, you!", 2)
    assert punctuation.repair("“Hi”", '"Hi"') == ("“Hi”", 2)
    assert punctuation.repair("a, b", "a b") == ("a b", 0)
    # Which of two equal signs belongs to the source's one can't be known.
    assert punctuation.repair("a,", "a，b，") == ("a，b，", 0)


@pytest.mark.parametrize(
    ("bad", "want"),
    [('{"a":1', {"a": 1}), ("{'a': 'it\\'s'}", {"a": "it's"}), ("sure:\n```json\n[1,2,]\n```", [1, 2]), ('{a: True, "b": None}', {"a": True, "b": None}), ('{"a":"x\ny"}', {"a": "x\ny"}), ('{"a":1 "b":2}', {"a": 1, "b": 2}), ("[1,,2]", [1, 2]), ('{"a":}', {"a": None}), ("[1,2} ", [1, 2]), ("// c\n[1]", [1]), ("nothing", None)],
)
def test_repair(bad, want):
    fixed, kinds = js.repair(bad)
    assert (json.loads(fixed) if fixed else None) == want
    assert kinds or want is None


def test_leaves():
    doc = {"a": ["x", {"b": '{"c":"y"}'}], "d": 1, "e": "[no"}
    assert sorted(js.iter_leaves(doc)) == [("a/0", "x", 0), ("a/1/b/@json/c", "y", 1), ("e", "[no", 0)]


def test_strict_json(spark):
    assert one(spark, js.strict(F.lit('{"a":1,"a":2}')).isNull()) is True
    assert one(spark, js.closed_object(F.lit('{"b":1,"a":2}'), ["a", "b"])) is True
    assert one(spark, js.member_ordinal(F.lit('{"b":1,"a":2}'), F.lit("a"))) == 1


def test_japanese_letters_by_range(spark):
    letters = [0x3041, 0x3096, 0x309F, 0x30A1, 0x30FA, 0x30FF, 0x31F0, 0xFF66, 0xFF70, 0xFF9D, 0x3007, 0x3400, 0x9FFF, 0xFAFF, 0x2A6DF, 0x2EE5F, 0x2FA1F, 0x30000, 0x323AF]
    others = [0x3005, 0x3040, 0x3097, 0x3099, 0x309E, 0x30A0, 0x30FB, 0x30FC, 0x30FE, 0xFF65, 0xFF9E, 0xFF9F, 0x2A6E0, 0x2EE60, 0x2FA20, 0x323B0, 0x41]
    df = spark.createDataFrame([(c, chr(c)) for c in letters + others], "c int, s string")
    assert {r["c"] for r in df.filter(language.japanese_source(F.col("s"))).collect()} == set(letters)
