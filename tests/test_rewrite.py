import json

import pytest
from pyspark.sql import functions as F

from skeinflow.sources import rewrite
from skeinflow.sources.rules import RuleError

DOC = {"list": [{"code": 101, "indent": 2, "parameters": ["f"]}, {"code": 401, "indent": 2, "parameters": ["one"], "x": 1}, {"code": 0, "indent": 0, "parameters": []}], "note": '{"deep":{"t":"<n:Bob> hi"}}'}


def test_captures():
    assert rewrite.captures(r"<n:([^>]*)>\s*(.*)", "<n:Bob> hi!") == [{"part": "literal", "text": "<n:"}, {"part": "slot", "text": "Bob"}, {"part": "literal", "text": "> "}, {"part": "slot", "text": "hi!"}]
    assert rewrite.captures("a( )b", "a b") == [{"part": "literal", "text": "a b"}]
    with pytest.raises(RuleError):
        rewrite.captures("(a(b))", "ab")


def test_put_goes_into_strings():
    doc = json.loads(json.dumps(DOC))
    rewrite.put(doc, ["note", "@json", "deep", "t"], "new")
    assert json.loads(doc["note"]) == {"deep": {"t": "new"}}
    with pytest.raises(RuleError):
        rewrite.put(doc, ["list"], "x")


def test_bodies_grow_and_shrink():
    more = rewrite.rebuild_runs(DOC["list"], {0: ["a", "b", "c"]}, 401)
    assert [c["parameters"][:1] for c in more] == [["f"], ["a"], ["b"], ["c"], []] and more[3]["x"] == 1
    assert len(rewrite.rebuild_runs(DOC["list"], {0: []}, 401)) == 2


def test_select_and_write_back(spark):
    docs = spark.createDataFrame([("a.json", json.dumps(DOC)), ("b.json", "{"), ("c.json", "{}")], "file string, content string")
    rules = [{"file": "a.json", "path": "note.deep.t", "pattern": "<n:([^>]*)>"}, {"file": "a.json", "path": "list[].parameters[0]"}, {"file": "b.json", "path": "x"}, {"file": "a.json", "path": "list.t"}]
    found = rewrite.select(docs, rules)
    rows = found.collect()
    assert sorted((r["rule"] or 0, r["text"] or "", r["error"] or "") for r in rows) == [(0, "", "not JSON"), (1, "<n:Bob> hi", ""), (2, "f", ""), (2, "one", ""), (4, "", "no object at ('list',)")]
    assert rewrite.selected_twice(found).count() == 0
    filled = found.filter("rule = 1").select("file", "place", rewrite.fill(F.col("parts"), F.array(F.lit("Rob"))).alias("text"))
    done = {r["file"]: (r["content"], r["problem"]) for r in rewrite.rewritten(docs, filled).collect()}
    assert json.loads(json.loads(done["a.json"][0])["note"]) == {"deep": {"t": "<n:Rob> hi"}}
    assert done["b.json"][0] == "{" and done["b.json"][1] and done["c.json"] == ("{}", None)


def test_edits_change_nothing_else():
    text = '{ "a":1.10,"b":1e400, "c" : 12345678901234567890.123,\n"s":"x\\u0041","l":[0,"y",{"k":"é"}],"e":{},"f":[] ,"j":"{\\"n\\":1.0,\\"t\\":\\"q\\"}" }'
    got = rewrite.edited(text, {("s",): 'new "1"', ("l", 1): "Y", ("l", 2, "k"): "ö", ("j", "@json", "t"): "Q"})
    assert got == text.replace('"x\\u0041"', '"new \\"1\\""').replace('"y"', '"Y"').replace("é", "ö").replace('\\"q\\"', '\\"Q\\"')
    assert rewrite.edited(' "a" ', {(): "b"}) == ' "b" ' and rewrite.edited(text, {}) == text
    for bad, error in (('{"k":1,"k":2}', RuleError), ("[1,]", ValueError), ('{"a" 1}', ValueError), ("[1] 2", ValueError), ("", ValueError), ("[01]", ValueError), ("{", ValueError), ("[1}", ValueError)):
        with pytest.raises(error):
            rewrite.edited(bad, {})
    for place, error in ((("a",), RuleError), (("l",), RuleError), (("z",), LookupError), (("l", 9), LookupError)):
        with pytest.raises(error):
            rewrite.edited(text, {place: "x"})
    deep = "[" * 100_000 + '"x"' + "]" * 100_000
    assert rewrite.edited(deep, {(0,) * 100_000: "y"}) == deep.replace("x", "y")


def test_two_texts_for_one_place(spark):
    docs = spark.createDataFrame([("a", '{"t":"x","n":1.10}')], "file string, content string")
    for texts, want in ((["y", "y"], ('{"t":"y","n":1.10}', True)), (["y", "z"], ('{"t":"x","n":1.10}', False))):
        changes = spark.createDataFrame([("a", '["t"]', x) for x in texts], "file string, place string, text string")
        (row,) = rewrite.rewritten(docs, changes).collect()
        assert (row["content"], row["problem"] is None) == want


def test_order_keys(spark):
    places = [["list", 2], ["list", 10], ["list", 2, "a"]]
    df = spark.createDataFrame([(json.dumps(p),) for p in places], "p string")
    assert [json.loads(r["p"]) for r in df.orderBy(rewrite.order_key(F.col("p"))).collect()] == [["list", 2], ["list", 2, "a"], ["list", 10]]
