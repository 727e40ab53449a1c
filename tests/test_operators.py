import pytest
from pyspark.sql import functions as F

from skeinflow.operators import families, lifecycle, ordered, qa, relations, runlog, sqlguard, terms
from skeinflow.operators.components import connected_components
from skeinflow.sources import gamedata, jsonl, rules


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (103, 101), (None, 5), (7, 7)], "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100, 103: 100}
    assert connected_components(links.filter("false")).count() == 0


def test_family_outcomes(spark):
    rows = [("t", 1, None, True), ("t", 2, None, True), ("u", 3, "x", False), ("u", 4, None, True), ("v", 5, "x", False), ("v", 6, "y", False), ("v", 7, None, True), ("w", 8, None, False)]
    df = spark.createDataFrame(rows, "k string, ord int, current string, needs boolean")
    got = {r["ord"]: (r["outcome"], r["reused"]) for r in families.family_outcomes(df, ["k"], "ord", "current", "needs").collect()}
    assert got == {1: ("representative", None), 2: ("destination", None), 3: ("current", None), 4: ("reuse", "x"), 5: ("current", None), 6: ("current", None), 7: ("representative", None), 8: ("context", None)}


def test_swap_keeps_nulls_apart(spark):
    units = spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "k int, value string")
    pending = spark.createDataFrame([(1, None, "n", 0), (2, "x", "n", 1), (9, None, "n", 2)], "k int, expected string, value string, ordinal int")
    applied, conflicts = lifecycle.compare_and_swap(units, pending, ["k"], "value")
    assert sorted(tuple(r) for r in applied.collect()) == [(1, "n"), (2, "a"), (3, "b")]
    assert sorted(r["k"] for r in conflicts.collect()) == [2, 9]


def test_swap_gates(spark):
    units = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, value string")
    pending = spark.createDataFrame([(1, "a", "n", 0), (1, "a", "m", 1), (2, "b", "n", 2)], "k int, expected string, value string, ordinal int")
    applied, conflicts = lifecycle.compare_and_swap(units, pending, ["k"], "value")
    assert sorted(tuple(r) for r in applied.collect()) == [(1, "a"), (2, "n"), (3, "c")]
    assert sorted(tuple(r) for r in conflicts.collect()) == [(1, 0), (1, 1)]
    for seen, now, done in (("x", "x", 1), ("x", "y", 0), ("x", None, 0)):
        digests = spark.createDataFrame([(seen, now)], "seen string, now string")
        applied, conflicts = lifecycle.compare_and_swap(units, pending, ["k"], "value", digests)
        assert applied.filter("value = 'n'").count() == done and conflicts.count() == 3 - done


def test_terms_of_units(spark):
    df = spark.createDataFrame([(1, "there then the"), (1, "the"), (3, None), (4, "other")], "k int, s string")
    listed = [{"term": "the"}, {"term": "THERE", "triggers": ["there", "then"]}, {"term": "he"}]
    got = sorted(tuple(r) for r in terms.term_rows(df, ["k"], "s", listed).collect())
    assert got == [(1, "THERE"), (1, "the"), (1, "the"), (4, "the")]


def test_nested_durations(spark):
    rows = [("r", i, e, i * 10) for i, e in enumerate(["start", "start", "stop", "stop", "start", "stop"])]
    df = spark.createDataFrame(rows, "run string, i int, e string, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = sorted(r["micros"] // 1_000_000 for r in ordered.nested_durations(df, "run", ["i"], "e", "ts", "start", "stop").collect())
    assert got == [10, 10, 30]


def test_many_terms(spark):
    df = spark.createDataFrame([(1, "there then"), (2, "the"), (3, None), (4, "other")], "k int, s string")
    listed = [{"term": "the"}, {"term": "there"}, {"term": "then"}, {"term": "he"}]
    got = {r["k"]: r["hits"] for r in terms.term_hits_many(df, "k", "s", listed).collect()}
    native = {r["k"]: r["h"] for r in df.filter("s is not null").select("k", terms.term_hits(F.col("s"), listed).alias("h")).collect()}
    assert got == {1: ["there", "then"], 2: ["the"], 3: [], 4: ["the"]}
    assert native == {k: v for k, v in got.items() if k != 3}


def test_run_checks(spark):
    rows = [("a", 1, "x"), ("a", 2, "end"), ("b", 1, "x"), ("c", 1, "end"), ("c", 2, "x"), ("d", 2, "end")]
    log = spark.createDataFrame(rows, "run string, n int, e string").withColumn("ts", F.timestamp_seconds("n"))
    got = {r["run"]: r["problem"] for r in runlog.check_runs(log, "run", "n", "e", "ts", "end").collect()}
    assert got == {"a": "", "b": "not finished", "c": "goes on after the end", "d": "gap in sequence"}


def test_read_log(spark, tmp_path):
    good = '{"timestamp":"2024-01-01T00:00:00Z","sequence":1,"run_id":"r","level":"info","event":"e","context":"{}","payload":"{}","message":"m"}'
    (tmp_path / "log.jsonl").write_text(good + "\n" + good.replace('"message":"m"', '"more":1') + "\n")
    assert sorted(r["bad"] for r in runlog.read_log(spark, str(tmp_path)).collect()) == ["", "not the closed fields"]


@pytest.mark.parametrize("sql", ["DROP TABLE x", "SELECT 1; SELECT 2", "INSERT INTO x VALUES (1)", "CREATE VIEW v AS SELECT 1"])
def test_guard(spark, sql):
    with pytest.raises(ValueError):
        sqlguard.query(spark, sql)


def test_guard_lets_reads_through(spark):
    assert sqlguard.query(spark, "SELECT ';' AS x -- ; drop\n", None).first()["x"] == ";"


def test_related_and_coverage(spark):
    t = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a")], "k int, t string")
    assert [tuple(r) for r in relations.related(t, "k", "t").collect()] == [(1, 2, 2)]
    assert relations.coverage(t.select("k"), spark.range(2, 5).select(F.col("id").cast("int").alias("k")), "k").count() == 2


def test_links_of_a_hot_token(spark):
    # Token pairs h+g of 1200 keys, and tokens that are shared alone.
    rows = [(k, t) for k in range(1200) for t in ("h", "g", f"own{k}")] + [(k, "h") for k in range(1200, 1300)] + [(2000, "x"), (2000, "y"), (2001, "x"), (2001, "y"), (2002, "y"), (2003, None), (2004, None)]
    t = spark.createDataFrame(rows, "k int, t string")
    got = {r["node"]: r["component"] for r in connected_components(relations.related_links(t, "k", "t")).collect()}
    assert got == {**dict.fromkeys(range(1200), 0), 2000: 2000, 2001: 2000}
    assert relations.related(t.filter("k < 1005"), "k", "t").count() == 1005 * 1004 // 2
    assert sorted(tuple(r) for r in relations.related_links(t.filter("k > 1999"), "k", "t", 1).collect()) == [(2000, 2001), (2000, 2002)]


def test_qa(spark):
    rows = spark.createDataFrame([("1", "pending", "a", None), ("2", "current", "say %1 now", "sag"), ("3", "current", "all fine", "gut")], "unit_key string, state string, source string, translation string")
    found = qa.findings(rows)
    assert sorted((r["unit_key"], r["kind"]) for r in found.collect()) == [("1", "pending"), ("2", "controls")]
    assert qa.verdict(qa.grouped(found)).first()["verdict"] == "unverified"
    assert qa.verdict(qa.grouped(found.filter("false"))).first()["verdict"] == "clean"


def test_jsonl_round_trip(spark, tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "a.jsonl").write_bytes(b'{"id":"g1","kind":"d","units":[{"id":"u1","text":"x\\ny"}]}\r\n{"kind":"d", "id":"g2","units":[{"text":"","id":"u1"}]}\n')
    (root / "sub" / "b.jsonl").write_bytes(b'\n{"id":"g3"}\n{"id":"g4","id":"g5","kind":"d","units":[]}\n{"id":"g6","kind":"d","units":[{"id":"u","text":"t","more":1}]}\n')
    (root / "c.jsonl").write_bytes(b"")
    (root / "d.txt").write_bytes(b"no")
    files = jsonl.read_files(spark, str(root))
    assert sorted(r["path"] for r in files.collect()) == ["a.jsonl", "sub/b.jsonl"]  # an empty file has nothing to read
    groups = jsonl.read_groups(files)
    assert sorted((r["path"], r["line"], r["problem"]) for r in groups.filter("problem is not null").collect()) == [("sub/b.jsonl", 1, "blank line"), ("sub/b.jsonl", 2, "not the closed fields"), ("sub/b.jsonl", 3, "not the closed fields"), ("sub/b.jsonl", 4, "not the closed unit fields")]
    units = jsonl.units_of(groups)
    assert sorted((r["line"], r["group_id"], r["text"]) for r in units.collect()) == [(1, "g1", "x\ny"), (2, "g2", "")]
    fine = groups.filter("problem is null").select("path", "line", F.col("group.id").alias("id"), F.col("group.kind").alias("kind"), F.col("group.units").alias("units"))
    jsonl.write_lines(jsonl.to_lines(fine), str(tmp_path / "out"))
    again = spark.read.text(str(tmp_path / "out")).select(F.from_json("value", jsonl.GROUP).alias("g")).select("g.*")
    assert jsonl.round_trip_differences(fine.select("id", "kind").withColumn("text", F.lit(1)), again.select("id", "kind").withColumn("text", F.lit(2))).count() == 0


def test_digests_ignore_spelling(spark):
    def digests(line):
        files = spark.createDataFrame([("a", bytearray(line))], "path string, raw binary")
        return jsonl.raw_digests(files).first()["digest"], jsonl.asset_digests(jsonl.read_groups(files)).first()["digest"]

    a = digests(b'{"id":"g","kind":"d","units":[{"id":"u","text":"t"}]}\n')
    b = digests(b'{"kind":"d", "id":"g", "units":[{"text":"t","id":"u"}]}\n')
    assert a[0] != b[0] and a[1] == b[1]


def test_rule_files():
    assert rules.terminology(b'[[term]]\nterm="a"\ntranslation="b"\n')[0]["triggers"] == ["a"]
    assert rules.placeholders(b"[[rule]]\norder='preserve'\npattern='x'\nscopes=['d']\n")[0].applies("d", None)
    assert rules.layout(b"[[rule]]\nmax_fullwidth_chars=20\nids=['x']\n")[0]["rule"] == 1
    for bad in (b"rule=[{}]", b"[[rule]]\npattern='('\norder='preserve'", b"[[rule]]\npattern='a'\norder='other'", b"[[rule]]\npattern='(?<n>a)'\norder='preserve'", b"x=1", b"\xff"):
        with pytest.raises(rules.RuleError):
            rules.placeholders(bad)
    for bad in (b"[[term]]\nterm='a'\ntranslation='b'\ntriggers=[]", b"[[term]]\nterm='a'\ntranslation='b'\n[[term]]\nterm='c'\ntranslation='b'\ntriggers=['a']"):
        with pytest.raises(rules.RuleError):
            rules.terminology(bad)
    with pytest.raises(rules.RuleError):
        rules.layout(b"[[rule]]\nmax_fullwidth_chars=20\n")


def test_paths():
    steps = rules.path_steps('a.b[0][]["x.y"]')
    assert steps == [("key", "a"), ("key", "b"), ("index", 0), ("each", None), ("key", "x.y")]
    doc = {"a": {"b": ['[{"x.y":"v"},null,{"z":1}]']}}
    assert [v for _, v in rules.walk(doc, steps)] == ["v"]
    for bad in ("a[", "a[01]", "a..b", 'a["x'):
        with pytest.raises(rules.RuleError):
            rules.path_steps(bad)
    with pytest.raises(rules.RuleError):
        rules.walk({"a": 1}, rules.path_steps("a"))


def test_game_events(spark):
    import json

    cmd = lambda c, i=0, *p: {"code": c, "indent": i, "parameters": list(p)}
    page = {"list": [cmd(101, 0, "f", "0", "0", "0", "Ann"), cmd(401, 0, "one"), cmd(401, 0, "two"), cmd(102, 0, '["y","n"]'), cmd(402, 0), cmd(101, 1, "f"), cmd(401, 1, "in"), cmd(402, 0), cmd(404, 0), cmd(401, 0, "lost"), cmd(320, 0, "1", "Bob")]}
    docs = spark.createDataFrame([("Map001.json", json.dumps({"events": [None, {"id": 3, "pages": [page]}]})), ("System.json", json.dumps({"gameTitle": "T", "currencyUnit": " ", "terms": {"basic": ["Lv", ""], "messages": {"m": "x"}}, "elements": [None, "Fire"]}))], "file string, content string")
    commands = gamedata.event_commands(docs)
    runs = gamedata.speakers(gamedata.text_runs(commands, 101, 401, "dialogue")).collect()
    assert sorted((r["i"], r["lines"], r["speaker"]) for r in runs) == [(0, ["one", "two"], "Ann"), (5, ["in"], None)]
    assert [r["i"] for r in gamedata.orphans(commands).collect()] == [9]
    (c,) = gamedata.choices(commands).collect()
    assert (c["options"], c["branches"], c["closed"]) == (["y", "n"], 2, True)
    assert [r["text"] for r in gamedata.actor_changes(commands).collect()] == ["Bob"]
    assert sorted((r["field"], r["text"]) for r in gamedata.system_units(docs).collect()) == [("elements", "Fire"), ("gameTitle", "T"), ("terms.basic", "Lv"), ("terms.messages", "x")]


def test_stream(spark, tmp_path):
    from skeinflow.streaming import ingest

    (tmp_path / "a.jsonl").write_text('{"id":"g","kind":"d","units":[]}\nbad\n')
    q = ingest.stream_groups(spark, str(tmp_path)).writeStream.format("memory").queryName("groups_in").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(str(r["id"]) for r in spark.sql("SELECT group.id AS id FROM groups_in").collect()) == ["None", "g"]
