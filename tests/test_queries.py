"""Every query against its SQL, on the smallest tables."""

import duckdb
import pytest

from skeinflow.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    want = db.sql(catalog.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_others_run(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert len(df.columns) == len(set(df.columns))
    df.collect()


def test_entry_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_copied_fragments_on_every_line(spark, tmp_path):
    docs = [(1, "first line\nsays one Two three four five here\nlast", "en"), (2, "one two three\nfour five six seven", "en"), (3, "x\none two three four five", "de"), (4, None, "en"), (5, "a\nb\nseven eight nine tens", "en"), (6, "one two three four five", "en")]
    items = [(10, "one two three four five six"), (11, "so seven eight nine tens")]
    spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = set()
    for i, text, lang in docs:
        for item, words in ((n, t.split()) for n, t in items):
            spans = [(a, -b) for a in range(len(words)) for b in range(a + 4, len(words) + 1) if lang == "en" and any(f" {' '.join(words[a:b])} " in f" {line.lower()} " for line in (text or "").split("\n"))]
            if spans:
                a, b = min(spans)
                want.add((i, item, " ".join(words[a:-b])))
    assert len(want) == 3 and {tuple(r) for r in catalog.QUERIES["copied_fragments"](spark, str(tmp_path)).collect()} == want


def test_database_units_start_with_a_described_entry(spark, tmp_path):
    # In each size the first name and the smallest number have no description; a part without a number has none either.
    parts = [(0, "a a", "T1", 1), (1, "b b", "T2", 1), (3, "a b", "T3", 2), (4, "c c", "T1", 2), (6, "d d", "T4", 2), (None, "e e", "T9", 2)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    columns = ["file", "field", "n", "first_entry", "last_text"]
    got = sorted(tuple(r[x] for x in columns) for r in catalog.QUERIES["database_units"](spark, str(tmp_path)).collect())
    assert got == [("Items.json", "description", 2, 1, "T2"), ("Items.json", "name", 6, 1, "e e")]
    assert got == sorted(c.sql(catalog.ORACLES["database_units"]).select(*columns).fetchall())
