import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edge_rows():
    """Nulls, empty and blank texts, ties, repeated rows, a very long text, odd characters."""
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma", "δέλτα", "x1", "the", "of", "é", "ZETA", "eta,"]
    long = " ".join(rng.choice(words) + str(rng.randrange(400)) for _ in range(30_000))
    base = " ".join(rng.choice(words) + str(i % 17) for i in range(120))
    rows = [
        (1, base, "en", "a", len(base)),
        (2, base, "en", "a", len(base)),
        (2, base, "en", "a", len(base)),
        (3, base.replace("alpha3", "omega"), None, None, None),
        (4, None, "en", "b", 0),
        (5, "", "de", "b", 0),
        (6, " \t\n ", "de", "b", 4),
        (7, "one two", "en", None, 7),
        (8, "ONE\ttwo", "en", "c", 7),
        (9, long, "en", "c", len(long)),
        (10, "tail " + long[:200_000].rsplit(" ", 1)[0], "en", "c", 5),
        (11, "日本語 <|endoftext|> \x00 \u0085 \x1c  a" + " " * 50 + "b", "fr", "d", 9),
        (None, "no id here at all", "en", "d", 3),
        (12, "rep " * 100, "en", "d", 400),
    ]
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    from pyspark.sql import functions as F

    # Extra columns with names that operators might use themselves.
    return spark.createDataFrame(edge_rows(), SCHEMA).withColumns({"words": F.lit("w"), "doc": F.lit(1), "n": F.lit(2), "node": F.lit(3), "item": F.lit(4), "gram": F.lit(5), "t": F.lit(6), "shard": F.lit(7), "depth": F.lit(8), "anchor": F.lit(9), "label": F.lit(10), "w": F.lit(11)}).repartition(3)


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.filter("false")
