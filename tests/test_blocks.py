import random

import pytest

from skeinflow.operators.blocks import pack_blocks


def slow(sizes, target):
    out, cur, block = [], None, -1
    for g in sizes:
        if cur is not None and cur <= target and cur + g + 1 <= target:
            cur += g + 1
        else:
            block, cur = block + 1, g + 13
        out.append(block)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_like_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    rows = []
    for scope in ("a", "b", None, "hot"):
        n = 400 if scope == "hot" else rng.choice((1, 30))
        rows += [(scope, i, rng.choice((5, 40, 90, 300))) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "scope string, group_id long, size long").repartition(7)
    got = {(r["scope"], r["ord"]): r["block"] for r in pack_blocks(df, target=200).collect()}
    for scope in ("a", "b", None, "hot"):
        mine = sorted((i, g) for s, i, g in rows if s == scope)
        assert [got[(scope, i)] for i, _ in mine] == slow([g for _, g in mine], 200)


def test_empty(spark):
    assert pack_blocks(spark.createDataFrame([], "scope string, group_id long, size long")).count() == 0
