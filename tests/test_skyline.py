"""The skyline against comparing all pairs."""

import math
import random

import pytest

from wardline.operators.skyline import on_skyline


@pytest.mark.parametrize("seed,n,kinds", [(1, 300, 1000), (2, 400, 8), (3, 1, 3), (4, 0, 3), (5, 2000, 40)])
def test_skyline(spark, seed, n, kinds):
    rng = random.Random(seed)
    odd = [None, float("nan"), float("inf"), -math.inf]
    rows = [(i, rng.choice(odd) if rng.random() < 0.03 else float(rng.randrange(kinds)), rng.choice(odd) if rng.random() < 0.03 else float(rng.randrange(kinds)), 1, "x") for i in range(n)]
    if rows:
        rows.append((n, *rows[0][1:]))
    df = spark.createDataFrame(rows, "id int, a double, b double, cost int, part string").repartition(5)
    good = lambda r: all(x is not None and not math.isnan(x) for x in r[1:3])
    want = {r[0]: good(r) and not any(good(o) and o[1] <= r[1] and o[2] >= r[2] and o[1:3] != r[1:3] for o in rows) for r in rows}
    out = on_skyline(df, "a", "b")
    assert out.columns == [*df.columns, "on_skyline"] and {r["id"]: r["on_skyline"] for r in out.collect()} == want
