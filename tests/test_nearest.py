"""Block search of the nearest vectors against a plain computation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.operators import nearest as NE


def _plain(rows, queries, k):
    def cos(a, b):
        if a is None or b is None or None in a or None in b or len(a) != len(b):
            return None
        dot = lambda x, y: sum((float(p) * float(q) for p, q in zip(x, y)), 0.0)
        return round(dot(a, b) / math.sqrt(dot(a, a) * dot(b, b)), 9)

    out = {}
    for q, a, g in queries:
        found = [(cos(a, b), i) for i, b, h in rows if h == g and i != q]
        out[q] = [i for c, i in sorted(found, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))[:k]]
    return out


@pytest.mark.parametrize("kind", ["random", "copies", "odd"])
def test_nearest(spark, monkeypatch, kind):
    monkeypatch.setattr(NE, "BLOCK", 16)
    monkeypatch.setattr(NE, "QUERIES", 4)
    g = np.random.default_rng(3)
    v = g.normal(size=(200, 8)).round(3).tolist()
    if kind == "copies":
        v = [v[i % 3] for i in range(200)]
    if kind == "odd":
        v = [None if i % 7 == 0 else [None, *x[1:]] if i % 7 == 1 else x[:5] if i % 7 == 2 else x for i, x in enumerate(v)]
    rows = [(i, x, i % 11 % 4) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {}
    for r in NE.nearest(df, df.filter("vec_id % 5 = 0"), 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == _plain(rows, [r for r in rows if r[0] % 5 == 0], 20)


def test_no_row_for_each_pair(spark):
    from test_scale import most_rows

    df = spark.range(1500).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id"), F.lit(0.5)).alias("embedding"), F.lit(1).alias("label"))
    rows, most = most_rows(NE.nearest(df, df.filter("vec_id % 25 = 0"), 20))
    assert len(rows) == 60 * 20 and most < 3 * 1560
