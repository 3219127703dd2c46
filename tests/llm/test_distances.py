"""Search among vectors that lie far from zero or have great norms, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from girder.llm import neighbours


def brute(rows, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    out = {}
    for i in range(len(rows)):
        if ids[i] % 100 == 0:
            big = x * 2.0**-600 if np.abs(x).max() > 1e150 else x
            d = np.sqrt(((big - big[i]) ** 2).sum(1)) * (2.0**600 if big is not x else 1)
            order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:k]
            out[int(ids[i])] = [(int(ids[j]), d[j]) for j in order]
    return out


@pytest.mark.parametrize(("offset", "spread"), [(0.0, 1.0), (1e6, 1e-3), (1e9, 1e-4), (0.0, 1e200), (3e37, 1e36)])
def test_no_neighbour_is_lost_to_rounding(spark, offset, spread):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in offset + spread * rng.standard_normal(8)]) for i in range(400)]
    rows += [(1000 + i, rows[100][1]) for i in range(15)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in neighbours.nearest(table, F.col("id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    expected = brute(rows, 10)
    assert got.keys() == expected.keys()
    for q, near in expected.items():
        assert [i for i, _ in got[q]] == [i for i, _ in near]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in near], rel=1e-12)


def test_the_error_bound_holds():
    rng = np.random.default_rng(5)
    for offset, spread in ((0, 1), (1e7, 1e-3), (-1e12, 10)):
        x, q = (offset + spread * rng.standard_normal((200, 64)) for _ in range(2))
        fast, off = neighbours.squared(q, x)
        exact = ((q[:, None].astype(np.longdouble) - x[None].astype(np.longdouble)) ** 2).sum(2)
        assert (np.abs(fast - exact) <= off[:, None]).all()
