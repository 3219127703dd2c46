"""Search, fixity, the registry and the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from girder.llm import fixity, neighbours, registry

SMALL = "/root/testdata/sf0.001"


def brute_nearest(rows, k):
    rows = [(i, np.array(v, float)) for i, v in rows]
    out = {}
    for i, q in rows:
        if i % 100 == 0:
            by = {}
            for j, v in rows:
                if j != i:
                    by[j] = min(by.get(j, np.inf), float(np.sqrt(((v - q) ** 2).sum())))
            out[i] = sorted(by.items(), key=lambda x: (x[1], x[0]))[:k]
    return out


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((20, 16))
    rows = [(i, [float(x) for x in np.float32(centres[i % 20] + 0.3 * rng.standard_normal(16))]) for i in range(3000)]
    same = rows[5][1]
    rows += [(10_000 + i, same) for i in range(600)]  # a large group of equal vectors, queries among them
    odd = [(None, same), (7001, None), (7002, [0.0] * 16), (7003, [1.0] * 15 + [None]), (7004, [float("nan")] * 16), (7005, [float("inf")] * 16), (7006, [1.0]), (7007, [])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).repartition(4)
    got = {}
    for r in neighbours.nearest(table, F.col("id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    expected = brute_nearest(rows, 10)
    assert got.keys() == expected.keys() and all(len(x) == 10 for x in got.values())
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in expected[q]}) for q in expected)
    assert hits >= 0.9 * 10 * len(expected)
    copies = [q for q in expected if q >= 10_000]
    assert copies and all([v for v, _ in got[q]] == [v for v, _ in expected[q]] for q in copies)


def test_nearest_of_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [0.0, 3.0])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in neighbours.nearest(few, F.col("id") % 100 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, pytest.approx(10**0.5))]
    assert neighbours.nearest(few.limit(0), F.col("id") % 100 == 0).count() == 0


def test_forest_leaves_and_queue_agree():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2000, 8))
    direction, threshold = neighbours.fit(x, 2000, neighbours.Forest(trees=3, leaf=100))
    leaf = neighbours.leaves_of(x, direction, threshold)
    sizes = np.bincount(leaf[:, 0])
    assert sizes.min() > 0.3 * sizes.mean()
    for i in range(50):
        margins = np.einsum("j,tnj->tn", x[i], direction) - threshold
        doors = neighbours.opened(margins, 200)
        assert len(set(doors)) == len(doors) and {(t, int(leaf[i, t])) for t in range(3)} <= set(doors)


def test_fixity_finds_damage(spark):
    rows = [(i, f"http://x/{i}", f"<p>é {i}</p>" * (i % 9)) for i in range(700)] + [(None, None, None), (3, "http://x/3", "<p>é 3</p>" * 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("shard", F.lit("x")).repartition(3)
    first = fixity.write_warc(pages, records_a_shard=100)
    whole = fixity.audit(first, fixity.write_warc(pages.repartition(7), records_a_shard=100))
    assert whole.count() == 702 and whole.where("status <> 'intact'").isEmpty()
    line = [(r["at"], r["length"]) for r in whole.where("shard = 2").orderBy("n").collect()]
    assert all(a + n == b for (a, n), (b, _) in zip(line, line[1:], strict=False)) and line[0][0] == 0
    hurt = F.when((F.col("shard") == 4) & (F.col("n") == 17), F.concat("content", F.lit("!").cast("binary"))).otherwise(F.col("content"))
    second = first.withColumn("content", hurt).where("not (shard = 1 and n = 99) and shard <> 6")
    second = second.unionByName(first.where("shard = 0 and n = 0").withColumns({"shard": F.lit(9).cast("long"), "n": F.lit(5)}))
    found = {(r["shard"], r["n"]): r["status"] for r in fixity.audit(first, second).where("status <> 'intact'").collect()}
    assert found.pop((4, 17)) == "corrupt" and found.pop((1, 99)) == "missing" and found.pop((9, 5)) == "added"
    assert set(found.values()) == {"missing"} and {k[0] for k in found} == {6} and len(found) == 100
    assert fixity.audited_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_every_query_runs(spark, name):
    got = registry.queries()[name](spark, SMALL)
    assert got.count() > 0


def test_statements_name_queries():
    assert registry.oracle_sql().keys() <= registry.queries().keys()
